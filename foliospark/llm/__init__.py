"""Operators that prepare large text corpora for language-model training.

Nothing else in the library imports this subpackage; it can be removed as a
whole.  Each module holds one operator with a general interface; ``queries``
registers the thin ``opN_*`` queries over the test tables.
"""
