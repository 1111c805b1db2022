"""Incremental runs of the rules."""
