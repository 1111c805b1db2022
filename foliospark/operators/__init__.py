"""Relational operators over note frames."""
