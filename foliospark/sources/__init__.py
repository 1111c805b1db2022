"""Readers of notes, pages, archives and slides."""
