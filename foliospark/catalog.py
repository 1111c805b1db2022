"""The registered queries over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.plans import contracts, courses, decks, documents, files, gates, guides, marks, pages, policies, registers, scalars, streams, tables, vault
from foliospark.plans.registry import ORACLES, QUERIES

__all__ = ["contracts", "courses", "decks", "documents", "files", "gates", "guides", "marks", "pages", "policies", "registers", "scalars", "streams", "tables", "vault"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
