"""Sharding by histogram sort.

Documents are ordered by a key (hash of the text, document id).  The splitters
between shards are found by rounds of probes: each round counts the exact bytes
below every candidate boundary in all partitions, and the interval that holds a
splitter's target is cut again until the splitter meets the tolerance.  Only
then are the rows exchanged - once - to their place.

A driver round sees one count per probe, never keys of documents.  Every shard
is cut further into cells of bounded size by the same probes, so a task holds
a cell, not a shard.  Equal texts are neighbours in the order; a group larger
than a shard is split by id.  If whole rows are so often repeated that one key
outweighs the tolerance, a row number becomes part of the key.

Cases: a null text has no bytes and still has its fixed weight; null ids sort
first; repeated rows are kept and spread like others; an empty table gives an
empty result; other columns are carried along, and the
added ones carry a prefix so that they do not clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm._common import materialize

#: New boundaries tried in an interval in one round.
PROBES = 64
#: A splitter is settled when it is this close to its target, as a share of a shard.
TOLERANCE = 0.002
#: Bytes that a cell (a sort task's share) holds at about.
CELL_BYTES = 64 << 20
#: Room for a row number below (hash, id).
_SPAN = 1 << 192
_FLIP = 1 << 63


def _split_key(key: int) -> tuple[int, int, int]:
    return (key >> 128) - _FLIP, ((key >> 64) & (2**64 - 1)) - _FLIP, (key & (2**64 - 1)) - _FLIP


def _boundaries(keys: list[int]) -> np.ndarray:
    return np.array([_split_key(k) for k in keys], dtype=np.int64).reshape(-1, 3)


def place(h: np.ndarray, d: np.ndarray, r: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the sorted three-part boundaries are at or below each key."""
    lo = np.searchsorted(bounds[:, 0], h, side="left")
    hi = np.searchsorted(bounds[:, 0], h, side="right")
    at = hi.copy()
    near = np.flatnonzero(lo < hi)
    if len(near):
        for a in np.unique(lo[near]):
            rows = near[lo[near] == a]
            b = hi[rows[0]]
            at[rows] = a + place2(d[rows], r[rows], bounds[a:b, 1:])
    return at


def place2(d: np.ndarray, r: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    lo = np.searchsorted(bounds[:, 0], d, side="left")
    at = np.searchsorted(bounds[:, 0], d, side="right")
    near = np.flatnonzero(lo < at)
    for a in np.unique(lo[near]):
        rows = near[lo[near] == a]
        at[rows] = a + np.searchsorted(bounds[a : at[rows[0]], 1], r[rows], side="right")
    return at


def _histogram(bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, rows = np.zeros(len(bounds) + 1), np.zeros(len(bounds) + 1, dtype=np.int64)
        for batch in batches:
            h, d, r, w = (batch.column(c).to_numpy() for c in ("h", "d", "r", "w"))
            at = place(h, d, r, bounds)
            weight += np.bincount(at, weights=w, minlength=len(weight))
            rows += np.bincount(at, minlength=len(rows))
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(weight[used].astype(np.int64)), pa.array(rows[used])], names=["at", "w", "n"])

    return run


def _count(keys: DataFrame, probes: list[int]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows below each probe, and the totals at the end."""
    found = keys.mapInArrow(_histogram(_boundaries(probes)), "at long, w long, n long").groupBy("at").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect()
    weight, rows = [0] * (len(probes) + 1), [0] * (len(probes) + 1)
    for x in found:
        weight[x["at"]], rows[x["at"]] = int(x["w"]), int(x["n"])
    return np.cumsum(weight, dtype=object).tolist(), np.cumsum(rows, dtype=object).tolist()


def find_splitters(keys: DataFrame, shards: int, total: int, cells: int) -> tuple[list[int], list[int], list[int], bool]:
    """Boundaries of the cells in key order, the rows below each, the ones that end shards, and whether all met the tolerance."""
    probes = [_SPAN * k // cells for k in range(1, cells)]
    weight, rows = _count(keys, probes) if probes else ([total], [0])
    edge, below, count = [0, *probes, _SPAN], [0, *weight], [0, *rows]
    targets = [total * k // shards for k in range(1, shards)]
    slack = TOLERANCE * total / shards
    chosen: dict[int, int] = {}
    met = True
    state = {t: None for t in range(len(targets))}
    for t, target in enumerate(targets):
        i = max(k for k in range(len(edge)) if below[k] <= target and k < len(edge) - 1)
        state[t] = ((edge[i], below[i], count[i]), (edge[i + 1], below[i + 1], count[i + 1]))
    while state:
        nxt = {}
        for t, (low, high) in state.items():
            best = min((low, high), key=lambda x: abs(x[1] - targets[t]))
            if abs(best[1] - targets[t]) <= slack or high[0] - low[0] <= 1:
                chosen[t] = best
                met &= abs(best[1] - targets[t]) <= slack
            else:
                nxt[t] = (low, high)
        if not nxt:
            break
        tried = sorted({low[0] + (high[0] - low[0]) * k // PROBES for low, high in nxt.values() for k in range(1, PROBES)})
        weight, rows = _count(keys, tried)
        state = {}
        for t, (low, high) in nxt.items():
            line = [low, *((p, w, n) for p, w, n in zip(tried, weight, rows, strict=False) if low[0] < p < high[0]), high]
            i = max(k for k in range(len(line) - 1) if line[k][1] <= targets[t])
            state[t] = (line[i], line[i + 1])
    ends = [chosen[t] for t in range(len(targets))]
    every = {e: n for e, n in zip(edge[1:-1], count[1:-1], strict=True)} | {e[0]: e[2] for e in ends}
    order = sorted(every)
    return order, [every[k] for k in order], [e[0] for e in ends], met


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", weight: int = 8, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """The rows of ``docs`` with ``folio_size``, ``folio_shard`` and ``folio_slot`` (gapless from 0 in each shard).

    A row weighs its text's UTF-8 bytes plus ``weight``; shards are near equal in weight.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + F.lit(weight)
    lowest = F.lit(-(2**63)).cast("long")
    h, d = F.xxhash64(F.col(text_col)), F.coalesce(F.col(id_col).cast("long"), lowest)
    rows = docs.withColumns({"folio_size": size, "folio_h": h, "folio_d": d, "folio_r": lowest})
    slim = lambda table: materialize(table.select(F.col("folio_h").alias("h"), F.col("folio_d").alias("d"), F.col("folio_r").alias("r"), F.col("folio_size").alias("w")), "keys")
    keys = slim(rows)
    total = int(keys.agg(F.sum("w")).first()[0] or 0)
    cells = max(shards * 4, -(-total // cell_bytes))
    order, below, ends, met = find_splitters(keys, shards, total, cells)
    if not met and keys.groupBy("h", "d").count().where("count > 1").limit(1).count():
        # One key outweighs the tolerance: the rows are written once with a number, which then splits it.
        rows = materialize(rows.withColumn("folio_r", F.monotonically_increasing_id()), "numbered")
        keys = slim(rows)
        order, below, ends, met = find_splitters(keys, shards, total, cells)
    bounds = _boundaries(order)
    shard_of = np.searchsorted(np.array(sorted(ends), dtype=object), np.array([0, *order], dtype=object), side="right").astype(np.int32)
    base = np.array([0, *below], dtype=np.int64)
    first = {s: base[np.flatnonzero(shard_of == s)[0]] for s in np.unique(shard_of)}
    ahead = np.array([b - first[s] for b, s in zip(base, shard_of, strict=True)], dtype=np.int64)

    schema = T.StructType([T.StructField("cell", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("ahead", T.LongType())])

    @F.pandas_udf(schema)
    def cell_of(h: pd.Series, d: pd.Series, r: pd.Series) -> pd.DataFrame:
        at = place(h.to_numpy(), d.to_numpy(), r.to_numpy(), bounds)
        return pd.DataFrame({"cell": at.astype(np.int64), "shard": shard_of[at], "ahead": ahead[at]})

    placed = rows.withColumn("folio_at", cell_of("folio_h", "folio_d", "folio_r"))
    line = Window.partitionBy("folio_at.cell").orderBy("folio_h", "folio_d", "folio_r")
    placed = placed.withColumn("folio_slot", F.row_number().over(line).cast("long") - 1 + F.col("folio_at.ahead"))
    return placed.withColumn("folio_shard", F.col("folio_at.shard")).drop("folio_at", "folio_h", "folio_d", "folio_r")
