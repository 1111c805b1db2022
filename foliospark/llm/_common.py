"""Shared plumbing of the operators: shared-folder tables, bitmaps, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset a local folder serves a local master only (tests); on a
    cluster the executors would not see one another's files, so it is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="foliospark-"))
    return _OWN_DIR[0]


#: Rows of one Arrow batch between the JVM and a Python task, as documents vary from a line to a book.
ARROW_ROWS = 1000


def bounded_batches(df: DataFrame) -> DataFrame:
    """Keeps the session's Arrow batches small, as both sides hold whole ones; returns ``df``."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key, "10000")) <= ARROW_ROWS:
        conf.set(key, str(ARROW_ROWS))
    return df


def fresh(name: str, columns: list[str]) -> str:
    """A column name that none of ``columns`` has."""
    while name in columns:
        name += "_"
    return name


#: Bytes of a row group of an intermediate table: what a writing task holds on the heap.
ROW_GROUP_BYTES = 16 << 20


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folio_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table that ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_folio_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def lean(task):
    """A Python task that gives its memory back to the system at its end, as workers live on with what they held at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of unsigned integers (published splitmix constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in small pieces: bounds what a Python task builds from one of them."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def binary_column(batch: pa.RecordBatch, name: str) -> Iterator[bytes | None]:
    """A string column as UTF-8 bytes, without decoding, a few rows at a time."""
    column = batch.column(name)
    for at in range(0, len(column), 256):
        yield from column.slice(at, 256).cast(pa.binary()).to_pylist()


#: Words of the membership bitmap (each of 64 bits): a fixed bound of 2 MB, whatever the input.
BITMAP_WORDS = 1 << 18


def key_bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the hashed keys, built by ``bit_or`` in Spark.

    At most ``BITMAP_WORDS`` rows reach the driver.  It is only a prefilter:
    a full bitmap lets everything through, and a join decides afterwards.
    """
    bits = F.shiftrightunsigned(F.col(column), 3)
    rows = (
        keys.groupBy((F.shiftrightunsigned(bits, 6) % F.lit(BITMAP_WORDS)).alias("w"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, 3) & 63 as int))")).alias("b"))
        .toArrow()
    )
    out = np.zeros(BITMAP_WORDS, dtype=np.uint64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = keys.astype(np.int64).view(np.uint64) >> np.uint64(3)
    words = bitmap[((bits >> np.uint64(6)) % np.uint64(BITMAP_WORDS)).astype(np.int64)]
    return (words >> (bits & np.uint64(63))) & np.uint64(1) == 1


#: Keys that are told to be hot, at most, and the summary's size: both fixed, whatever the input.
HOT_KEYS, TRACKED_KEYS = 1000, 10_000
#: Members from which a key's group is dealt over many tasks before any task sees it.
HOT_MEMBERS = 10_000


def hot_keys(keyed: DataFrame, column: str, members: int) -> list[int]:
    """Keys with more than ``members`` rows, by a frequent-items summary made in Spark (at most ``HOT_KEYS``).

    It only decides how rows are dealt, so that a key it misses costs time and no result.
    """
    found = keyed.selectExpr(f"approx_top_k({column}, {HOT_KEYS}, {TRACKED_KEYS}) as top").first()["top"] or []
    return [r["item"] for r in found if r["item"] is not None and r["count"] > members]


def salted_join(rows: DataFrame, facts: DataFrame, key: str, spread: Column, members: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts`` (one row per ``key``) without a hot key in one task.

    ``facts`` holds in ``members`` how many of ``rows`` have the key.  Keys of
    more than a thousandth of them (and of 1000 at least) are at most 1000;
    their rows are dealt by ``spread`` and their facts are repeated as often.
    """
    total = facts.agg(F.sum(members)).first()[0] or 0
    hot = [r[0] for r in facts.where(F.col(members) > max(1000, int(total) // 1000)).select(key).collect()]
    if not hot:
        return rows.join(facts, key, how)
    salt, salts = fresh("folio_salt", rows.columns + facts.columns), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = F.col(key).isin(hot)
    left = rows.withColumn(salt, F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0))
    right = facts.withColumn(salt, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, salt], how).drop(salt)


def sorted_runs(batches: Iterator[pa.RecordBatch], key_columns: list[str]) -> Iterator[pa.Table]:
    """Whole groups of a stream sorted by ``key_columns``, several at a time.

    The last group of a batch is held until its end is seen.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in key_columns:
            v = batch.column(c).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        if held:
            change[0] = any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in key_columns)
        cuts = np.flatnonzero(change)
        if len(cuts):
            last = int(cuts[-1])
            done = [*held, batch.slice(0, last)] if last else held
            if done and sum(b.num_rows for b in done):
                yield pa.Table.from_batches(done)
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def group_starts(table: pa.Table, key_columns: list[str]) -> np.ndarray:
    """Offsets at which a group begins, and the number of rows at the end."""
    change = np.zeros(table.num_rows, dtype=bool)
    change[:1] = True
    for c in key_columns:
        v = table.column(c).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges (a, b): the smallest node reachable from each."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


#: Edges of which a task keeps a spanning forest at a time, and edges that one task joins alone: fixed bounds on its memory, whatever the input.
FOREST_EDGES, LOCAL_EDGES = 200_000, 1_000_000


def _forest(most: int):
    """Stars that span each run of about ``most`` edges of a task: every node but the smallest of its component, with that one."""

    def stars(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate([h.column(c).to_numpy(zero_copy_only=False) for h in held]) for c in ("u", "v"))
        names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = local_components(len(names), flat[: len(a)], flat[len(a) :])
        keep = np.flatnonzero(label != np.arange(len(names)))
        for at in range(0, len(keep), 50_000):
            some = keep[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(names[label[some]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= most:
                yield from stars(held)
                held, size = [], 0
        if held:
            yield from stars(held)

    return run


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph of long nodes: ``node``, ``component`` (the smallest node reachable).

    ``edges`` has the long columns ``u`` and ``v``.  Alternating large-star and
    small-star rounds, each written to the shared folder, until none changes an
    edge or at most ``LOCAL_EDGES`` are left, which one task joins: every round
    is many stages, and what the driver holds for them adds up.  The rounds'
    number grows with the logarithm of the nodes.  Only nodes with an
    edge to another node appear.  An empty table gives an empty table; nulls
    and loops are ignored.
    """
    clean = edges.where("u is not null and v is not null and u <> v").select("u", "v")
    now = materialize(clean.mapInArrow(lean(_forest(FOREST_EDGES)), "u long, v long").distinct(), "edges")
    tally = lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = tally(now)
    while before[0] > LOCAL_EDGES:
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        small = pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after_table = materialize(small, "edges")
        after = tally(after_table)
        discard(now)
        now = after_table
        if after == before:
            break
        before = after
    else:
        if before[0]:
            joined = materialize(now.coalesce(1).mapInArrow(lean(_forest(LOCAL_EDGES + 1)), "u long, v long"), "edges")
            discard(now)
            now = joined
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    out._folio_path = now._folio_path  # for ``discard``
    return out
