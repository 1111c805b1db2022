"""Line deduplication by a segment-partition edit-distance join.

Two lines are near-equal if both hold ``min_chars`` characters or more and
their edit distance is at most ``edits``.  A line is split into ``edits + 1``
even segments; within that distance at least one segment of the shorter line
stands unchanged in the longer one, at a place that the length difference and
the segment's number confine (multi-match-aware selection).  Segments and the
substrings to probe are hashed with length and segment number; a key that holds
segment and probe of different lines makes a candidate group.  Members are
verified by a banded bit-parallel edit distance.  Lines form classes by
transitive closure; the first occurrence of a class, by document id and line
number, stays and the others go.

Equal lines, by a 63-bit hash, are one line throughout, so a line in half of all documents is one
row.  Groups are verified in bounded blocks and return spanning forests, not pairs.
Keys and lines that very many rows share are dealt over many tasks before any sees them.

Cases: null texts and texts without lines of the least length are left as they
are; rows equal in id and text are one document and keep their lines together;
null ids come last; an empty table gives an empty result.  Shorter lines are
never removed, longer ones whole, whatever their length; equal lines are ties that the
first place wins.  Clashing column names do not matter: work columns carry a prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm._common import HOT_MEMBERS, bounded_batches, connected_components, discard, fresh, group_starts, hot_keys, in_bitmap, key_bitmap, lean, local_components, materialize, salted_join, slices, sorted_runs

EDITS = 2
MIN_CHARS = 20
#: Lines in one verification block; bounds a task's memory, not the result.
BLOCK_LINES = 1024
#: Members of a key up to which its group is recognised by its member set.
NAMED_GROUP = 512
_SEEN = 100_000


def line_name(raw: bytes) -> int:
    """An even signed 64-bit name of a line (the low bit tells segments from probes)."""
    return (xxhash.xxh3_64_intdigest(raw) & ~1) - (1 << 63)


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and size of the even segments of a line; later ones take the rest."""
    size, longer = divmod(length, edits + 1)
    out, at = [], 0
    for k in range(edits + 1):
        n = size + (k >= edits + 1 - longer)
        out.append((at, n))
        at += n
    return out


def probe_places(length: int, edits: int) -> list[tuple[int, int, int, int]]:
    """Substrings of a line of ``length`` to look up: (other length, segment, start, size)."""
    out = []
    for other in range(max(edits + 1, length - edits), length + 1):
        delta = length - other
        for k, (p, n) in enumerate(segments(other, edits)):
            low = max(p - k, p + delta - (edits - k), 0)
            high = min(p + k, p + delta + (edits - k), length - n)
            out += [(other, k, start, n) for start in range(low, high + 1)]
    return out


_LINES = "id long, dk long, no int, name long, keys array<long>"


def _lines(edits: int, min_chars: int):
    """Every line of the least length with its place and name and, once per task, the keys of its segments, then of its probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[int, list[tuple[int, int, int]]] = {}
        seen: set[int] = set()
        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches):
            row, number, names, keys, end, fresh_ = [], [], [], [], [0], []
            for r, text in enumerate(batch.column("text")):
                for k, line in enumerate((text.as_py() or "").split("\n")):
                    n = len(line)
                    if n < min_chars:
                        continue
                    name = line_name(line.encode())
                    row.append(r), number.append(k), names.append(name)
                    fresh_.append(name not in seen)
                    if fresh_[-1]:
                        seen.add(name)
                        if n not in places:
                            if len(places) > 4000:
                                places.clear()
                            places[n] = [(n * 64 + k, p, p + m) for k, (p, m) in enumerate(segments(n, edits))] + [(o * 64 + k, p, p + m) for o, k, p, m in probe_places(n, edits)]
                        found = [digest(line[a:b].encode(), seed) for seed, a, b in places[n]]
                        keys += found[: edits + 1]
                        keys += set(found[edits + 1 :])
                    end.append(len(keys))
            at = pa.array(row, pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(end, pa.int32()), pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), mask=pa.array(~np.array(fresh_, dtype=bool)))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("dk").take(at), pa.array(number, pa.int32()), pa.array(names, pa.int64()), lists], names=["id", "dk", "no", "name", "keys"])
            if len(seen) > _SEEN:
                seen.clear()

    return run


def candidate_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a stream sorted by (key, item): members of keys that hold a segment and a probe of different lines.

    Small groups with the same members get one name, so that lines which share
    several keys are verified once.  Of larger groups all members are given under the key.
    """
    for table in sorted_runs(batches, ["key"]):
        key, item = table["key"].to_numpy(), table["item"].to_numpy()
        fresh = np.append(True, (key[1:] != key[:-1]) | (item[1:] != item[:-1]))
        key, item = key[fresh], item[fresh]
        name, own = item & ~1, item & 1
        start = np.append(True, key[1:] != key[:-1])
        group = np.cumsum(start) - 1
        n = group[-1] + 1
        first = name[start]
        mixed = np.zeros(n, dtype=bool)
        mixed[group[name != first[group]]] = True
        has_own, has_probe = np.bincount(group, own, n) > 0, np.bincount(group, 1 - own, n) > 0
        keep = (mixed & has_own & has_probe)[group]
        if not keep.any():
            continue
        key, name, group = key[keep], name[keep], group[keep]
        once = np.append(True, (group[1:] != group[:-1]) | (name[1:] != name[:-1]))
        key, name, group = key[once], name[once], group[once]
        start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(start, len(name)))
        label = key[start].copy()
        hot = size > NAMED_GROUP
        for g in np.flatnonzero(~hot):
            label[g] = xxhash.xxh3_64_intdigest(name[start[g] : start[g] + size[g]].tobytes()) - (1 << 63)
        pair = np.stack([np.repeat(label, size), name, np.repeat(hot, size)], axis=1)
        pair = np.unique(pair, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(pair[:, 2].astype(bool))], names=["grp", "name", "hot"])


def _texts(bitmap: np.ndarray, min_chars: int):
    """Each candidate line's text, once per task; the bitmap only spares work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            names, lines = [], []
            for text in batch.column("text"):
                for line in (text.as_py() or "").split("\n"):
                    if len(line) >= min_chars:
                        names.append(line_name(line.encode()))
                        lines.append(line)
            names_ = np.array(names, dtype=np.int64)
            out = []
            for k in np.flatnonzero(in_bitmap(bitmap, names_)).tolist():
                if names[k] not in seen:
                    seen.add(names[k])
                    out.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(names_[out] if out else names_[:0]), pa.array([lines[k] for k in out], pa.string())], names=["name", "line"])
            if len(seen) > _SEEN:
                seen.clear()

    return run


def banded_edits(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, edits: int) -> np.ndarray:
    """For many pairs at once: is the edit distance at most ``edits``?

    Rows of ``a`` and ``b`` are code points, padded with different values.
    Bit-parallel: one word per pair and number of edits holds the diagonals of
    the band that can be reached (bit d: diagonal d - edits), advanced over
    runs of equal characters column by column.
    """
    pairs, width = a.shape[0], 2 * edits + 1
    full = np.uint64((1 << width) - 1)
    one = np.uint64(1)
    state = [np.zeros(pairs, dtype=np.uint64) for _ in range(edits + 1)]
    state[0][:] = one << np.uint64(edits)
    for e in range(1, edits + 1):  # insertions before the first column
        state[e] = state[e - 1] | (state[e - 1] << one) & full
    done = np.zeros(pairs, dtype=bool)
    goal = one << (lb - la + edits).clip(0, width - 1).astype(np.uint64)
    padded = np.pad(b, ((0, 0), (edits, edits)), constant_values=-3)
    for i in range(a.shape[1] + 1):
        at_end = la == i
        done[at_end] = (state[edits][at_end] & goal[at_end]) != 0
        if i == a.shape[1] or not (la > i).any():
            break
        window = padded[:, i : i + width]
        if window.shape[1] < width:
            window = np.pad(window, ((0, 0), (0, width - window.shape[1])), constant_values=-3)
        match = ((window == a[:, i : i + 1]).astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        new = []
        for e in range(edits + 1):
            now = state[e] & match
            if e:
                now |= state[e - 1] | (state[e - 1] >> one)  # replaced; deleted from a
                now |= (new[e - 1] << one) & full  # inserted from b
            new.append(now)
        state = new
    return done & (np.abs(la - lb) <= edits)


def near_pairs(lines: list[str], edits: int, group: np.ndarray | None = None, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of lines within the edit distance, of many groups at once.

    Lines of a group are neighbours; pairs are compared within a group, and
    where ``side`` is not negative only across its two values.
    """
    n = len(lines)
    group = np.zeros(n, dtype=np.int64) if group is None else group
    size = np.array([len(x) for x in lines], dtype=np.int64)
    flat = np.frombuffer("".join(lines).encode("utf-32-le"), dtype=np.int32)
    begin = np.append(0, np.cumsum(size))
    counts = np.bincount(np.repeat(np.arange(n), size) * 64 + (flat & 63), minlength=64 * n).reshape(n, 64).astype(np.int32)
    left, right = [], []
    for step in range(1, n):
        i = np.flatnonzero(group[step:] == group[:-step])
        if not len(i):
            break
        j = i + step
        fits = np.abs(size[i] - size[j]) <= edits
        if side is not None:
            fits &= (side[i] < 0) | (side[i] != side[j])
        i, j = i[fits], j[fits]
        # An edit changes the letter counts by two at most.
        fits = np.abs(counts[i] - counts[j]).sum(axis=1) <= 2 * edits
        left.append(i[fits])
        right.append(j[fits])
    if not left:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    i, j = np.concatenate(left), np.concatenate(right)
    good = np.zeros(len(i), dtype=bool)
    order = np.argsort(size[i], kind="stable")  # pairs of like lengths together
    at = 0
    while at < len(order):
        here = order[at : at + max(1, 1_000_000 // max(1, int(size[i[order[min(at + 4095, len(order) - 1)]]])))][:4096]
        good[here] = _within(flat, begin[i[here]], size[i[here]], begin[j[here]], size[j[here]], edits)
        at += len(here)
    return i[good], j[good]


def _rows(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, fill: int) -> np.ndarray:
    """Slices of ``flat`` as rows of one width."""
    at = np.arange(int(size.max(initial=0)))
    inside = at < size[:, None]
    return np.where(inside, flat[np.where(inside, begin[:, None] + at, 0)], fill) if len(flat) else np.full(inside.shape, fill)


def _within(flat: np.ndarray, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, edits: int) -> np.ndarray:
    """Banded distance of what is left of each pair without its common start and end."""
    least = np.minimum(la, lb)
    differ = _rows(flat, a, least, -1) != _rows(flat, b, least, -1)
    head = np.where(differ.any(axis=1), differ.argmax(axis=1), least) if differ.shape[1] else least
    rest = least - head
    back = np.arange(differ.shape[1])
    open_ = back < rest[:, None]
    pa_, pb = a[:, None] + la[:, None] - 1 - back, b[:, None] + lb[:, None] - 1 - back
    differ = open_ & (flat[np.where(open_, pa_, 0)] != flat[np.where(open_, pb, 0)])
    tail = np.where(differ.any(axis=1), differ.argmax(axis=1), rest) if differ.shape[1] else rest
    la, lb, a, b = la - head - tail, lb - head - tail, a + head, b + head
    return banded_edits(_rows(flat, a, la, -1), la, _rows(flat, b, lb, -2), lb, edits)


def _verify(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = ["grp", "bi", "bj"]
        for table in sorted_runs(batches, by):
            cuts = group_starts(table, by)
            name, block, bi, bj = (table[c].to_numpy() for c in ("name", "block", "bi", "bj"))
            group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            i, j = near_pairs(table["line"].to_pylist(), edits, group, np.where(bi == bj, -1, block))
            root = local_components(table.num_rows, i, j)
            off = np.flatnonzero(root != np.arange(table.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(name[off]), pa.array(name[root[off]])], names=["u", "v"])

    return run


def near_line_classes(seen: DataFrame, texts: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``node`` and ``component`` (both line names) of the lines that have a near-equal other line.

    ``seen`` holds the lines with their keys, ``texts`` (``text``) the documents they come from.
    """
    exploded = seen.where("keys is not null").select("name", F.posexplode("keys").alias("k", "key"))
    keyed = exploded.select("key", (F.col("name") + (F.col("k") <= edits).cast("long")).alias("item"))
    hot = hot_keys(keyed, "key", HOT_MEMBERS)
    dealt = (keyed.where(~F.col("key").isin(hot)) if hot else keyed).repartition("key").sortWithinPartitions("key", "item")
    shared = dealt.mapInArrow(lean(candidate_groups), "grp long, name long, hot boolean")
    if hot:  # members of a hot key meet in blocks only
        shared = shared.union(keyed.where(F.col("key").isin(hot)).select("key", F.expr("item & ~1L"), F.lit(True)))
    groups = materialize(shared.distinct(), "groups")
    lines = texts.mapInArrow(lean(_texts(key_bitmap(groups, "name"), min_chars)), "name long, line string").dropDuplicates(["name"])
    weights = groups.where("hot").groupBy("grp").agg(F.ceil(F.count("*") / F.lit(BLOCK_LINES)).cast("int").alias("nb"))
    cool = groups.where("not hot").select("grp", "name", F.lit(1).alias("nb"))
    sized = cool.union(groups.where("hot").join(weights, "grp").select("grp", "name", "nb"))
    held = sized.join(lines, "name").withColumn("block", F.pmod(F.xxhash64("name"), F.col("nb")).cast("int"))
    sides = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    sides = sides.select("grp", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "name", "line")
    by = ["grp", "bi", "bj"]
    near = sides.repartition(*by).sortWithinPartitions(*by).mapInArrow(lean(_verify(edits)), "u long, v long")
    out = connected_components(near)
    discard(groups)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of every row, with ``folio_kept_text`` and ``folio_removed`` (sorted line numbers, from 0).

    Input columns of these two names give way.
    """
    docs = docs.drop("folio_kept_text", "folio_removed")
    key, dk = F.xxhash64(F.col(id_col), F.col(text_col)), fresh("folio_dk", docs.columns)
    slim = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), key.alias("dk"), F.col(text_col).alias("text")).where("text is not null")
    seen = materialize(slim.mapInArrow(lean(_lines(edits, min_chars)), _LINES), "lines")
    classes = near_line_classes(seen, slim.select("text"), edits, min_chars)
    # Lines are counted by name before they meet their class: a line in half of all documents is one row by then.
    place = F.struct(F.col("id").isNull().alias("last"), "id", "dk", "no")
    lines = seen.groupBy("name").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    classed = lines.join(classes.withColumnRenamed("node", "name"), "name", "left").withColumn("cls", F.coalesce("component", "name"))
    repeated = materialize(classed.where("component is not null or n > 1").select("name", "n", "first", "cls"), "repeated")
    firsts = repeated.groupBy("cls").agg(F.sum("n").alias("all"), F.count("*").alias("names"), F.min("first").alias("least")).where("all > 1")
    stay = materialize(salted_join(repeated.select("name", "n", "cls"), firsts, "cls", F.col("name"), "names").select("name", "n", F.col("least.dk").alias("of"), F.col("least.no").alias("at")), "stay")
    discard(classes)
    discard(repeated)
    met = salted_join(seen.select("dk", "no", "name"), stay, "name", F.col("dk"), "n")
    gone = materialize(met.where("dk <> of or no <> at").groupBy("dk").agg(F.array_sort(F.collect_set("no")).alias("folio_removed")), "gone")
    discard(stay)
    discard(seen)

    @F.arrow_udf("string")
    def without(texts: pa.Array, removed: pa.Array) -> pa.Array:
        out = []
        for text, numbers in zip(texts, removed, strict=True):
            drop = set(numbers.as_py() or ())
            out.append(None if text.as_py() is None else "\n".join(line for k, line in enumerate(text.as_py().split("\n")) if k not in drop))
        return pa.array(out, pa.string())

    joined = docs.withColumn(dk, key).join(gone.withColumnRenamed("dk", dk).hint("merge"), dk, "left").drop(dk)  # grows with the documents: never broadcast
    changed = F.col("folio_removed").isNotNull()
    cut = without(F.when(changed, F.col(text_col)), F.col("folio_removed"))  # other texts stay in the JVM
    kept = F.when(changed, cut).otherwise(F.col(text_col))
    return joined.withColumn("folio_kept_text", kept).withColumn("folio_removed", F.coalesce("folio_removed", F.array().cast("array<int>")))
