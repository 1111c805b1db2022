"""N-gram Jaccard self-join by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes.  It is cut
into fragments; a document's set falls into one segment per fragment.

* Candidates: two sets with Jaccard similarity t differ in at most D n-grams,
  a bound that their sizes fix.  With D + 1 fragments at least one segment is
  the same in both, so equal segments (per size band) find every such pair.
  Keys that a shared passage makes equal by chance are weeded out on counts per
  fragment: their L1 distance never exceeds what differs between two sets, so
  leaders with a triangle bound join whatever may be linked, and little else.
* Verification: the order is cut into fragments of its own; the n-grams of the
  candidates are dealt by fragment, a task counts the partial overlaps of its
  fragment, and a second step sums them per pair and compares with the sizes.

Equal sets are collapsed first, so copies cost one representative.  Candidate
groups are never expanded into rows of pairs: a group of heavy total weight is
dealt into blocks, the partial overlaps of a pair of blocks in a fragment are
one row, and what leaves the sum is a spanning forest and link counts.  Keys and
classes that very many rows share are dealt over many tasks before any sees them.

Cases: null or blank texts, and texts without a word, have an empty set and no
links.  Texts of fewer words than ``n`` form one n-gram of the whole sequence.
Rows that share a document id stay rows of their own; a null id never becomes
a component's name.  An empty table gives an empty result.  Other columns of
the input do not matter.  Sets are compared by 64-bit hashes of their n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm._common import HOT_MEMBERS, binary_column, bounded_batches, connected_components, discard, group_starts, hot_keys, in_bitmap, key_bitmap, lean, local_components, materialize, mix64, salted_join, slices, sorted_runs

#: N-grams and classes in one verification block: they bound a task's memory, not the result.
BLOCK_WEIGHT, BLOCK_SETS = 1_000_000, 512
#: Classes in one block of a key that many share, and members up to which a key's group is named by its member set.
BLOCK_CLASSES, NAMED_GROUP = 2048, 512
#: Equal cuts of the hash order: partial overlaps are counted in each of them apart.
COUNT_FRAGMENTS = 8
#: Fresh orders tried when a fragment is empty, before emptiness itself is a key.
ROTATIONS = 8
WORD_CACHE = 100_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def ngram_set(words: list[bytes], n: int, cache: dict) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a document's n-grams."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(n, len(words))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def class_of(grams: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


@lru_cache
def size_bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower bounds of the size bands; fragments used for the pairs of bands (t-1, t); how many of them may be empty.

    A set's partner of at least that similarity lies in its own band or the
    next.  Linked sets touch at most D fragments with what differs, so of
    D + 1 + spare fragments spare + 1 are alike: one of them has n-grams if at
    most ``spare`` are empty.  The spare follows the share that chance leaves empty.
    """
    low = [1]
    while low[-1] < 1 << 40:
        low.append(low[-1] * 100 // percent + 1)
    top = np.array(low[1:] + [low[-1] * 2], dtype=object) - 1
    needed = [int(2 * t * (100 - percent) // (100 + percent)) + 1 for t in top]
    spare = [ceil(f * min(0.15, 1.6 * exp(-low[max(0, t - 1)] / f))) for t, f in enumerate(needed)]
    return np.array(low, dtype=np.int64), np.array(needed, dtype=np.int64) + spare, np.array(spare, dtype=np.int64)


def _fragment_of(h: np.ndarray, fragments: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)


def segment_keys(grams: np.ndarray, percent: int) -> np.ndarray:
    """Hashed (band, fragment, segment) keys of one set; linked sets share at least one."""
    low, fragments, spare = size_bands(percent)
    band = int(np.searchsorted(low, len(grams), side="right")) - 1
    keys = []
    for tag in (band, band + 1):
        count = int(fragments[tag])
        order = grams
        for rotation in range(ROTATIONS):
            if rotation:
                order = np.sort(mix64(grams + np.uint64(rotation)))
            of = _fragment_of(order, count)
            starts = np.append(True, of[1:] != of[:-1]).nonzero()[0]
            sums = np.add.reduceat(order, starts)
            keys.append(mix64(sums ^ mix64((of[starts] << np.uint64(20)) + np.uint64(tag * 64 + rotation))))
            if count - len(starts) <= spare[tag]:
                break
        else:
            empty = np.setdiff1d(np.arange(count, dtype=np.uint64), of)
            keys.append(mix64((empty << np.uint64(20)) + np.uint64(tag * 64 + ROTATIONS)))
    return np.concatenate(keys)


def fragment_counts(grams: np.ndarray) -> bytes:
    """N-grams per fragment of a cut whose fineness follows the set's size; counts stop at 255."""
    cuts = 1 << max(4, min(14, int(len(grams) // 4).bit_length()))
    return np.minimum(np.bincount(_fragment_of(grams, cuts).astype(np.int64), minlength=cuts), 255).astype(np.uint8).tobytes()


def _features(n: int, percent: int):
    """The one pass over the texts: size, name and counts of every set, and its segment keys once per task and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, met = _WordHash(), set()
        for batch in slices(batches):
            rows: list[tuple] = []
            first = held = 0
            for r, text in enumerate(binary_column(batch, "text")):
                grams = ngram_set(text.lower().split(), n, cache) if text else ()
                if len(grams):
                    name, keys = class_of(grams), None
                    if name not in met:
                        met.add(name)
                        keys = segment_keys(grams, percent).view(np.int64)
                        held += len(keys)
                    rows.append((len(grams), name, fragment_counts(grams), keys))
                else:
                    rows.append((0, None, None, None))
                if held > 200_000:
                    yield _rows(batch.slice(first, r + 1 - first), rows)
                    rows, first, held = [], r + 1, 0
            if rows:
                yield _rows(batch.slice(first), rows)
            if len(cache) > WORD_CACHE:
                cache.clear()
            if len(met) > WORD_CACHE:
                met.clear()

    return run


def _rows(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    size, name, counts, keys = zip(*rows, strict=True)
    lists = pa.array(keys, pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size, pa.int64()), pa.array(name, pa.int64()), pa.array(counts, pa.binary()), lists], names=["id", "n", "cls", "counts", "keys"])


def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a stream sorted by (key, item): the members of keys that several classes share.

    Small groups with the same members get one name; larger ones keep their key.
    """
    for table in sorted_runs(batches, ["key"]):
        key, item = table["key"].to_numpy(), table["item"].to_numpy()
        fresh = np.append(True, (key[1:] != key[:-1]) | (item[1:] != item[:-1]))
        key, item = key[fresh], item[fresh]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        several = size > 1
        if not several.any():
            continue
        item, start, size, key = item[np.repeat(several, size)], start[several], size[several], key[start[several]]
        at = np.append(0, np.cumsum(size))
        hot = size > NAMED_GROUP
        name = key.copy()
        for g in np.flatnonzero(~hot).tolist():
            name[g] = xxhash.xxh3_64_intdigest(item[at[g] : at[g + 1]].tobytes()) - (1 << 63)
        rows = np.unique(np.stack([np.repeat(name, size), item, np.repeat(hot, size)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(bool))], names=["grp", "cls", "hot"])


def leader_edges(sizes: np.ndarray, counts: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect every pair which may be linked, through leaders.

    An item within half of the bound of a leader needs no leader of its own;
    what is linked to it is within one and a half bounds of that leader.
    """
    cuts = min(map(len, counts))
    table = np.stack([np.frombuffer(c, dtype=np.uint8).reshape(cuts, -1).sum(axis=1, dtype=np.int32) for c in counts])
    share, most = (100 - percent) / (100 + percent), 100 / percent
    open_, us, vs = np.ones(len(sizes), dtype=bool), [], []
    while open_.any():
        leader = int(open_.argmax())
        far = np.abs(table - table[leader]).sum(axis=1)
        open_[(far <= share * (sizes + sizes[leader]) / 2) & open_] = False
        open_[leader] = False
        bound = share * (sizes * (most + 1) + (sizes * most + sizes[leader]) / 2)
        near = np.flatnonzero(far <= bound + 1)
        near = near[near != leader]
        us.append(near)
        vs.append(np.full(len(near), leader))
    return np.concatenate(us), np.concatenate(vs)


def _joined(root: np.ndarray, us: np.ndarray, vs: np.ndarray) -> np.ndarray:
    """``root`` (a pointer to a smaller member, or itself) after a few more edges."""
    for u, v in zip(us.tolist(), vs.tolist(), strict=True):
        while root[u] != u:
            u = root[u]
        while root[v] != v:
            v = root[v]
        root[max(u, v)] = min(u, v)
    return root


def _loose_edges(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = ["grp", "bi", "bj"]
        for table in sorted_runs(batches, by):
            cuts = group_starts(table, by)
            cls, size, counts = table["cls"].to_numpy(), table["n"].to_numpy(), table["counts"].to_pylist()
            names, node = np.unique(cls, return_inverse=True)
            root = np.arange(len(names))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                u, v = leader_edges(size[a:b], counts[a:b], percent)
                # Only what hangs together matters: at most one edge a class leaves the task.
                root = local_components(len(names), np.concatenate([np.arange(len(names)), node[a + u]]), np.concatenate([root, node[a + v]])) if b - a > 16 else _joined(root, node[a + u], node[a + v])
            off = np.flatnonzero(root != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[off]), pa.array(names[root[off]])], names=["u", "v"])

    return run


def partial_overlaps(values: np.ndarray, owner: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps of the sets of each group in one fragment: rows ``i`` < ``j`` and the n-grams both hold.

    ``values`` are n-grams, ``owner`` their rows, and ``group`` the group of each row.
    """
    order = np.lexsort((values, group[owner]))
    v, d = values[order], owner[order]
    g = group[d]
    begin = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (g[1:] != g[:-1]))) if len(v) else np.empty(0, dtype=np.int64)
    held_by = np.diff(np.append(begin, len(v)))
    rows, found = len(group), []
    for c in np.unique(held_by[(held_by > 1) & (held_by <= 24)]):
        members = np.sort(d[begin[held_by == c][:, None] + np.arange(c)], axis=1)
        i, j = np.triu_indices(int(c), 1)
        for lo in range(0, len(members), 20_000):
            flat = (members[lo : lo + 20_000, i].astype(np.int64) * rows + members[lo : lo + 20_000, j]).ravel()
            found.append(np.unique(flat, return_counts=True))
    wide = np.flatnonzero(held_by > 24)
    for k in np.unique(g[begin[wide]]) if len(wide) else ():
        base, sets = int(np.searchsorted(group, k)), int((group == k).sum())
        total = np.zeros((sets, sets), dtype=np.int64)
        mine = wide[g[begin[wide]] == k]
        step = max(1, 4_000_000 // sets)
        for lo in range(0, len(mine), step):
            chosen = mine[lo : lo + step]
            dense = np.zeros((sets, len(chosen)), dtype=np.float32)
            for col, run in enumerate(chosen):
                dense[d[begin[run] : begin[run] + held_by[run]] - base, col] = 1
            total += np.triu(dense @ dense.T, 1).astype(np.int64)
        i, j = np.nonzero(total)
        found.append(((i + base) * rows + j + base, total[i, j]))
    pair, shared = summed(found)
    return pair // rows, pair % rows, shared


def summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of several counts, and their counts' sums."""
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    pair, at = np.unique(np.concatenate([p for p, _ in found]).astype(np.int64), return_inverse=True)
    total = np.zeros(len(pair), dtype=np.int64)
    np.add.at(total, at, np.concatenate([c for _, c in found]).astype(np.int64))
    return pair, total


def _candidates(n: int, ids: np.ndarray, names: np.ndarray):
    """Class and n-grams, by fragment, of the rows that may represent a candidate class; the bitmaps only spare work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, met = _WordHash(), set()
        for batch in slices(batches):
            id_ = batch.column("id")
            maybe = in_bitmap(ids, mix64(id_.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)).view(np.int64)) | id_.is_null().to_numpy(zero_copy_only=False)
            cls, parts, held = [], [], 0
            for text in binary_column(batch.filter(pa.array(maybe)), "text"):
                grams = ngram_set(text.lower().split(), n, cache) if text else ()
                if not len(grams) or (name := class_of(grams)) in met or not in_bitmap(names, np.array([name]))[0]:
                    continue
                met.add(name)
                cuts = np.searchsorted(_fragment_of(grams, COUNT_FRAGMENTS), np.arange(1, COUNT_FRAGMENTS))
                cls.append(name)
                parts.append([p.tobytes() for p in np.split(grams, cuts)])
                held += len(grams)
                if held > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(parts, pa.list_(pa.binary()))], names=["cls", "parts"])
                    cls, parts, held = [], [], 0
            if cls:
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(parts, pa.list_(pa.binary()))], names=["cls", "parts"])
            if len(cache) > WORD_CACHE:
                cache.clear()
            if len(met) > WORD_CACHE:
                met.clear()

    return run


#: A pair's name holds the ranks of its classes in two of these many bits; blocks have far fewer classes.
RANK_BITS = 15
_PARTIAL = "comp long, bi int, bj int, fragment int, pair array<int>, shared array<int>"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by block pair, fragment and class: the partial overlaps of each block pair in each fragment.

    A pair is named by the ranks of its classes in the block pair, which are the same in every fragment.
    """
    by = ["comp", "bi", "bj", "fragment"]
    for table in sorted_runs(batches, by):
        cuts = group_starts(table, by)
        group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        parts = [np.frombuffer(p, dtype=np.uint64) for p in table["part"].to_pylist()]
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        block, across = table["block"].to_numpy(), (table["bi"].to_numpy() != table["bj"].to_numpy())
        i, j, shared = partial_overlaps(np.concatenate(parts), owner, group)
        wanted = ~across[i] | (block[i] != block[j])
        i, j, shared = i[wanted], j[wanted], shared[wanted]
        at = cuts[group[i]]
        if len(parts) and int(np.diff(cuts).max()) >> RANK_BITS:
            raise ValueError("a block holds more classes than a pair's name has room for")
        pair = ((i - at) << RANK_BITS) + (j - at)
        order = np.argsort(group[i], kind="stable")
        offsets = np.searchsorted(group[i][order], np.arange(len(cuts)))
        some = pa.array(np.flatnonzero(np.diff(offsets) > 0))
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(c[order].astype(np.int32))) for c in (pair, shared)]
        heads = [pa.array(table[c].to_numpy()[cuts[:-1]]) for c in by]
        yield pa.RecordBatch.from_arrays([*heads, *lists], names=[*by, "pair", "shared"]).take(some)


def _settle(percent: int):
    """From block pairs with their classes (fragment -1) and partial overlaps: links and a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = ["comp", "bi", "bj"]
        for table in sorted_runs(batches, by):
            cuts = group_starts(table, by)
            fragment = table["fragment"].to_numpy()
            cls, size, m, multi = (table[c].to_numpy() for c in ("cls", "n", "m", "multi"))
            pairs, counts = table["pair"], table["shared"]
            out: list[tuple] = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                k = a + int((fragment[a:b] < 0).sum())
                found = [(pairs[r].values.to_numpy(), counts[r].values.to_numpy()) for r in range(k, b)]
                pair, shared = summed(found)
                i, j = pair >> RANK_BITS, pair & ((1 << RANK_BITS) - 1)
                n, times = size[a:k], m[a:k]
                good = 100 * shared >= percent * (n[i] + n[j] - shared)
                i, j = i[good], j[good]
                links = np.zeros(k - a, dtype=np.int64)
                np.add.at(links, i, times[j])
                np.add.at(links, j, times[i])
                root = local_components(k - a, i, j)
                out.append((cls[a:k], cls[a:k][root], links, multi[a:k]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["u", "v", "links", "multi"])

    return run


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """One row per input row: ``id``, ``n_grams``, ``links`` (other rows linked), ``component``.

    ``component`` is the smallest id reachable by links (its own id for a row
    without links).  ``percent`` is the similarity bound in hundredths.
    """
    base = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialize(base.mapInArrow(lean(_features(n, percent)), "id long, n long, cls long, counts binary, keys array<long>"), "signatures")

    # Classes that share a segment and may be alike, joined loosely; only these are verified.
    keyed = signed.where("keys is not null").select(F.explode("keys").alias("key"), F.col("cls").alias("item"))
    hot = hot_keys(keyed, "key", HOT_MEMBERS)
    dealt = (keyed.where(~F.col("key").isin(hot)) if hot else keyed).repartition("key").sortWithinPartitions("key", "item")
    shared = dealt.mapInArrow(lean(shared_keys), "grp long, cls long, hot boolean")
    if hot:  # members of a hot key meet in blocks only
        shared = shared.union(keyed.where(F.col("key").isin(hot)).select("key", "item", F.lit(True)))
    groups = materialize(shared.distinct(), "groups")
    # The keys have done their work; the rest of the table is small.
    fat, signed = signed, materialize(signed.drop("keys"), "signatures")
    discard(fat)
    known = signed.where("cls is not null")
    classes = known.groupBy("cls").agg(F.min("id").alias("low"), F.count("*").alias("m"), F.min("n").alias("n"))
    weights = groups.where("hot").groupBy("grp").agg(F.ceil(F.count("*") / F.lit(BLOCK_CLASSES)).cast("int").alias("nb"))
    sized = groups.where("not hot").select("grp", "cls", F.lit(1).alias("nb")).union(groups.where("hot").join(weights, "grp").select("grp", "cls", "nb"))
    members = _block_pairs(sized.join(known.select("cls", "n", "counts").dropDuplicates(["cls"]), "cls")).select("grp", "bi", "bj", "cls", "n", "counts")
    by = ["grp", "bi", "bj"]
    loose = connected_components(members.repartition(*by).sortWithinPartitions(*by).mapInArrow(lean(_loose_edges(percent)), "u long, v long"))
    discard(groups)
    found = classes.join(loose.select(F.col("node").alias("cls"), F.col("component").alias("comp")), "cls")
    weights = found.groupBy("comp").agg(F.greatest(F.ceil(F.sum("n") / F.lit(BLOCK_WEIGHT)), F.ceil(F.count("*") / F.lit(BLOCK_SETS))).cast("int").alias("nb"))
    found = materialize(found.join(weights, "comp"), "found")
    discard(loose)

    # The order of n-grams is cut into fragments: a task counts the overlaps of a pair of blocks in one of them.
    sides = _block_pairs(found).select("comp", "bi", "bj", "block", "cls", "n", "m", (F.col("nb") > 1).alias("multi"))
    ids = key_bitmap(found.select("low").where("low is not null").mapInArrow(lean(_hash_ids), "h long"), "h")
    parts = base.where("text is not null").mapInArrow(lean(_candidates(n, ids, key_bitmap(found, "cls"))), "cls long, parts array<binary>").dropDuplicates(["cls"])
    postings = sides.join(parts, "cls").select("comp", "bi", "bj", F.posexplode("parts").alias("fragment", "part"), "cls", "block")
    by = ["comp", "bi", "bj", "fragment"]
    partial = postings.repartition(*by).sortWithinPartitions(*by, "cls").mapInArrow(lean(_count), _PARTIAL)

    # The partial overlaps of a pair, summed over the fragments, against the sizes of its sets.
    empty = F.lit(None).cast("array<int>")
    heads = sides.select("comp", "bi", "bj", F.lit(-1).alias("fragment"), "cls", "n", "m", "multi", empty.alias("pair"), empty.alias("shared"))
    zero = F.lit(0).cast("long")
    tails = partial.select("comp", "bi", "bj", "fragment", zero.alias("cls"), zero.alias("n"), zero.alias("m"), F.lit(False).alias("multi"), "pair", "shared")
    by = ["comp", "bi", "bj"]
    whole = heads.union(tails).repartition(*by).sortWithinPartitions(*by, "fragment", "cls")
    checked = materialize(whole.mapInArrow(lean(_settle(percent)), "u long, v long, links long, multi boolean"), "checked")

    links = checked.groupBy(F.col("u").alias("cls")).agg(F.sum("links").alias("links"))
    settled = checked.where("not multi").select(F.col("u").alias("cls"), F.col("v").alias("root"))
    across = checked.where("multi and u <> v").select("u", "v")
    joined = None
    if not across.isEmpty():
        joined = connected_components(across)
        settled = settled.union(joined.select(F.col("node").alias("cls"), F.col("component").alias("root")))
    rooted = found.select("cls", "low", "m").join(settled, "cls").join(links, "cls")  # all that was verified, without another pass over the signatures
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = rooted.join(lowest, "root").select("cls", "component", "links")
    facts = classes.select("cls", "low", "m").join(named, "cls", "left")
    facts = materialize(facts.select("cls", "m", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), F.coalesce("component", "low").alias("component")), "classes")
    discard(found)
    discard(checked)
    discard(joined)
    out = salted_join(signed.select("id", "n", "cls"), facts, "cls", F.col("id"), "m", "left")
    out = materialize(out.select("id", F.col("n").alias("n_grams"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("component", "id").alias("component")), "components")
    discard(signed)
    discard(facts)
    return out


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Deals the classes of a group into ``nb`` blocks, and each class to every pair of blocks it belongs to."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return dealt.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")})


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = mix64(batch.column("low").to_numpy(zero_copy_only=False).view(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h)], names=["h"])
