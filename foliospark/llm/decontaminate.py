"""Benchmark decontamination with an FM-index per training shard.

Words are numbered by the benchmark's own vocabulary; any other word is 0 and
can never be inside a match.  A shard (a bounded run of one task's documents)
becomes one sequence over that alphabet, and its FM-index is the wavelet tree
of the Burrows-Wheeler transform with rank samples and sampled suffix
positions.  All test windows are searched backwards at once, occurrences are
located through the samples, and the spans are merged per document.

Stretches of known words that are shorter than the shortest window cannot hold
an occurrence and are left out of the index; nothing else is.

Cases: null and wordless texts have no words and no hits; wordless items have
no window; items that share a name are one item; items without a name count as
any other and share the name null; very long texts may exceed a shard, which then
holds that one text; an empty benchmark or document table
gives zero hits or no rows.  Rows are kept one to one, repeated ids included,
and the other columns pass through untouched.
"""

from __future__ import annotations

import itertools
import pickle
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm._common import binary_column, bounded_batches, discard, fresh, group_starts, in_bitmap, key_bitmap, lean, materialize, shared_dir, sorted_runs

#: Symbols of one index; bounds the memory of a task.
SHARD_SYMBOLS = 1_000_000
#: Every so manieth text position keeps its suffix position.
SAMPLE = 16
#: Bytes of benchmark text, about, whose windows a task holds at a time.
PART_BYTES = 8 << 20

#: Columns that the operator adds; input columns of these names give way.
ADDED = ("folio_words", "folio_spans", "folio_items")
SPANS = T.ArrayType(T.StructType().add("first", T.LongType()).add("last", T.LongType()))

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """ASCII-lower-cased words: runs of digits, letters and everything beyond ASCII."""
    return text.translate(_FOLD).split() if text else []


class WaveletTree:
    """Rank over a sequence of small integers: one bit row per level, most significant bit first."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.levels, self.n = levels, len(seq)
        self.ones, self.zeros = [], []
        now = seq
        for level in range(levels - 1, -1, -1):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(now) - bit.sum()))
            now = now[np.argsort(bit, kind="stable")]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before position i (a wavelet matrix walk)."""
        low = np.zeros_like(i)
        for k in range(self.levels):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            ones, z = self.ones[k], self.zeros[k]
            a, b = ones[low], ones[i]
            low, i = np.where(bit, z + a, low - a), np.where(bit, z + b, i - b)
        return i - low

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for k in range(self.levels):
            ones, z = self.ones[k], self.zeros[k]
            bit = ones[i + 1] - ones[i]
            out = out * 2 + bit
            i = np.where(bit == 1, z + ones[i], i - ones[i])
        return out


def suffix_order(seq: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the cyclic sequence sorted by their first ``depth`` symbols at least (prefix doubling), ties by position."""
    n = len(seq)
    rank, order, width = np.unique(seq, return_inverse=True)[1].astype(np.int64), None, 1
    while True:
        order = np.argsort(rank, kind="stable")
        if width >= depth:
            return order
        pair = rank * (n + 1) + np.roll(rank, -width)
        order = np.argsort(pair, kind="stable")
        s = pair[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.append(False, s[1:] != s[:-1]))
        width *= 2
        if rank[order[-1]] == n - 1:
            return order


class FMIndex:
    """Backward search over one shard.  ``seq`` starts with a 0 that never matches."""

    def __init__(self, seq: np.ndarray, symbols: int):
        n = len(seq)
        # A full suffix order: position n-1 and before differ at the unique end marker.
        ended = np.append(seq + 1, 0)
        order = suffix_order(ended, n + 1)
        self.n = n + 1
        bwt = ended[order - 1]
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(ended, minlength=symbols + 2))])
        self.tree = WaveletTree(bwt, max(1, int(symbols + 1).bit_length()))
        marked = order % SAMPLE == 0
        self.marked = np.concatenate([[0], np.cumsum(marked)])
        self.samples = order[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of equally long patterns (rows), by backward steps."""
        lo = np.zeros(len(patterns), dtype=np.int64)
        hi = np.full(len(patterns), self.n, dtype=np.int64)
        live = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, column].astype(np.int64) + 1
            base = self.counts[symbol]
            lo[live], hi[live] = base + self.tree.rank(symbol, lo[live]), base + self.tree.rank(symbol, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        empty = np.ones(len(patterns), dtype=bool)
        empty[live] = False
        hi[empty] = lo[empty]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk to the nearest sampled one."""
        at, steps, out = rows.astype(np.int64), np.zeros(len(rows), dtype=np.int64), np.empty(len(rows), dtype=np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = at[open_]
            hit = self.marked[here + 1] > self.marked[here]
            done = open_[hit]
            out[done] = self.samples[self.marked[at[done]]] + steps[done]
            open_ = open_[~hit]
            here = at[open_]
            symbol = self.tree.access(here)
            at[open_] = self.counts[symbol] + self.tree.rank(symbol, here)
            steps[open_] += 1
        return out


@dataclass(frozen=True)
class Phrases:
    """The test set: its vocabulary, and by length its distinct windows with the items that hold them.

    The owners of window k are ``owners[first[k]:first[k + 1]]``.
    """

    vocabulary: dict[bytes, int]
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    items: list[str | None]
    shortest: int


def phrases(items: list[tuple[str | None, bytes | None]], window: int) -> Phrases:
    """Windows of ``window`` words of every item; an item of fewer words is one window."""
    vocabulary: dict[bytes, int] = {}
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
    for k, (_, text) in enumerate(items):
        ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)], dtype=np.int32)
        if size := min(window, len(ids)):
            rows = np.lib.stride_tricks.sliding_window_view(ids, size)
            found[size].append((rows, np.full(len(rows), k, dtype=np.int32)))
    windows = {}
    for size, parts in found.items():
        rows, at = np.unique(np.concatenate([r for r, _ in parts]), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([at.ravel(), np.concatenate([o for _, o in parts])], axis=1), axis=0)
        windows[size] = rows, np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1)), pairs[:, 1].astype(np.int32)
    return Phrases(vocabulary, windows, [name for name, _ in items], min(windows, default=0))


def _hits(docs: list[np.ndarray], tests: Iterator[Phrases], symbols: int, shortest: int, local: dict[bytes, int] | None = None) -> list[tuple[list[tuple[int, int]], list[str | None]]]:
    """Per document of one shard: merged spans of hit words, and the items that occur.

    The index is built once, for all parts of the test set.  With ``local``, the
    numbers of the shard's own words, the windows of a part are numbered anew and
    those with a word that the shard lacks are left out.
    """
    parts, doc_of, word_of = [np.zeros(1, dtype=np.int64)], [np.full(1, -1)], [np.full(1, -1)]
    for d, ids in enumerate(docs):
        known = np.concatenate([[False], ids > 0, [False]])
        edge = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
        for a, b in edge[edge[:, 1] - edge[:, 0] >= shortest]:
            parts += [ids[a:b], np.zeros(1, dtype=np.int64)]
            doc_of.append(np.full(b - a + 1, d))
            word_of.append(np.append(np.arange(a, b), -1))
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    items: list[set[str | None]] = [set() for _ in docs]
    if len(parts) > 1:
        index = FMIndex(np.concatenate(parts), symbols)
        doc, word = np.concatenate(doc_of), np.concatenate(word_of)
        for test in tests:
            renumber = None if local is None else np.array([0, *(local.get(w, 0) for w in test.vocabulary)], dtype=np.int32)
            for size, (patterns, first, owners) in test.windows.items():
                asked = np.arange(len(patterns))
                if renumber is not None:
                    patterns = renumber[patterns]
                    asked = np.flatnonzero((patterns > 0).all(axis=1))
                    patterns = patterns[asked]
                if not len(asked):
                    continue
                lo, hi = index.search(patterns)
                found = np.flatnonzero(lo < hi)
                times = hi[found] - lo[found]
                rows = np.repeat(lo[found] - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(times.sum())
                for at, p in zip(index.locate(rows).tolist(), np.repeat(asked[found], times).tolist(), strict=True):
                    spans[doc[at]].append((int(word[at]), int(word[at]) + size))
                    items[doc[at]].update(test.items[k] for k in owners[first[p] : first[p + 1]])
            spans = [_merge(found) for found in spans]  # what one part finds is summed up before the next
    return [(_merge(s), _sorted(i)) for s, i in zip(spans, items, strict=True)]


def _sorted(names: set[str | None]) -> list[str | None]:
    return sorted(names, key=lambda name: (name is None, name or ""))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class _Known(dict):
    """Word numbers; 0 for a word that the benchmark lacks."""

    def __missing__(self, word: bytes) -> int:
        return 0


class _Numbered(dict):
    """Numbers of a shard's own words, given as they come; 0 for a word that the benchmark cannot have."""

    def __init__(self, bitmap: np.ndarray):
        super().__init__()
        self.bitmap, self.size = bitmap, 0

    def __missing__(self, word: bytes) -> int:
        number = 0
        if in_bitmap(self.bitmap, np.array([_hash(word)], dtype=np.int64))[0]:
            self.size += 1
            number = self.size
        self[word] = number
        return number


def _hash(word: bytes) -> int:
    return int.from_bytes(xxhash.xxh64_digest(word), "big", signed=True)


@dataclass(frozen=True)
class _Parts:
    """A test set in files of the shared folder, each of about ``PART_BYTES`` of text, and a bitmap of its words."""

    paths: list[str]
    root: str
    bitmap: np.ndarray
    shortest: int

    def load(self) -> Iterator[Phrases]:
        store, _ = pfs.FileSystem.from_uri(self.root)
        for path in self.paths:
            with store.open_input_stream(path) as source:
                yield pickle.loads(source.read())  # written by this operator


def _stored(items: DataFrame, parts: int, window: int) -> _Parts:
    """Makes the parts' windows in tasks and keeps them as files; the driver sees their names only."""
    spark = items.sparkSession
    root = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pfs.FileSystem.from_uri(root)
        for table in sorted_runs(batches, ["part"]):
            for a, b in itertools.pairwise(group_starts(table, ["part"])):
                rows = table.slice(a, b - a)
                test = phrases([(i, t.encode() if t is not None else None) for i, t in zip(rows["i"].to_pylist(), rows["t"].to_pylist(), strict=True)], window)
                path = f"{base}/{uuid.uuid4().hex}"
                store.create_dir(base, recursive=True)
                with store.open_output_stream(path) as out:
                    out.write(pickle.dumps(test))
                words = np.array([_hash(w) for w in test.vocabulary], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([path] + [None] * len(words)), pa.array([test.shortest] + [None] * len(words), pa.int64()), pa.array([None, *words.tolist()], pa.int64())], names=["path", "shortest", "word"])

    made = materialize(items.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(lean(make), "path string, shortest long, word long"), "windows-list")
    named = made.where("path is not null").select("path", "shortest").collect()
    bitmap = key_bitmap(made.where("word is not null"), "word")
    discard(made)
    return _Parts([r["path"] for r in named], root, bitmap, min((r["shortest"] for r in named if r["shortest"]), default=0))


def _scan(test: Phrases | _Parts, kept: list[str], work: str, cut: str | None = None):
    """Finds the windows of the benchmark in one pass over the texts.

    The column ``cut``, where given, becomes the text without the words inside windows.
    """
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def emit(rows: list[pa.RecordBatch], docs: list[np.ndarray], numbers: dict[bytes, int]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        found = _hits(docs, iter([test]), len(test.vocabulary), test.shortest) if isinstance(test, Phrases) else _hits(docs, test.load(), numbers.size, test.shortest, numbers)
        columns = [table[c].combine_chunks() for c in kept]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        if cut is not None and any(s for s, _ in found):
            whole = table[work].combine_chunks().to_pylist()
            left = [t if not s else cut_words(t, [{"first": a, "last": b - 1} for a, b in s]) for t, (s, _) in zip(whole, found, strict=True)]
            at = kept.index(cut)
            columns[at] = pa.array(left, columns[at].type)
        spans = pa.array([[{"first": a, "last": b - 1} for a, b in s] for s, _ in found], span_type)
        names = pa.array([i for _, i in found], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([*columns, pa.array([len(d) for d in docs], pa.int64()), spans, names], names=[*kept, "folio_words", "folio_spans", "folio_items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_numbers = lambda: _Known(test.vocabulary) if isinstance(test, Phrases) else _Numbered(test.bitmap)
        numbers, rows, docs, size = fresh_numbers(), [], [], 0
        for batch in batches:
            first = 0
            for k, text in enumerate(binary_column(batch, work)):
                words = words_of(text)
                docs.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)))
                size += len(words)
                if size >= SHARD_SYMBOLS:
                    yield emit([*rows, batch.slice(first, k + 1 - first)], docs, numbers)
                    rows, docs, size, first = [], [], 0, k + 1
                    numbers = numbers if isinstance(test, Phrases) else fresh_numbers()
            if first < batch.num_rows:
                rows.append(batch.slice(first))
        if docs:
            yield emit(rows, docs, numbers)

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: list[str] | None = None, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", cut: bool = False) -> DataFrame:
    """The columns ``keep`` (all, by default) of every row, with ``folio_words``, ``folio_spans`` and ``folio_items``.

    Spans are inclusive ranges of word numbers; items are the names, as text,
    of the benchmark items with an occurring window; items whose name is null
    are one null at the end.  With ``cut`` the text column, which has to be kept,
    loses the words of its spans in the same pass (as ``remove_spans`` does in another).

    Every task holds the windows of the benchmark, so its text is counted first.
    Beyond ``PART_BYTES`` it is dealt into parts of about that size, whose windows
    are made in tasks and kept in the shared folder: a task still reads its texts
    and builds its index once, numbers the words of its shard itself, and loads the
    parts in turn.
    """
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in ADDED]
    work = fresh("folio_text", kept)
    source = bounded_batches(docs).select(*kept, F.col(text_col).alias(work))
    added = T.StructType().add("folio_words", T.LongType()).add("folio_spans", SPANS).add("folio_items", T.ArrayType(T.StringType()))
    bytes_ = benchmark.agg(F.sum(F.octet_length(item_text_col).cast("long"))).first()[0] or 0
    parts = max(1, -(-bytes_ // PART_BYTES))
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t"), F.pmod(F.xxhash64(item_col, item_text_col), F.lit(parts)).alias("part"))
    if parts == 1:
        test = phrases([(r["i"], r["t"].encode() if r["t"] is not None else None) for r in items.collect()], window)
    else:
        test = _stored(items, parts, window)
    schema = T.StructType([*source.select(*kept).schema.fields, *added.fields])
    return source.mapInArrow(lean(_scan(test, kept, work, text_col if cut else None)), schema)


def remove_spans(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Cut the merged spans out of the text; a word takes its place in the original text, separators between hit words go too."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(text_col).to_pylist(), batch.column("folio_spans").to_pylist(), strict=True):
                out.append(cut_words(text, spans) if spans else text)
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, text_col, pa.array(out, batch.schema.field(at).type))

    return rows.mapInArrow(lean(cut), rows.schema)


def cut_words(text: str, spans: list[dict]) -> str:
    raw = text.encode()
    folded = np.frombuffer(raw.translate(_FOLD), dtype=np.uint8) != 32
    edge = np.concatenate([[False], folded, [False]])
    ends = np.flatnonzero(edge[1:] != edge[:-1]).reshape(-1, 2)
    keep, last = [], 0
    for span in spans:
        keep.append(raw[last : ends[span["first"]][0]])
        last = int(ends[span["last"]][1])
    return b"".join([*keep, raw[last:]]).decode()
