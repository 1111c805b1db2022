"""Best-fit-decreasing packing of token sequences, with a segment tree over remaining capacities.

Best fit decreasing looks only at lengths, and lengths lie in 1..capacity.
So the plan is made from a histogram of ``capacity`` counts: a segment tree over
remaining capacities finds the tightest open bin in logarithmic time, and all
documents of a length that would go the same way go in one step.  The plan is
the very one that sequential best-fit-decreasing gives over the whole corpus,
its size does not depend on the number of documents, and documents are matched
to it by their rank among those of the same length - no task sees all rows.

Cases: a null text is an empty one and holds the end token alone; rows with
the same id are packed one by one; texts longer than the capacity are cut into
full pieces with a shorter first piece; an empty table packs into nothing.
Other columns of the input do not matter.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm._common import bounded_batches, lean, materialize, slices

END_TOKEN = 0


@lru_cache
def _tokenizers(path: str):
    """The tokenizer of the file, and a quicker reader of the same vocabulary and pattern where that exists."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    special = tuple(t.content for t in exact.get_added_tokens_decoder().values())
    return exact, special, _ranked(path)


def _ranked(path: str):
    """A ranked byte-pair encoder built from the file's own vocabulary, if the file is plain byte-level BPE."""
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
        return None
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
    return tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str) -> np.ndarray:
    """Token ids of a text without added special tokens."""
    exact, special, quick = _tokenizers(path)
    if quick is not None and not any(s in text for s in special):
        try:
            return quick.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)
        except BaseException as error:  # its regex engine gives up on vast runs of blanks, with a Rust panic
            if type(error).__name__ != "PanicException":  # a class of its own, below BaseException, that cannot be imported
                raise
    return np.array(exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in slices(batches):
            row, number, start, length, crc = [], [], [], [], []
            for r, text in enumerate(batch.column("text")):
                ids = np.append(encode(text.as_py() or "", path), np.uint32(END_TOKEN)).astype("<u4")
                first = len(ids) % capacity or capacity
                lows = [0, *range(first, len(ids), capacity)]
                for k, (a, b) in enumerate(zip(lows, [*lows[1:], len(ids)], strict=True)):
                    row.append(r), number.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(ids[a:b].tobytes()))
            lengths, rank = np.array(length, dtype=np.int64), np.empty(len(length), dtype=np.int64)
            order = np.argsort(lengths, kind="stable")
            if len(order):
                s = lengths[order]
                cut = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
                times = np.diff(np.append(cut, len(s)))
                rank[order] = np.arange(len(s)) - np.repeat(cut, times) + seen[s]
                seen[s[cut]] += times
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(row), part, dtype=np.int32)), batch.column("id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(rank)],
                names=["part", "id", "piece", "start", "length", "ids_crc32", "rank"],
            )

    return run


class CapacityTree:
    """A segment tree over remaining capacities 0..size that counts open bins."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += bins
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least ``need`` that an open bin has."""
        node = need + self.leaves
        if self.count[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node + (not self.count[2 * node])
                return node - self.leaves
            node >>= 1
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Where the documents of each length go.

    Returns moves, in order: the documents of ``length`` with ranks from
    ``rank`` on, ``per_bin`` into each of the bins from ``bin`` on, the first at ``offset``.
    """
    tree, open_bins, bins = CapacityTree(capacity), [deque() for _ in range(capacity + 1)], 0
    moves: list[tuple[int, int, int, int, int]] = []
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left, rank = histogram[length], 0

        def place(first: int, room: int, each: int, number: int, length=length) -> None:
            nonlocal left, rank
            moves.append((length, rank, each, first, capacity - room))
            left, rank = left - each * number, rank + each * number
            if rest := room - each * length:
                open_bins[rest].append((first, number))
                tree.add(rest, number)

        while left:
            room = tree.tightest(length)
            fresh = room is None
            if fresh:
                each = capacity // length
                first, number = bins, max(1, left // each)
                bins += number
                room = capacity
            else:
                each = room // length
                first, there = open_bins[room].popleft()
                number = min(there, max(1, left // each))
                tree.add(room, -there)
                if there > number:
                    open_bins[room].appendleft((first + number, there - number))
                    tree.add(room, there - number)
            place(first, room, min(each, left), number)
    columns = np.array(moves, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "per_bin", "bin", "offset"), columns, strict=True))


def _placed(plan: dict[str, np.ndarray], longest: int):
    code = plan["length"].astype(np.float64) * -1  # lengths fall, ranks rise: (-length, rank) is sorted
    begin = np.searchsorted(code, -np.arange(longest + 2, dtype=np.float64), side="left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            move = np.empty(len(length), dtype=np.int64)
            for n in np.unique(length):
                at, a = length == n, begin[n]
                b = np.searchsorted(code, -float(n), side="right")
                move[at] = a + np.searchsorted(plan["rank"][a:b], rank[at], side="right") - 1
            local = rank - plan["rank"][move]
            each = plan["per_bin"][move]
            rest = [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(plan["bin"][move] + local // each), pa.array(plan["offset"][move] + local % each * length)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    ``tokenizer`` is the path of a tokenizer file that every worker can read.
    At most ``capacity`` counts and the plan (at most the square of the
    capacity in moves, in practice a few thousand) pass through the driver.
    """
    base = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = "part int, id long, piece int, start long, length long, ids_crc32 long, rank long"
    pieces = materialize(base.mapInArrow(lean(_pieces(tokenizer, capacity)), schema), "pieces")
    # Ranks were counted per task; the tasks' counts of a length, summed up, make them global.
    counts = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit_plan(histogram, capacity)
    before = counts.selectExpr("part", "length", "sum(n) over (partition by length order by part rows between unbounded preceding and current row) - n as before")
    # The counts grow with the tasks, so they are never broadcast.
    ranked = pieces.join(before.hint("merge"), ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(lean(_placed(plan, capacity)), "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
