"""Quality classifier: regularised quadratic discriminant analysis.

Every text gives a few statistics, each transformed towards a bell shape.  Per
class, mean and covariance are summed over all labelled rows in Spark; the
covariance is shrunk towards the pooled diagonal, factored once (Cholesky), and
a document's score is the logistic of the difference of the two Mahalanobis
log-densities plus the log-odds of the classes.

The driver sees sums: two classes times the square of the number of statistics.

Cases: null and empty texts give the statistics of an empty text and a score;
labels with a null id or null value do not count; several labels of an id count
as their rounded mean; ids labelled but absent do not matter.  With labels of
one class only the score is that class, without labels 0.5.  Rows are kept one
to one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm._common import binary_column, bounded_batches, in_bitmap, key_bitmap, lean, materialize, slices

#: Weight of the pooled diagonal in a class covariance.
SHRINKAGE = 0.15
#: Labelled rows that ``keep_good`` fits its model on, at most about; far more than the statistics need.
FIT_ROWS = 50_000
#: Log-densities are worth less than their face value as the statistics are not independent of one another and not quite normal.
TEMPERATURE = 2.0

_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_HIGH, _BLANK = bytes(range(128, 256)), b" \t\n\v\f\r"
_STOPS = b".,;:?'\"()-"
_MARKS = bytes(b for b in range(33, 127) if bytes([b]) not in [bytes([c]) for c in _UPPER + _LOWER + _DIGIT + _STOPS])

STATISTICS = ("log_words", "word_length", "upper", "digits", "marks", "stops", "distinct_words", "same_as_next", "distinct_triples", "repeated_lines", "line_length", "longest_word")


def statistics(raw: bytes | None) -> list[float]:
    """The transformed statistics of one text."""
    raw = raw or b""
    words = raw.split()
    n, chars = len(words), len(raw) - sum(map(raw.count, (b" ", b"\n", b"\t")))
    share = lambda chosen, whole: math.asin(math.sqrt(min(1.0, chosen / whole))) if whole > 0 else 0.0
    having = lambda kinds: len(raw) - len(raw.translate(None, kinds))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    return [
        math.log1p(n),
        math.log1p(chars / n) if n else 0.0,
        share(having(_UPPER), chars),
        share(having(_DIGIT), chars),
        share(having(_MARKS), chars),
        share(having(_STOPS), chars),
        math.log((len(set(words)) + 1) / (n + 1)) / math.log(n + 2),
        share(sum(map(bytes.__eq__, words, words[1:])), n),
        share(len(set(triples)), len(triples)) if triples else math.pi / 2,
        share(len(lines) - len(set(lines)), len(lines)),
        math.log1p(n / max(1, len(lines))),
        math.log1p(max(map(len, words), default=0)),
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [statistics(t) for t in binary_column(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(pa.float64()))], names=["id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class: count, sums and products of the statistics with a constant 1 put first."""
    d = len(STATISTICS) + 1
    total = np.zeros((2, d, d))
    for batch in batches:
        if batch.num_rows:
            x = np.hstack([np.ones((batch.num_rows, 1)), _matrix(batch.column("x"))])
            y = batch.column("y").to_numpy()
            for c in (0, 1):
                total[c] += x[y == c].T @ x[y == c]
    c, i, j = np.nonzero(np.ones_like(total, dtype=bool))
    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], names=["c", "i", "j", "s"])


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians with cached Cholesky factors, inverted once (they are small and shrunk, so well conditioned)."""

    means: np.ndarray
    factors: np.ndarray
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), 1 / (1 + math.exp(-self.log_odds)))
        density = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            z = factor @ (x - mean).T
            density.append(-0.5 * (z * z).sum(axis=0) + np.log(np.diag(factor)).sum())
        odds = (density[1] - density[0]) / TEMPERATURE + self.log_odds
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def discriminant(total: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant:
    """From the summed products of both classes."""
    n = total[:, 0, 0]
    if n.min() < 1:
        return Discriminant(np.empty(0), np.empty(0), 0.0 if n.max() < 1 else 50.0 * (1 if n[1] else -1))
    means = total[:, 0, 1:] / n[:, None]
    scatter = np.array([total[c, 1:, 1:] - n[c] * np.outer(means[c], means[c]) for c in (0, 1)])
    pooled = np.diag(np.diag(scatter.sum(axis=0)) / n.sum() + 1e-6)
    factors = np.array([np.linalg.inv(np.linalg.cholesky((1 - shrinkage) * scatter[c] / n[c] + shrinkage * pooled)) for c in (0, 1)])
    return Discriminant(means, factors, math.log(n[1] / n[0]))


def in_training(id_col: str):
    """Labels count only for ids whose crc32, as text, is not 2 modulo 4."""
    return F.crc32(F.col(id_col).cast("string")) % 4 != 2


def _fit(table: DataFrame, labels: DataFrame, id_col: str, label_col: str, shrinkage: float) -> Discriminant:
    """From the statistics (``id``, ``x``) of all rows and the labels that count."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & in_training(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    sums = table.join(known, "id").select("x", "y").mapInArrow(lean(_sums), "c int, i int, j int, s double")
    total = np.zeros((2, len(STATISTICS) + 1, len(STATISTICS) + 1))
    for r in sums.groupBy("c", "i", "j").agg(F.sum("s").alias("s")).collect():
        total[r["c"], r["i"], r["j"]] = r["s"]
    return discriminant(total, shrinkage)


def _statistics_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(lean(_features), "id long, x array<double>")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, shrinkage: float = SHRINKAGE) -> DataFrame:
    """One row per input row: ``id``, ``held_out``, ``score``, ``predicted``.

    Texts are read once: their statistics are kept and then fitted and scored.
    """
    table = materialize(_statistics_of(docs, id_col, text_col), "statistics")
    model = _fit(table, labels, id_col, label_col, shrinkage)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch.column("x"))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s)], names=["id", "score"])

    out = table.mapInArrow(lean(scored), "id long, score double")
    return out.select("id", F.coalesce(~in_training("id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, shrinkage: float = SHRINKAGE, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns.

    Rows are scored where they are, so ids need not be unique; no text is
    shuffled or written.  The model is fitted on the labelled rows, of which at
    most about ``fit_rows`` are taken, by a hash of the id; a bitmap of their ids
    spares the other texts the first pass, and a join decides.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & in_training(id_col))
    total = known.count()
    if total > fit_rows:
        known = known.where(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1 << 30)) < F.lit(int((1 << 30) * fit_rows / total)))
    marked = key_bitmap(known.select(F.xxhash64(F.col(id_col).cast("long")).alias("h")), "h")
    base = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long")).alias("h"), F.col(text_col).alias("text"))

    def of_labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            mine = batch.filter(pa.array(in_bitmap(marked, batch.column("h").to_numpy())))
            yield from _features(iter([mine]))

    model = _fit(base.mapInArrow(lean(of_labelled), "id long, x array<double>"), known, id_col, label_col, shrinkage)

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([statistics(t) for t in binary_column(batch, text_col)]).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(model.score(x) >= threshold)) if len(x) else batch

    return docs.mapInArrow(lean(accepted), docs.schema)
