"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary pieces that end at each
character; dynamic programming carries, per character, the best score and the
number of pieces on the way - no pieces, no back-pointers.  Ties are settled as
the unigram model of the ``tokenizers`` library does: pieces are tried from the
earliest start on and only a strictly better score replaces one; a character that
no single-character piece covers scores the least score less 10; neighbouring
unknown characters are one piece, or their UTF-8 bytes where the vocabulary has
byte pieces.

Blanks become the word mark, which also starts the text.  Where no piece holds a
word mark after another character and all scores are whole numbers, words are
counted apart and repeated words are looked up.  Any other vocabulary is counted
over whole texts, by one running sum, as rounding decides ties there.

Cases: null and empty texts have no tokens and the score 0; texts of any length
are counted whole, with memory for the longest piece only; rows are kept one to
one, repeated ids included; an empty table gives an empty result.  Other columns
do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm._common import bounded_batches, lean, slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words remembered by a task.
CACHE = 200_000


class UnigramCounter:
    """Counts and scores of the best segmentation.  ``vocabulary`` maps pieces to scores."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        self.pieces = dict(vocabulary)
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in self.pieces for b in range(256))
        self.longest = max((len(p) for p in self.pieces), default=1)
        inner = {a for p in self.pieces if len(p) > 1 for a in p}
        # Words apart give the sums of the whole text only where sums are exact: with whole scores.
        self.apart = self.bytes and not any(MARK in p.lstrip(MARK) for p in self.pieces) and all(float(s).is_integer() for s in self.pieces.values())
        # A line break that no longer piece holds stands alone.
        self.words = re.compile(rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if "\n" not in inner else rf"{MARK}*[^{MARK}]+|{MARK}+")
        self.known = _Known(self.segment)

    def segment(self, text: str) -> tuple[float, int]:
        """Best score and number of pieces of a normalised text, by dynamic programming.

        Only the places within the longest piece are held, so memory does not grow with the text.
        """
        # Of each place: the score, the pieces on the way, and whether an unknown character ends there.
        score, count, unknown = [0.0], [0], False
        base, lowest, longest = 0, self.unknown, self.longest
        at, best, start, single = 1, None, 0, False
        # Matches come by their end, the longest first; the last one closes the text's last place.
        for end, (length, piece) in chain(self.automaton.iter(text), [(len(text), (0, 0.0))]):
            while at <= end:  # all matches that end at this place are known
                last = score[-1] + lowest
                if not single and (best is None or last > best):
                    score.append(last)
                    count.append(count[-1] + (len(text[at - 1].encode()) if self.bytes else not unknown))
                    unknown = True
                else:
                    score.append(best)
                    count.append(count[start] + 1)
                    unknown = False
                at, best, single = at + 1, None, False
                if len(score) > 1 << 16:
                    base += len(score) - longest
                    del score[:-longest], count[:-longest]
            candidate = score[at - length - base] + piece if length else best
            if length and (best is None or candidate > best):
                best, start = candidate, at - length - base
            single |= length == 1
        return score[-1], count[-1]

    def count(self, text: str | None) -> tuple[int, float]:
        """Number of tokens and score of a raw text."""
        if not text:
            return 0, 0.0
        plain = MARK + text.replace(" ", MARK)
        # Without byte pieces a run of unknown characters is one piece, also across words.
        if not self.apart:
            score, count = self.segment(plain)
            return count, score
        total = sum(map(self.known.__getitem__, self.words.findall(plain)), 0j)
        if len(self.known) > CACHE:
            self.known.clear()
        return int(total.real), total.imag


class _Known(dict):
    """Words met, with their pieces and score as one number."""

    def __init__(self, segment):
        super().__init__()
        self.segment = segment

    def __missing__(self, word: str) -> complex:
        score, count = self.segment(word)
        value = self[word] = complex(count, score)
        return value


def piece_vocabulary(path: str) -> list[tuple[str, float]]:
    """All pieces of a SentencePiece model file with their scores, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


@lru_cache
def _counter(path: str) -> UnigramCounter:
    return UnigramCounter(piece_vocabulary(path))


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id``, ``n_tokens``, ``score``.  The file is read by each worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary_path)
        for batch in slices(batches):
            found = [counter.count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([c for c, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=["id", "n_tokens", "score"])

    base = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(lean(run), "id long, n_tokens long, score double")
