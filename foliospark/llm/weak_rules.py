"""Quality rules as weak supervision.

Each rule votes for a text (1), against it (0) or abstains (-1).  The votes
of a text form a pattern; Spark counts the patterns, of which there are at most
three to the power of the rules, and expectation-maximisation over those counts
estimates each rule's vote probabilities in the two hidden classes.  The
posterior of a pattern replaces "all rules must pass".

Everything that touches rows is a DataFrame expression; the driver sees pattern
counts only, whatever the input.

Cases: a null text has no words; empty and blank texts fail the base rules;
rows are judged one by one, so repeats and null ids stay; an empty table gives
an empty result.  Work columns carry a prefix.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm._common import materialize

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: ASCII marks that running prose seldom holds; the symbols and a few more.
MARKS = SYMBOLS + "!+/=@[\\]^_`{}~"


def _stripped(c: Column, chars: str) -> Column:
    """The text without any of the characters."""
    return F.translate(c, chars, "")


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and, prefixed with ``folio_``: words, chars, symbols, dup_lines, repeat_words, lines, marks, upper."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = docs.withColumn("folio_w", F.array_remove(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), ""))
    # Lines with a word; a line's blanks need no full pass to be told.
    has_word = lambda line: F.ltrim(line, F.lit(BLANKS)) != ""
    two = one.withColumns(
        {
            "folio_words": F.size("folio_w").cast("long"),
            "folio_l": F.filter(F.split(text, "\n"), has_word),
            "folio_h": F.when(F.size("folio_w") < 3, F.array().cast("array<bigint>")).otherwise(
                F.transform(F.sequence(F.lit(0), F.size("folio_w") - 3), lambda i: F.xxhash64(F.get("folio_w", i), F.get("folio_w", i + 1), F.get("folio_w", i + 2)))
            ),
        }
    )
    # Windows in the order of their hash, with their places; only texts that repeat one are sorted.
    three = two.withColumn(
        "folio_s",
        F.when(F.size(F.array_distinct("folio_h")) < F.size("folio_h"), F.sort_array(F.transform("folio_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    same = lambda x, k: (F.get("folio_s", k - 1)["h"] == x["h"]) | (F.get("folio_s", k + 1)["h"] == x["h"])
    four = three.withColumn("folio_p", F.sort_array(F.transform(F.filter("folio_s", lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"])))
    # A repeated window covers three words, less what the one before it has covered.
    covered = F.aggregate(
        "folio_p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"), p.alias("at")),
        lambda a: a["n"],
    )
    upper = F.length(text) - F.length(_stripped(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    out = four.withColumns(
        {
            "folio_chars": F.length(_stripped(text, BLANKS)).cast("long"),
            "folio_symbols": (F.length(text) - F.length(_stripped(text, SYMBOLS))).cast("long"),
            "folio_lines": F.size("folio_l").cast("long"),
            "folio_dup_lines": (F.size("folio_l") - F.size(F.array_distinct("folio_l"))).cast("long"),
            "folio_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "folio_marks": (F.length(text) - F.length(_stripped(text, MARKS))).cast("long"),
            "folio_upper": upper.cast("long"),
        }
    )
    return out.drop("folio_w", "folio_l", "folio_h", "folio_s", "folio_p")


def _vote(against: Column, for_: Column) -> Column:
    return F.when(against, 0).when(for_, 1).otherwise(-1)


def default_votes() -> dict[str, Column]:
    """The rules, over the statistics of ``base_statistics``; bounds in hundredths."""
    words, chars, symbols = F.col("folio_words"), F.col("folio_chars"), F.col("folio_symbols")
    return {
        "length": _vote(words < 20, (words >= 50) & (words < 100_000)),
        "symbols": _vote(100 * symbols > 5 * chars, 100 * symbols <= chars),
        "marks": _vote(100 * F.col("folio_marks") > 5 * chars, 100 * F.col("folio_marks") <= chars),
        "dup_lines": _vote(100 * F.col("folio_dup_lines") > 30 * F.col("folio_lines"), 100 * F.col("folio_dup_lines") <= 5 * F.col("folio_lines")),
        "repeats": _vote(100 * F.col("folio_repeat_words") > 30 * words, 100 * F.col("folio_repeat_words") <= 10 * words),
        "word_length": _vote((chars < 2 * words) | (chars > 15 * words), (chars >= 3 * words) & (chars <= 9 * words)),
        "capitals": _vote(100 * F.col("folio_upper") > 30 * chars, 100 * F.col("folio_upper") <= 10 * chars),
    }


@dataclass(frozen=True)
class LabelModel:
    """Per rule: chances of voting against, for, and abstaining, in bad and in good texts; and the share of good texts."""

    votes: list[tuple[tuple[float, float, float], tuple[float, float, float]]]
    prior: float

    def posterior(self, pattern: tuple[int, ...]) -> float:
        good, bad = self.prior, 1 - self.prior
        for (of_bad, of_good), vote in zip(self.votes, pattern, strict=True):
            bad, good = bad * of_bad[vote], good * of_good[vote]
        return good / (good + bad)


#: A rule votes against at most this share of good texts: what makes a rule a rule, and tells the classes apart.
FALSE_ALARMS = 0.03
#: First belief about (against, for, abstain) in bad and in good texts, and its weight as a share of the rows.
BELIEF = ((0.5, 0.25, 0.25), (0.03, 0.87, 0.1))
BELIEF_WEIGHT = 0.02


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 200, tolerance: float = 1e-9) -> LabelModel:
    """Expectation-maximisation over counted vote patterns (vote -1 indexes abstaining).

    The belief enters as pseudo-counts, and votes against good texts are held
    at ``FALSE_ALARMS`` in every round.
    """
    if not patterns:
        return LabelModel([], 0.5)
    rules, total = len(next(iter(patterns))), sum(patterns.values())
    model = LabelModel([BELIEF] * rules, 0.9)
    for _ in range(rounds):
        good = {p: n * model.posterior(p) for p, n in patterns.items()}
        votes = []
        for r in range(rules):
            tables = []
            for belief, weights in zip(BELIEF, ({p: patterns[p] - g for p, g in good.items()}, good), strict=True):
                counts = [BELIEF_WEIGHT * total * x for x in belief]
                for p, w in weights.items():
                    counts[p[r]] += w
                tables.append([c / sum(counts) for c in counts])
            against = tables[1][0]
            if against > FALSE_ALARMS:
                tables[1] = [FALSE_ALARMS, *(c * (1 - FALSE_ALARMS) / (1 - against) for c in tables[1][1:])]
            votes.append((tuple(tables[0]), tuple(tables[1])))
        after = LabelModel(votes, (sum(good.values()) + 1) / (total + 2))
        moved = abs(after.prior - model.prior) + max(abs(x - y) for a, b in zip(after.votes, model.votes, strict=True) for s, t in zip(a, b, strict=True) for x, y in zip(s, t, strict=True))
        model = after
        if moved < tolerance:
            break
    return model


def judge(docs: DataFrame, text_col: str = "text", keep_columns: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """The columns ``keep_columns`` (all, by default) with the base statistics, ``folio_votes``, ``folio_posterior`` and ``folio_good``.

    Statistics are made once, written to the shared folder and read twice.
    """
    kept = list(keep_columns if keep_columns is not None else docs.columns)
    stats = base_statistics(docs.select(*kept, *([] if text_col in kept else [text_col])), text_col)
    if text_col not in kept:
        stats = stats.drop(text_col)
    rules = default_votes()
    voted = materialize(stats.withColumn("folio_votes", F.array(*(v.cast("int") for v in rules.values()))), "votes")
    counts = {tuple(r["folio_votes"]): r["n"] for r in voted.groupBy("folio_votes").agg(F.count("*").alias("n")).collect()}
    model = estimate(counts)
    # Log-odds are additive over the rules, so the posterior is a plain expression.
    odds = F.lit(log(model.prior / (1 - model.prior)))
    for r, (of_bad, of_good) in enumerate(model.votes):
        part = [log(g / b) for g, b in zip(of_good, of_bad, strict=True)]
        vote = F.get("folio_votes", F.lit(r))
        odds = odds + F.when(vote == 0, part[0]).when(vote == 1, part[1]).otherwise(part[2])
    scored = voted.withColumn("folio_posterior", 1 / (1 + F.exp(-odds)))
    return scored.withColumn("folio_good", F.col("folio_posterior") >= threshold)
