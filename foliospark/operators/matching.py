"""One-to-one assignment of required resources to notes: maximum bipartite matching.

Components of the candidate graph are matched apart: small ones each in a task,
large ones in phases of joins.  A phase grows alternating trees from all
unmatched lefts at once, level by level; every right and every matched left is in
one tree only, so that the paths of different trees share no vertex and are all
turned over together.  A phase that reaches no unmatched right ends the search:
what is matched then is a maximum.

Cases: null ends are left out; repeated edges count once; an empty table gives an
empty result; which of several maximum matchings comes out is not fixed for large
components, its size is.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import written


def components(edges: DataFrame) -> DataFrame:
    """``left``, ``right``, ``comp`` by least-label rounds until none changes; each is written to the shared folder."""
    now = edges.select("left", "right").distinct().withColumn("comp", F.col("left"))
    while True:
        low_r = now.groupBy("right").agg(F.min("comp").alias("c"))
        step = now.drop("comp").join(low_r, "right")
        low_l = step.groupBy("left").agg(F.min("c").alias("comp"))
        after = written(step.drop("c").join(low_l, "left"), "components")
        changed = after.join(now.withColumnRenamed("comp", "old"), ["left", "right"]).where("comp <> old")
        done = changed.isEmpty()
        now = after
        if done:
            return now


def match(edges: DataFrame) -> DataFrame:
    """``left``, ``right`` (null where no note is left over) of a maximum matching, by augmenting paths per component."""
    kinds = dict(edges.dtypes)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        options = {k: sorted(set(v)) for k, v in group.groupby("left")["right"]}
        taken: dict = {}

        def seek(node, tried: set) -> bool:
            stack = [(node, iter(options[node]))]
            way = []
            while stack:
                here, rest = stack[-1]
                for right in rest:
                    if right in tried:
                        continue
                    tried.add(right)
                    way.append((here, right))
                    if right not in taken:
                        for a, b in way:
                            taken[b] = a
                        return True
                    stack.append((taken[right], iter(options[taken[right]])))
                    break
                else:
                    stack.pop()
                    if way:
                        way.pop()
            return False

        for node in sorted(options):
            seek(node, set())
        back = {a: b for b, a in taken.items()}
        return pd.DataFrame({"left": sorted(options), "right": [back.get(k) for k in sorted(options)]}).astype({"right": "object"})

    found = components(edges.where("left is not null and right is not null"))
    sizes = written(found.groupBy("comp").agg(F.count("*").alias("n")), "sizes")
    small = found.join(sizes.where(F.col("n") <= TASK_EDGES).select("comp"), "comp", "left_semi")
    schema = f"left {kinds['left']}, right {kinds['right']}"
    matched = small.groupBy("comp").applyInPandas(one, schema)
    large = sizes.where(F.col("n") > TASK_EDGES).select("comp")
    if large.isEmpty():
        return matched
    return matched.unionByName(match_large(found.join(large, "comp", "left_semi").select("left", "right")))


#: Edges of a component up to which one task matches it.
TASK_EDGES = 200_000


def match_large(edges: DataFrame) -> DataFrame:
    """``left``, ``right`` (null where none is left over) of a maximum matching, by joins only."""
    edges = written(edges.where("left is not null and right is not null").select("left", "right").distinct(), "edges")
    lefts = edges.select("left").distinct()
    pairs = written(edges.limit(0), "pairs")
    while True:
        ends, levels = _grown(edges, lefts, pairs)
        if ends is None:
            return lefts.join(pairs, "left", "left").select("left", "right")
        turned = _turned(ends, levels, pairs)
        pairs = written(pairs.join(turned.select("left"), "left", "left_anti").unionByName(turned), "pairs")


def _grown(edges: DataFrame, lefts: DataFrame, pairs: DataFrame) -> tuple[DataFrame | None, list[DataFrame]]:
    """Alternating trees from all unmatched lefts: ``root`` and ``right`` where a tree meets an unmatched right, and the levels (``right``, ``left``, ``root``).

    A tree that has met one grows no further; the others go on until none grows.
    """
    front = lefts.join(pairs, "left", "left_anti").select("left", F.col("left").alias("root"))
    levels: list[DataFrame] = []
    ends = None
    while True:
        tried = front.join(edges, "left")
        for level in levels:
            tried = tried.join(level.select("right"), "right", "left_anti")
        # One parent for each right, spread by hash so that trees grow evenly.
        chosen = F.min_by(F.struct("left", "root"), F.xxhash64("left", "right")).alias("p")
        level = written(tried.groupBy("right").agg(chosen).select("right", "p.left", "p.root").join(pairs.withColumnRenamed("left", "mate"), "right", "left"), "level")
        if level.isEmpty():
            return ends, levels
        levels.append(level)
        met = level.where("mate is null").groupBy("root").agg(F.min("right").alias("right"))
        met = written(met.withColumn("depth", F.lit(len(levels) - 1)), "met")
        if not met.isEmpty():
            ends = met if ends is None else ends.unionByName(met)
        grown = level.where("mate is not null").select(F.col("mate").alias("left"), "root")
        front = grown if ends is None else grown.join(ends.select("root"), "root", "left_anti")


def _turned(ends: DataFrame, levels: list[DataFrame], pairs: DataFrame) -> DataFrame:
    """The new pairs of all paths, walked back level by level from their ends."""
    at, out = None, None
    for depth in range(len(levels) - 1, -1, -1):
        here = ends.where(F.col("depth") == depth).select("right")
        at = here if at is None else at.unionByName(here)
        step = written(at.join(levels[depth].select("right", "left"), "right"), "turned")
        out = step if out is None else out.unionByName(step)
        at = step.select("left").join(pairs, "left").select("right")  # the mate that its left gives up
    return written(out.select("left", "right"), "turned")
