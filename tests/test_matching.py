"""Matching by joins against augmenting paths, on random and awkward graphs."""

import random

import pytest

from foliospark.operators import matching


def largest(edges):
    """The size of a maximum matching by plain augmenting paths."""
    options, mate = {}, {}
    for a, b in edges:
        options.setdefault(a, set()).add(b)

    def seek(a, tried):
        for b in options[a]:
            if b not in tried:
                tried.add(b)
                if b not in mate or seek(mate[b], tried):
                    mate[b] = a
                    return True
        return False

    return sum(seek(a, set()) for a in options)


def chain(n):
    """A path on which the even choice of every left is wrong."""
    return [(k, k) for k in range(n)] + [(k, k + 1) for k in range(n - 1)] + [(n, 0)]


GRAPHS = {
    "sparse": [(random.Random(k).randrange(60), random.Random(k + 999).randrange(50)) for k in range(70)],
    "dense": [(random.Random(3 * k).randrange(20), random.Random(7 * k + 1).randrange(15)) for k in range(80)],
    "chain": chain(5),
    "star": [(k, 0) for k in range(9)] + [(0, 1), (1, 2)],
    "twice": [(1, 1), (1, 1), (2, 1)],
}


@pytest.mark.parametrize("name", sorted(GRAPHS))
def test_by_joins_is_a_maximum(spark, monkeypatch, name):
    monkeypatch.setattr(matching, "TASK_EDGES", 0)
    edges = GRAPHS[name]
    found = [(r["left"], r["right"]) for r in matching.match(spark.createDataFrame([*edges, (None, 1), (1, None)], "left long, right long")).collect()]
    pairs = [p for p in found if p[1] is not None]
    assert sorted(a for a, _ in found) == sorted({a for a, _ in edges}) and set(pairs) <= set(edges)
    assert len({b for _, b in pairs}) == len(pairs) == largest(edges)


def test_large_and_small_components_together(spark, monkeypatch):
    monkeypatch.setattr(matching, "TASK_EDGES", 3)
    edges = [(1, 1), (1, 2), (2, 2), (3, 2), (10, 10), (11, 10), (20, 20)]
    found = matching.match(spark.createDataFrame(edges, "left long, right long")).collect()
    assert sorted(r["left"] for r in found) == [1, 2, 3, 10, 11, 20] and sum(r["right"] is not None for r in found) == largest(edges) == 4
    assert matching.match(spark.createDataFrame([], "left long, right long")).count() == 0
