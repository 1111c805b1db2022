"""Components of graphs: few edges are joined by one task, more of them in rounds, with the same result."""

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("foliospark.llm")
from test_llm_operators import union_find  # noqa: E402

from foliospark.llm import _common  # noqa: E402

RNG = np.random.default_rng(7)
PATH = RNG.permutation(400).tolist()
GRAPHS = {
    "path": list(zip(PATH[:-1], PATH[1:], strict=True)),
    "random": [(int(u), int(v)) for u, v in RNG.integers(-(2**62), 2**62, 300)[RNG.integers(0, 300, (250, 2))]],
    "star": [(7, k) for k in range(-100, 100)],
    "none": [(None, 3), (5, 5)],
}


def expected(edges):
    edges = [(u, v) for u, v in edges if None not in (u, v) and u != v]
    return union_find(sorted({x for e in edges for x in e}), edges)


def found(spark, edges):
    rows = _common.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()
    assert len({r["node"] for r in rows}) == len(rows)
    return {r["node"]: r["component"] for r in rows}


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("local", [0, 60, 1_000_000])
def test_rounds_and_one_task_agree(spark, monkeypatch, name, local):
    monkeypatch.setattr(_common, "LOCAL_EDGES", local)
    monkeypatch.setattr(_common, "FOREST_EDGES", 20)
    assert found(spark, GRAPHS[name]) == expected(GRAPHS[name])


def test_few_edges_take_no_rounds(spark, monkeypatch):
    """Every round is some ten stages whose broadcasts, plans and map outputs the driver holds."""
    written, write = [], _common.materialize
    monkeypatch.setattr(_common, "materialize", lambda df, name: written.append(name) or write(df, name))
    assert found(spark, GRAPHS["path"]) == expected(GRAPHS["path"])
    assert len(written) <= 2


def test_a_forest_spans_what_its_task_holds():
    edges = GRAPHS["path"] + GRAPHS["star"]
    batches = [pa.RecordBatch.from_pylist([{"u": u, "v": v} for u, v in edges[k : k + 10]], pa.schema([("u", pa.int64()), ("v", pa.int64())])) for k in range(0, len(edges), 10)]
    for most in (1, 25, 10_000):
        rows = [r for b in _common._forest(most)(iter(batches)) for r in b.to_pylist()]
        pairs = [(r["u"], r["v"]) for r in rows]
        assert union_find(sorted({x for e in edges for x in e}), pairs) == expected(edges)
        assert most < len(edges) or len(pairs) == len(expected(edges)) - len(set(expected(edges).values()))
