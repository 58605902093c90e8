"""Recall of learned partitions against all cosines, exact scores and ties."""

import numpy as np
import pytest

from imgcurate.llm import learned_partitions
from imgcurate.llm.learned_partitions import balanced_parts, fit_router, nearest, neighbour_graph

SCHEMA = "vec_id long, embedding array<double>, score string"


def brute(rows, k=5):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = []
    for q, a in sorted(good):
        if q % 50 == 0:
            a = np.array(a)
            near = sorted((-float((a * b).sum() / np.sqrt((a * a).sum()) / np.sqrt((b * b).sum())), i) for i, b in ((i, np.array(b)) for i, b in good) if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near[:k])]
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA).repartition(6)
    found = nearest(df, df.where("vec_id % 50 = 0"))
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("cell", [60, 20_000])
def test_recall(spark, monkeypatch, cell):
    monkeypatch.setattr(learned_partitions, "CELL_ROWS", cell)
    monkeypatch.setattr(learned_partitions, "CELL_QUERIES", max(3, cell // 10))
    random = np.random.default_rng(2)
    centres = random.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.6 * random.normal(size=16)).tolist()) for i in range(2_000)]
    got, want = run(spark, rows), brute(rows)
    assert len(got) == len(want)
    pairs = lambda x: {(q, v) for q, _, v, _ in x}
    assert len(pairs(got) & pairs(want)) >= 0.9 * len(want)
    exact = {(q, v): s for q, _, v, s in want}
    assert all(abs(exact[q, v] - s) < 1e-12 for q, _, v, s in got if (q, v) in exact)


@pytest.mark.parametrize("scale", ["0.01", "0.1"])
def test_table(spark, scale):
    df = spark.read.parquet(f"/root/testdata/sf{scale}/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
    want = {(q, v) for q, _, v, _ in brute(rows)}
    got = {(r.query_id, r.vec_id) for r in nearest(df, df.where("vec_id % 50 = 0")).collect()}
    assert len(got & want) >= 0.9 * len(want)


@pytest.mark.parametrize("n", [300, 500, 3_000])
def test_routing_at_every_size(n):
    """Clustered vectors are routed to few parts, however few there are."""
    random = np.random.default_rng(5)
    x = random.normal(size=(12, 16))[np.arange(n) % 12] + 0.05 * random.normal(size=(n, 16))
    router = fit_router(x)
    parts = router.weights.shape[1]
    assert parts == min(32, n // 20)
    assert router.probes <= parts // 2


def test_ties_repeats_and_odd_vectors(spark):
    nan = float("nan")
    rows = [(i, [1.0, 2.0]) for i in range(0, 60)] + [(3, [1.0, 2.0])] * 40 + [(100, [1e200, 1e200]), (150, [1e-200, 0.0]), (7, [5.0, -1.0])]
    odd = [(None, [1.0, 2.0]), (200, None), (250, []), (300, [0.0, 0.0]), (350, [nan, 1.0]), (400, [None, 1.0]), (450, [1.0, 2.0, 3.0])]
    got = run(spark, rows + odd)
    ids = lambda q: [v for a, _, v, _ in got if a == q]
    assert ids(0) == [1, 2, 3, 4, 5] and ids(50) == [0, 1, 2, 3, 4]
    assert {q for q, *_ in got} == {0, 50, 100, 150}
    assert ids(150) == [7, 100, 0, 1, 2]
    assert run(spark, rows[:1]) == [] and run(spark, []) == []
    assert len(run(spark, rows[:3])) == 2


def test_parts_are_balanced():
    random = np.random.default_rng(1)
    x = random.normal(size=(900, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = neighbour_graph(x, 10)
    label = balanced_parts(graph, x, 8)
    assert np.bincount(label, minlength=8).max() <= np.ceil(1.1 * 900 / 8)
    assert (label[graph] == label[:, None]).mean() > 0.3
