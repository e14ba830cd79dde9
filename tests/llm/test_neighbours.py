import random
from math import inf, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm.neighbours import best, build_index, fit_tree, nearest_neighbours, op11_nearest_neighbours, packed

VECTORS = "vec_id long, embedding array<float>, label int, rank string, _leaf string"


def sound(v):
    return v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)


def brute(rows, every, k):
    """{query: [(vec_id, score)]}: all candidates, by exact products."""
    of = {}
    for i, v, *_ in rows:
        if i is not None and sound(v):
            of.setdefault(i, []).append(np.array(v, np.float32).astype(np.float64))
    out = {}
    for q in (i for i in of if i % every == 0):
        all_ = [(-max(float((a * b).sum()) for a in of[q] for b in of[i]), i) for i in of if i != q]
        out[q] = [(i, -s) for s, i in sorted(all_)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def run(spark, rows, k=5, every=3, recall=1.0, **how):
    index = build_index(spark.createDataFrame(rows, VECTORS).repartition(4), "vec_id", "embedding", **how)
    return nearest_neighbours(index, index and index.rows.where(F.col("_key") % every == 0), k, recall)


def vectors(rng, n, dims, groups):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(groups)]
    return [[c + rng.gauss(0, 0.3) for c in rng.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("wide", [False, True])
def test_all_leaves_equal_brute_force(spark, wide, monkeypatch):
    """Ties, repeated rows, ids with several vectors, and rows that take no part; small parts and blocks too."""
    import spindrift.llm.neighbours as module

    if wide:
        monkeypatch.setattr(module, "LEAST_ROWS", 4)
        monkeypatch.setattr(module, "PART_ROWS", 6)
    rng = random.Random(1)
    rows = [(i, v, 0, "clash", "clash") for i, v in enumerate(vectors(rng, 150, 6, 5))]
    rows += [(200 + i, [0.5, -0.25, 1.0, 2.0, 0.0, 0.125], 0, "", "") for i in range(40)]  # equal vectors
    rows += rows[:30] + [(7, rows[20][1], 0, "", ""), (9, rows[21][1], 0, "", ""), (9, rows[22][1], 0, "", "")]
    rows += [(300, None, 0, "", ""), (303, [0.0] * 6, 0, "", ""), (306, [nan] * 6, 0, "", ""), (309, [1.0, inf, 0.0, 0.0, 0.0, 0.0], 0, "", ""), (312, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, "", ""), (315, [], 0, "", ""), (318, [1.0], 0, "", ""), (None, [1.0] * 6, 0, "", "")]
    want = brute([r for r in rows if r[0] != 318], 3, 5)
    # every leaf is visited
    monkeypatch.setattr(module, "calibrated", lambda index, *_: index.tree.leaves)
    got = found(run(spark, rows, fit_rows=100))
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)


def test_recall_is_calibrated(spark):
    rng = random.Random(2)
    rows = [(i, v, 0, "", "") for i, v in enumerate(vectors(rng, 3_000, 16, 40))]
    want = brute(rows, 20, 20)
    got = found(run(spark, rows, k=20, every=20, recall=0.95))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len(dict(got[q]).keys() & dict(want[q]).keys()) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    exact = {i: np.array(v, np.float32).astype(float) for i, v, *_ in rows}
    for q, all_ in got.items():
        assert [s for _, s in all_] == sorted((s for _, s in all_), reverse=True)
        assert all(abs(s - exact[q] @ exact[i]) < 1e-9 for i, s in all_)


def test_few_rows_and_empty_tables(spark):
    one = [(0, [1.0, 2.0], 0, "", "")]
    assert run(spark, one).collect() == []
    got = found(run(spark, one * 3 + [(1, [1.0, 0.0], 0, "", ""), (2, [1.0, 0.0], 0, "", ""), (4, [2.0, 0.0], 0, "", "")]))
    assert got == {0: [(4, 2.0), (1, 1.0), (2, 1.0)]}
    assert run(spark, [(0, None, 0, "", "")]) is None
    assert nearest_neighbours(None, None, 3) is None


def test_hot_vector_is_dealt_over_parts():
    assert packed([3, 3, 3, 20, 1, 0, 5], 6) == [(0, 1), (0, 1), (1, 1), (2, 4), (6, 1), (6, 1), (6, 1)]
    tree = fit_tree(np.vstack([np.ones((500, 3)), np.random.default_rng(1).normal(size=(400, 3))]))
    x = np.random.default_rng(2).normal(size=(200, 3))
    leaf = tree.assigned(x)
    assert tree.leaves > 10 and leaf.min() >= 0
    for outlook in tree.outlooks(x[:5]).tolist():
        assert sorted(tree.visits(outlook, 10**6)) == list(range(tree.leaves))
        assert tree.visits(outlook, 4) == tree.visits(outlook, 9)[:4]
    assert fit_tree(np.ones((100, 2))).leaves == 1


def test_products_beyond_a_double():
    with np.errstate(all="ignore"):
        x = np.array([[1e300, 0.0], [-1e300, 0.0], [1.0, 1.0], [1e300, -1e300]])
        got = list(best(np.array([9]), np.array([[1e300, 1e300]]), None, np.array([1, 2, 3, 4]), x, np.zeros(4, int), 3))
    (_, j, score), = got
    assert j.tolist()[0] == 0 and score[0] == inf and 3 not in j.tolist()


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    df = op11_nearest_neighbours(spark, folder)
    assert dict(df.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    got, want = found(df), brute(rows, 20, 20)
    assert got.keys() == want.keys()
    assert sum(len(dict(got[q]).keys() & dict(want[q]).keys()) for q in want) >= 0.9 * 20 * len(want)
