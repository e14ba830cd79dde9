import random
from math import floor, inf, nan

import numpy as np

from spindrift.llm.whitening import decomposed, fit_whitening, identity_error, merged, op13_embedding_whitening, summary, whiten, whitened_components

VECTORS = "vec_id long, embedding array<float>, n string, x string, component int"


def check(rows, got, most=4):
    """Against one eigendecomposition of the covariance in integers."""
    kept = [(k, [floor(256 * float(np.float32(c))) for c in v]) for k, v, *_ in rows if v and None not in v and np.isfinite(np.float32(v)).all()]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    dims = len(sums)
    cov = np.array([[sum((n * f[i] - sums[i]) * (n * f[j] - sums[j]) for f in fit) / n**3 for j in range(dims)] for i in range(dims)])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    most = min(most, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == len(kept) * most
    want = sorted((k, sum((n * c - s) ** 2 for c, s in zip(x, sums)), c, x) for k, x in kept for c in range(most))
    by = sorted((r["vec_id"], r["deviation"], r["component"], r["whitened"], r["n"], r["explained"], r["identity_error"]) for r in got)
    signs = {}
    for r, (k, far, c, x) in zip(by, want, strict=True):
        assert (r[0], r[1], r[2] - 1, r[4]) == (k, far, c, n)
        exact = float((np.array(x) - np.array(sums) / n) @ v[:, c] / np.sqrt(e[c]))
        sign = signs.setdefault(c, np.sign(exact * r[3]) or 1)
        assert abs(sign * r[3] - exact) < 1e-6, (r, exact)
        assert abs(r[5] - e[c] / np.trace(cov)) < 1e-9 and r[6] < 1e-8


def test_merging_loses_nothing():
    draw = np.random.default_rng(1)
    x = (draw.normal(size=(300, 9)) * np.array([1e3, 500, 100, 50, 20, 10, 5, 2, 1]) + 1e4).astype(np.int64)
    cuts = [0, 1, 2, 7, 100, 101, 250, 300]
    parts = [summary(x[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    left = parts[0]
    for p in parts[1:]:
        left = merged(left, p)
    tree = merged(merged(merged(parts[0], parts[1]), merged(parts[2], parts[3])), merged(merged(parts[4], parts[5]), parts[6]))
    centred = x - x.mean(0)
    for s in (left, tree):
        assert s.n == 300 and s.sums == x.sum(0).tolist() and np.allclose(s.mean, x.mean(0), rtol=1e-14)
        assert np.allclose(s.scaled.T @ s.scaled, centred.T @ centred, rtol=1e-11, atol=1e-6)
        assert np.allclose(np.linalg.norm(s.scaled, axis=1), np.linalg.svd(centred)[1], rtol=1e-10)
    assert decomposed(np.zeros((4, 3))).shape == (0, 3) and merged(summary(x[:1]), summary(x[:1])).scaled.shape == (0, 9)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    vector = lambda: [rng.gauss(0.1 * i, 0.3 + 0.1 * i) for i in range(7)]
    rows = [(rng.choice([i, i, 3]), rng.choice([vector(), vector(), vector(), [0.5] * 7]), "clash", "clash", 9) for i in range(120)]
    rows += [(200, None, "", "", 0), (201, [None] * 7, "", "", 0), (202, [nan] + [0.0] * 6, "", "", 0), (203, [inf] + [0.0] * 6, "", "", 0), (204, [-0.0, 1e-40, -1e-40, 0.0, 0.0, 0.0, 0.0], "", "", 0), (205, [], "", "", 0)]
    rows += rows[:9]
    got = whitened_components(spark.createDataFrame(rows, VECTORS).repartition(20)).collect()
    check(rows, got)


def test_other_sizes_few_dimensions_and_empty_tables(spark):
    frame = lambda rows: spark.createDataFrame([(k, v, "", "", 0) for k, v in rows], VECTORS)
    assert whitened_components(frame([(1, [1.0, 2.0])])).collect() == []  # no variance
    assert whitened_components(frame([(1, [1.0, 2.0])]).limit(0)).collect() == []
    assert whitened_components(frame([(1, None)])).collect() == []
    flat = [(i, [float(i), 2.0 * i, 1.0]) for i in range(6)]
    got = whitened_components(frame([*flat, (9, [1.0]), (10, [3.0, 4.0])])).collect()
    check([(k, v) for k, v in flat], got)
    assert {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12
    assert [r["vec_id"] for r in whitened_components(frame([(None, [1.0]), (None, [2.0]), (4, [2.0])])).orderBy("vec_id").collect()] == [None, None, 4]


def test_huge_entries_are_exact(spark):
    rows = [(i, [x, y], "", "", 0) for i, (x, y) in enumerate([(1e16, 3.0), (3.1e15, 2e15), (-2e15, -1e16), (5.0, 5.0), (3e38, 1.0)])]  # the last is beyond a long
    got = whitened_components(spark.createDataFrame(rows, VECTORS)).collect()
    check(rows[:4], got)


def test_all_dimensions_are_whitened(spark):
    draw = np.random.default_rng(5)
    mix = draw.normal(size=(12, 12))
    x = [(draw.normal(size=12) @ mix * 50).astype(int).tolist() for _ in range(400)]
    fit = spark.createDataFrame([(v,) for v in x], "x array<long>").distinct().repartition(30)
    model = fit_whitening(fit)
    assert model.components.shape == (12, 12) and np.allclose(model.components @ model.components.T, np.eye(12), atol=1e-12)
    from pyspark.sql import functions as F

    assert identity_error(whiten(fit.withColumn("k", F.lit(1)), model, "k")) < 1e-10


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r)[:2] for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = op13_embedding_whitening(spark, folder)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check(rows, got.collect())
