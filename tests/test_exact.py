"""What the seeded generators draw, made by distributed jobs, against the generators themselves."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import mersenne
from spindrift.operators import bootstrap, distribution, ranks, sampling


def test_first_draws_of_seeds():
    rng = random.Random(0)
    seeds = [0, 1, 2, 42, 2**31, 2**32 - 1, 2**32, 2**32 + 7, 2**63 + 5, 2**64 - 1] + [rng.randrange(2 ** rng.randrange(1, 64)) for _ in range(200)]
    made = mersenne.first_outputs(np.array(seeds, np.uint64), 227)
    for s, own in zip(seeds, made.T.tolist()):
        draw = random.Random(s)
        assert own == [draw.getrandbits(32) for _ in range(227)]
    sizes = [rng.choice([1, 2, 3, 5, 7, 8, 1000, 2**31 + 1, 2**32 - 1]) for _ in seeds]
    assert mersenne.first_below(np.array(seeds, np.uint64), np.array(sizes)).tolist() == [random.Random(s).randrange(n) for s, n in zip(seeds, sizes)]
    assert mersenne.first_below(np.zeros(0, np.uint64), np.zeros(0, np.int64)).tolist() == []


def test_states_ahead():
    assert mersenne.polynomial().bit_length() == mersenne.DEGREE + 1
    words = mersenne.start(42)
    for steps in (0, 1, 5, 623, 624, 30_000, 3_000_001):
        plain = mersenne.at(words)
        for _ in range(steps // 100_000):
            mersenne.outputs(plain, 100_000)
        mersenne.outputs(plain, steps % 100_000)
        assert mersenne.outputs(mersenne.at(mersenne.ahead(words, steps)), 2_000).tolist() == mersenne.outputs(plain, 2_000).tolist()
    a, b = mersenne.ahead(mersenne.ahead(words, 10**12), 7 * 10**11), mersenne.ahead(words, 17 * 10**11)
    assert mersenne.outputs(mersenne.at(a), 700).tolist() == mersenne.outputs(mersenne.at(b), 700).tolist()


def test_numbered_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "b", "b"]), rng.choice([None, *range(40)]), i) for i in range(1_000)]
    df = spark.createDataFrame(rows, "g string, o int, i int").repartition(9)
    got = ranks.numbered(df, ["g"], ["o"], "rank", "size").collect()
    assert sorted(r["i"] for r in got) == list(range(1_000))
    for g in (None, "a", "b"):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])
        order = [(r["o"] is not None, r["o"] or 0) for r in mine]
        assert [r["rank"] for r in mine] == list(range(len(mine))) and order == sorted(order) and {r["size"] for r in mine} == {len(mine)}
    assert ranks.numbered(df.limit(0), ["g"], ["o"]).count() == 0
    placed = ranks.with_position(df, ["i"]).repartition(5, "g")
    assert [(r["i"], r["pos"]) for r in ranks.restored(placed).collect()] == [(i, i) for i in range(1_000)]


def sorted_values(pairs):
    return [v for _, v in sorted(pairs) if np.isfinite(v)]


def check_intervals(rows, got, resamples=1000):
    want = {}
    for g, q, v in rows:
        want.setdefault(g, []).append((q, v))
    want = {g: distribution.percentile_interval(np.array(sorted_values(p)), resamples=resamples) for g, p in want.items() if sorted_values(p)}
    assert {r["g"] for r in got} == want.keys() and len(got) == len(want)
    for r in got:
        mean, low, high, n = want[r["g"]]
        assert r["n"] == n and abs(r["mean"] - mean) < 1e-12
        assert (r["ci_low"], r["ci_high"]) == (None, None) if low is None else abs(r["ci_low"] - low) < 1e-12 and abs(r["ci_high"] - high) < 1e-12


def groups(rng, sizes):
    return [(g, f"q{i:06}", rng.gauss(0, 1)) for g, n in sizes.items() for i in range(n)]


def test_intervals_equal_one_array(spark):
    """Equal sizes share their draws; sizes around the least, a null key, values that do not count."""
    rng = random.Random(2)
    rows = groups(rng, {"a": 30, "b": 30, "c": 9, "d": 10, "e": 64, "f": 65, "g": 1, None: 21})
    rows += [("a", "x", float("nan")), ("b", "y", float("inf")), ("h", "z", float("nan")), ("a", "w", None)]
    df = spark.createDataFrame(rows, "g string, qid string, value double").repartition(7)
    check_intervals([r for r in rows if r[2] is not None], distribution.bootstrap_intervals(df, ["g"]).collect())
    assert distribution.bootstrap_intervals(df.limit(0), ["g"]).collect() == []
    whole = distribution.bootstrap_intervals(df.where("g = 'e'"), []).collect()
    check_intervals([r for r in rows if r[0] == "e"], [{"g": "e", **r.asDict()} for r in whole])


@pytest.mark.parametrize("dense", [1 << 22, 100])
def test_intervals_in_blocks_and_chunks(spark, monkeypatch, dense):
    """Groups of many blocks, streams cut over many tasks, several groups' blocks in several slabs."""
    monkeypatch.setattr(bootstrap, "BLOCK", 64)
    monkeypatch.setattr(bootstrap, "GROUPS", 2)
    monkeypatch.setattr(bootstrap, "CHUNK", 5_000)
    monkeypatch.setattr(bootstrap, "PIECE", 700)
    monkeypatch.setattr(bootstrap, "DENSE", dense)
    rng = random.Random(3)
    rows = groups(rng, {"a": 257, "b": 257, "c": 257, "d": 257, "e": 257, "f": 400, "g": 64})
    df = spark.createDataFrame(rows, "g string, qid string, value double").repartition(5)
    with_forty = bootstrap.exact_intervals(df, ["g"], resamples=40).collect()
    check_intervals(rows, with_forty, 40)


def test_balanced_sample_as_the_generator_draws(spark):
    rng = random.Random(4)
    strategy = "_".join(f"{v}_{w}" for v, w in zip(sampling.SAMPLING_ORDER, [10, 5, 7, 0, 30, 1, 1, 2, 3, 4, 5, 6, 7]))
    weights = sampling.weights(strategy)
    pool = [(t, v, f"q{i:04}", "x") for t in ("t1", "t2") for k, v in enumerate(sampling.SAMPLING_ORDER) for i in range(rng.randrange(40, 60) + 10 * k)]
    df = spark.createDataFrame(pool, "tier string, probe_variant string, qid string, more string").repartition(6)
    got = {}
    for r in sampling.exact_sample(df, sampling.weight_table(spark, strategy), ["tier"]).collect():
        got.setdefault((r["tier"], r["probe_variant"]), {})[r["at"]] = r["qid"]
    want = {}
    for tier in ("t1", "t2"):
        ids = {v: sorted(q for t, w, q, _ in pool if (t, w) == (tier, v)) for v in sampling.SAMPLING_ORDER}
        total = min(int(len(q) / (weights[v] / 100)) for v, q in ids.items() if weights[v])
        for i, v in enumerate(sampling.SAMPLING_ORDER):
            if k := int(weights[v] / 100 * total):
                want[tier, v] = dict(enumerate(random.Random(42 + i).sample(ids[v], min(k, len(ids[v])))))
    assert got == want
    few = sampling.exact_sample(df, sampling.weight_table(spark, strategy), ["tier"], total=10_000).groupBy("tier", "probe_variant").count().collect()
    assert {(r[0], r[1]): r[2] for r in few}["t1", "bare"] == sum(t == "t1" and v == "bare" for t, v, *_ in pool)
    assert sampling.exact_sample(df.limit(0), sampling.weight_table(spark, strategy), ["tier"]).count() == 0


def test_splits_and_questions_as_the_generator_draws(spark):
    names = [f"b{i:03}" for i in range(40)]
    rows = [(random.Random(i).choice([*names, None]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int").repartition(4)
    order = sorted({g for g, _ in rows if g})
    random.Random(42).shuffle(order)
    train = set(order[: int(len(order) * 0.7)])
    got = sampling.exact_group_split(df, "g").collect()
    assert {r["i"]: r["split"] for r in got} == {i: "train" if g in train else "dev" for g, i in rows if g}
    shuffled = list(range(500))
    random.Random(7).shuffle(shuffled)
    got = {r["at"]: (r["i"], r["split"]) for r in sampling.exact_row_split(df, ["i"], 0.31, 7).collect()}
    assert got == {at: (i, "train" if at < int(500 * 0.31) else "dev") for at, i in enumerate(shuffled)}
    ids = df.select(F.concat(F.lit("q"), "i").alias("qid"))
    for n in (0, 3, 120, 499, 500, 900):
        want = random.Random(42).sample(sorted(f"q{i}" for i in range(500)), n) if n < 500 else [f"q{i}" for i in range(500)]
        assert sorted(r[0] for r in sampling.exact_questions(ids.union(ids), n).collect()) == sorted(want)
    assert sampling.exact_questions(ids.limit(0), 5).count() == 0 and sampling.exact_row_split(df.limit(0), ["i"]).count() == 0


def test_sentences_as_the_generator_draws(spark):
    """Ten thousand seeds, both tiers, all kinds, against one generator a draw."""
    from spindrift.functions import templates
    from spindrift.operators import tiers
    from spindrift.operators.prep import seeds

    def one(seed, tier, kind):
        user, doc, user_slots, doc_slots, words = templates.TIERS[tier]
        out, used = [random.Random(seed).choice(user), random.Random(seed + 1).choice(doc)], 2
        for at, slots in enumerate((user_slots, doc_slots)):
            made = out[at]
            for slot in slots:
                if f"{{{slot}}}" in out[at]:
                    made = made.replace(f"{{{slot}}}", random.Random(seed + used).choice(words[kind][slot]))
                    used += 1
            out[at] = made
        return tuple(out)

    rng = random.Random(6)
    some = [0, 1, 2**32 - 2, 2**32 - 1, 2**32, *(rng.randrange(2**32) for _ in range(9_995))]
    for tier, kind, n in ((1, "default", 10_000), (1, "math", 500), (1, "code", 500), (2, "default", 500), (2, "math", 500), (2, "code", 500)):
        user, doc = templates.drawn(np.array(some[:n], np.uint64), tier, kind)
        assert list(zip(user, doc)) == [one(s, tier, kind) for s in some[:n]]
    q = spark.createDataFrame([(str(i), "Right {x}", "WRONG") for i in range(30)] + [(None, "a", "b")], "qid string, correct_answer string, wrong_answer string").repartition(3)
    from spindrift.functions.text import md5_number

    for r in tiers.tier1_exact(q.withColumn("s", seeds(md5_number(F.col("qid")))["t1_seed"]), "code").collect():
        if r["qid"] is None:
            assert r["t1_user_correct"] is None and r["t1_doc_wrong"] is None
        else:
            user, doc = one(r["s"], 1, "code")
            assert (r["t1_user_correct"], r["t1_user_wrong"], r["t1_doc_correct"], r["t1_doc_wrong"]) == tuple(t.replace("{answer}", a) for t in (user, doc) for a in ("right {x}", "wrong"))


def rises(x, n, s, d, most=40):
    """Whether the likelihood only grows along a direction."""
    at = lambda t: sum(b * -np.logaddexp(0, -t * g) + (a - b) * -np.logaddexp(0, t * g) for a, b, g in zip(n, s, x @ d))
    values = [at(t) for t in range(most)]
    return all(b >= a - 1e-9 for a, b in zip(values, values[1:])) and values[-1] > values[0] + 1e-6


def test_separated_terms():
    from spindrift.operators.logit import separating_rays, states

    design = np.array([[1, p, *c] for p in (0, 1) for c in ((0, 0, 0, 0), (1, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 0), (0, 1, 0, 1), (1, 1, 0, 0), (1, 1, 1, 0), (1, 1, 0, 1), (1, 1, 1, 1))], float)
    n = np.full(18, 10.0)
    mixed = np.full(18, 4.0)
    assert states(design, n, mixed) == ["finite"] * 6
    told = np.where(design[:, 4] == 1, 10.0, 4.0)  # right after every right user
    assert states(design, n, told) == ["finite"] * 4 + ["separated", "finite"]
    known = np.where(design[:, 1] == 1, 10.0, 0.0)  # wrong and right as without sources
    assert states(design, n, known)[:2] == ["separated", "separated"]
    bare = design[:, 2:].sum(1) == 0
    assert states(design[bare], n[bare], np.array([0.0, 10.0])) == ["separated", "separated", *["unidentified"] * 4]
    assert states(design[bare], n[bare], np.array([3.0, 5.0])) == ["finite", "finite", *["unidentified"] * 4]
    quasi = np.where(design[:, 1] == 1, 10.0, 4.0)
    assert states(design, n, quasi) == ["finite", "separated", *["finite"] * 4]
    rng = np.random.default_rng(3)
    for _ in range(40):  # every ray improves the fit; without one no direction does
        some = rng.choice(18, rng.integers(2, 18), replace=False)
        x, size = design[some], np.full(len(some), 6.0)
        s = rng.choice([0.0, 3.0, 6.0], len(some), p=[0.45, 0.1, 0.45])
        rays = separating_rays(x, size, s)
        assert all(rises(x, size, s, d) for d in rays.T)
        if not rays.shape[1]:
            assert not any(rises(x, size, s, d, 8) for d in (*rng.normal(size=(60, 6)), *rng.integers(-1, 2, (60, 6))))


def test_states_name_why_a_fit_fails(spark):
    from spindrift.operators import logit
    from spindrift.plans import fixtures

    m = fixtures.merged(spark, "/root/testdata/sf0.001").where("experiment like '%d1nu1n%'")
    assert {s for *_, s in logit.term_states(m)} == {"finite"}
    bare = logit.term_states(m.where("probe_variant = 'bare'"))
    assert [s for *_, s in bare] == ["separated", "separated", *["unidentified"] * 4] and [t for _, t, _ in bare] == logit.TERMS


def broadcast_parts(df):
    """The parts of a plan that are sent whole to the driver and every task."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i:end])


def test_draws_are_not_broadcast(spark):
    counts = bootstrap.draw_counts(spark.createDataFrame([(20,)], "n long"), 10)
    values = spark.createDataFrame([("a", float(i), i, 20) for i in range(20)], "g string, value double, rank long, n long")
    sums = bootstrap.resample_sums(values, ["g"], counts, 10)
    jobs = spark.createDataFrame([("a", 20, 5, 42)], "g string, n long, k long, seed long")
    drawn = sampling.of_ranks(values.drop("n"), sampling.drawn_ranks(jobs, ["g"], "sample"), ["g"])
    for df in (sums, drawn):
        assert not any("MapInArrow" in part for part in broadcast_parts(df))
    assert sums.count() == 10 and drawn.count() == 5


def test_a_stream_is_cut_over_tasks(spark, monkeypatch):
    """Rows that name a stretch of a stream are few bytes; they must not be put into one task for that."""
    monkeypatch.setattr(bootstrap, "CHUNK", 5_000)
    counts = bootstrap.draw_counts(spark.createDataFrame([(257,)], "n long"), 40)
    assert len({r[0] for r in counts.select(F.spark_partition_id()).distinct().collect()}) > 1


def test_numbering_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(500).mapInArrow(count, "id long")
    assert ranks.numbered(df, [], ["id"]).count() == 500 and seen.value == 500
