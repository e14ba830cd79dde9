import glob
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import names, text
from spindrift.operators import canonical, choice, distribution, logit, merge, pairs, prep, sampling, scoring
from spindrift.plans import experiment, fixtures, registry
from spindrift.sources import files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    cell = lambda v: "~" if v is None or v != v else repr(round(float(v), 5) + 0.0) if isinstance(v, float) else str(v)
    return cols, sorted(tuple(map(cell, r)) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(duck.execute(registry.oracle_sql()[name]).df())


VALID = ["csqa__qwen3_8b__d1nu1nin__nocot", "gsm8k__qwen3_8br__u1wd2cid__cot", "csqa__llama3_2_1b_instruct__d2cu1wio__nocot"]
INVALID = ["", "a__b__c", "csqa__qwen3_8b__d1nu1nin", "cs qa__m__d1nu1nin__cot", "csqa__m-x__d1nu1nin__cot", "csqa__m__d1nd1nin__cot", "csqa__m__u1nu1nin__cot", "csqa__m__d3nu1nin__cot", "csqa__m__d1xu1nin__cot", "csqa__m__d1nu1nix__cot", "csqa__m__d1nu1n__cot", "csqa__m__d1nin__cot", "csqa__m__d1nu1nin__yes", "csqa__m__d1nu1nin__cot__x", "csqa____d1nu1nin__cot", "__m__d1nu1nin__cot"]


def test_names(spark):
    df = spark.createDataFrame([(n,) for n in VALID + INVALID], "experiment string")
    got = {r["experiment"]: r for r in df.withColumn("p", names.parsed(F.col("experiment"))).withColumn("b", names.built(F.col("p"))).collect()}
    assert all(got[n]["b"] == n for n in VALID) and all(got[n]["p"] is None for n in INVALID)
    assert got[VALID[1]]["p"]["reasoning_mode"] and got[VALID[1]]["p"]["model_key"] == "qwen3_8b"
    with pytest.raises(ValueError):
        names.expand_recipes(spark, [{"dataset": "a"}])


def test_canonical_wrong_edges(spark):
    p = lambda *v: [(chr(65 + i), "", x, 0.0) for i, x in enumerate(v)]
    data = [("tie", "A", ["x", "y", "z"], "A", p(0.4, 0.3, 0.3)), ("wrong", "A", ["x", "y", "z"], "C", p(0.1, 0.7, 0.2)), ("unk", "B", ["x", "y", "z"], "UNKNOWN", p(0.3, 0.3, 0.3)), ("words", "B", ["x", "y"], "Cannot parse answer", p(0.5, 0.5)), ("one", "A", ["x"], "A", p(1.0))]
    df = spark.createDataFrame(data, "qid string, gold string, choices array<string>, output_letter string, probs array<struct<letter:string,text:string,prob:double,logit:double>>")
    got = {r["qid"]: (r["canonical_wrong"], r["canonical_wrong_text"]) for r in canonical.canonical_wrong(df).collect()}
    import hashlib

    pick = ["A", "C"][int(hashlib.md5(b"unk").hexdigest()[:8], 16) % 2]
    assert got == {"tie": ("B", "y"), "wrong": ("C", "z"), "unk": (pick, {"A": "x", "C": "z"}[pick]), "words": ("A", "x"), "one": ("B", "")}


def test_choice_rates_add_up(spark):
    for r in choice.choice_metrics(fixtures.merged(spark, SF)).collect():
        if r["n_prior"]:
            assert abs(r["prior_bias"] + r["prior_correction"] + r["prior_neither"] - 1) < 1e-9
        if r["n_context"]:
            assert abs(r["context_bias"] + r["context_robustness"] + r["context_neither"] - 1) < 1e-9
        assert r["own_answer_rate"] + r["context_answer_rate"] <= 1 + 1e-9
        assert (r["n_prior"] == 0) == r["probe_variant"].endswith("neg") and (r["n_context"] == 0) == r["probe_variant"].endswith("pos")


def test_logit_against_row_level_fit(spark):
    m = fixtures.merged(spark, SF)
    exp = fixtures.EXPERIMENTS[0][0]
    f = logit.fit(m, exp)
    d = logit.design(m.where(F.col("experiment") == exp)).toPandas()
    x, y = d[logit.TERMS].to_numpy(float), d["y"].to_numpy(float)
    beta = np.zeros(6)
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ beta))
    s = np.array([(x[i] * (y[i] - p[i])[:, None]).sum(0) for i in d.groupby("qid").indices.values()])
    bread = np.linalg.inv(x.T @ (x * (p * (1 - p))[:, None]))
    g, n = len(s), len(y)
    cov = g / (g - 1) * (n - 1) / (n - 6) * bread @ s.T @ s @ bread
    assert f.converged and np.allclose(f.beta, beta, atol=1e-8) and np.allclose(f.cov, cov, atol=1e-8)
    assert abs(logit.statistics(f)["llf"] - (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()) < 1e-6
    assert not logit.fit(m.where("probe_variant = 'bare'"), exp).converged


def test_bootstrap(spark):
    v = np.arange(30) / 7
    mean, low, high, n = distribution.percentile_interval(v)
    draw = np.random.RandomState(42)
    found = [np.mean(draw.choice(v, size=30, replace=True)) for _ in range(1000)]
    assert (mean, low, high, n) == (v.mean(), np.percentile(found, 2.5), np.percentile(found, 97.5), 30)
    assert distribution.percentile_interval(v[:9])[1:] == (None, None, 9) and distribution.percentile_interval(v[:0]) == (None, None, None, 0)
    df = spark.createDataFrame([("a", f"{i:03}", float(x)) for i, x in enumerate(v)] + [("a", "x", float("nan")), ("b", "y", float("inf"))], "g string, qid string, value double")
    got = distribution.bootstrap_intervals(df, ["g"]).collect()
    assert len(got) == 1 and abs(got[0]["ci_low"] - low) < 1e-12
    rough = distribution.poisson_intervals(df.where("g = 'a'"), ["g"], "value", "qid").first()
    assert abs(rough["mean"] - mean) < 1e-9 and abs(rough["ci_low"] - low) < 0.2 and rough["n"] == 30


def test_poisson_intervals_do_not_depend_on_partitions(spark):
    df = spark.range(5_000).select(F.lit("a").alias("g"), F.col("id").alias("qid"), (F.hash("id") % 100).cast("double").alias("value"))
    one, many = (distribution.poisson_intervals(x, ["g"], "value", "qid").first() for x in (df.coalesce(1), df.repartition(7)))
    assert all(abs(one[c] - many[c]) < 1e-9 for c in ("mean", "ci_low", "ci_high")) and one["n"] == many["n"] == 5_000
    values = np.array([r["value"] for r in df.orderBy("qid").collect()])
    _, low, high, _ = distribution.percentile_interval(values)
    width = high - low
    assert abs(one["ci_low"] - low) < 0.1 * width and abs(one["ci_high"] - high) < 0.1 * width
    weights = distribution.poisson_weights(np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 2_000), 500)
    assert abs(weights.mean() - 1) < 0.01 and abs(weights.var() - 1) < 0.01


def test_weights():
    assert sampling.weights("bare_1") is None and sampling.weights("_".join(f"{v}_0" for v in sampling.SAMPLING_ORDER)) is None
    assert sampling.weights("_".join(f"{v}_2" for v in sampling.SAMPLING_ORDER))["dpup"] == 2 / 26 * 100


def test_pairs_strict(spark):
    base = spark.createDataFrame([(1, 1.0), (2, 0.5)], "doc_id long, score double")
    assert pairs.outcomes(pairs.paired(base, base, ["doc_id"]), []).first()["both_wrong"] == 1
    with pytest.raises(Exception, match="missing in the tuned model"):
        pairs.paired(base, base.where("doc_id = 1"), ["doc_id"], strict=True).collect()


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(text.completion_answer(F.lit("Apple, then B."))) == "B" and get(text.completion_answer(F.lit("A apple"))) == "A" and get(text.completion_answer(F.lit("none"))) == "UNKNOWN"
    assert get(text.thinking_text(F.lit("a</think>b</think>c"))) == "a</think>b</think>" and get(text.thinking_text(F.lit("x"))) == "x"
    assert get(text.letter_options(F.lit(1))) == "A" and get(text.letter_options(F.lit(3))) == "A, B or C"
    assert get(text.key_values(F.lit("USER: a: b\nDOC:  c "), ["user", "doc"])) == {"user": "a: b", "doc": "c"} and get(text.key_values(F.lit("USER: a"), ["user", "doc"])) is None
    assert scoring.api_letters([("The", [("The", -0.1), ("A", -2.0)])], 5) == ("E", [-2.0, -100.0, -100.0, -100.0, -0.1])


def test_files(spark, tmp_path):
    d = str(tmp_path)
    fixtures.merged(spark, SF).where("experiment like '%d1nu1n%'").drop("experiment").coalesce(1).write.json(f"{d}/exp/results.jsonl")
    from spindrift.schemas import MERGED, MissingColumns, require_columns

    assert files.results_path(spark, f"{d}/exp").endswith("results.jsonl")
    with pytest.raises(files.NotFound):
        files.results_path(spark, f"{d}/exp", fallback=False)
    assert files.read_merged(spark, f"{d}/exp", MERGED).select("experiment").distinct().count() == 1 and files.experiments(spark, d) == ["exp"]
    with pytest.raises(MissingColumns):
        require_columns(spark.range(1), "qid")
    files.write_document(spark, {"a": math.nan, "b": [1.0, math.inf]}, f"{d}/m.json")
    assert open(f"{d}/m.json").read().count("null") == 2
    old = spark.createDataFrame([("e1", 1.0)], "experiment string, v double")
    files.append_report(spark, old, f"{d}/r")
    files.append_report(spark, spark.createDataFrame([(2.0, "e1"), (3.0, "e2")], "v double, experiment string"), f"{d}/r")
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(f"{d}/r").collect()) == [("e1", "1.0"), ("e2", "3.0")]
    (tmp_path / "s.json").write_text('[{"question_id": "1", "t1_user_correct": "\\"x\\""}, {"question_id": "2", "sentences": {"t1_user_correct": "y"}}]')
    assert {r[0]: r[1] for r in files.read_sentences(spark, f"{d}/s.json").select("question_id", "t1_user_correct").collect()} == {"1": "x", "2": "y"}
    assert files.read_sentences(spark, f"{d}/none.json") is None
    assert files.read_yaml("a: [x, y]\nb: z  # c\nc:\n- 1x\n")["a"] == ["x", "y"]
    q = spark.createDataFrame([(" a  b", "r1", 1), ("a b", "r2", 2)], "question string, answer string, pos int")
    assert prep.attach_reasoning(q.select("question"), q).select("gold_reasoning").distinct().collect() == [("r2",)]


def test_stream(spark, tmp_path):
    from spindrift.streaming.incremental import results_stream, write_stream

    fixtures.questions(spark, SF).select("qid", "gold", "choices", "logits").write.json(f"{tmp_path}/in")
    write_stream(results_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == fixtures.questions(spark, SF).count()


def test_tiers(spark):
    from spindrift.operators import tiers

    q = spark.createDataFrame([(str(i), f"q{i}", f"right{i}", f"wrong{i}") for i in range(6)], "qid string, question string, correct_answer string, wrong_answer string")
    t1 = tiers.tier1(q)
    assert t1.where("t1_user_correct not like '%right%' or t1_doc_wrong not like '%wrong%'").count() == 0

    def writer():
        def answer(prompts):
            return ["nothing" if "q3" in p else "USER_CORRECT: {0}\nDOC_CORRECT: {0}\nUSER_WRONG: {1}\nDOC_WRONG: {1}".format(*(p.split(f"{k} answer: ")[1].split("\n")[0] for k in ("Correct", "Wrong"))) for p in prompts]

        return answer

    asked = q.withColumn("prompt", tiers.tier2_prompt(F.col("question"), F.col("correct_answer"), F.col("wrong_answer"), F.lit("u"), F.lit("d"))).drop("question")
    good, bad = tiers.tier2(asked, writer, attempts=2)
    assert good.count() == 5 and [tuple(r) for r in bad.select("qid", "error").collect()] == [("3", "fields missing")]
    assert tiers.sentences(t1, good).count() == 5


def test_errors_that_stop(spark):
    df = spark.createDataFrame([("csqa__qwen3_8b__d1nu1nin__nocot", "updn", "m1")], "experiment string, probe_variant string, model_key string")
    with pytest.raises(Exception, match="another order"):
        merge.source_order(df).collect()
    with pytest.raises(Exception, match="not configured"):
        names.with_model_id(df, {"m2": "x"}).collect()


def test_questions_and_tags(spark):
    df = spark.createDataFrame([(str(i), "csqa__m__u2nd2nin__nocot") for i in range(50)], "qid string, experiment string")
    picked = {r[0] for r in sampling.sample_questions(df, 20).collect()}
    assert len(picked) == 20 and sampling.sample_questions(df, 50).count() == 50 and sampling.sample_questions(df, 0).count() == 0
    assert sampling.selected(df, df.where("qid < '2'")).count() == 12
    assert sampling.tagged(df, "t2").select("tier", "tier_config", "sft_strategy").distinct().collect() == [("tier2", "u2nd2nin", "tier_t2")]


def test_splits_are_written_once(spark, tmp_path):
    df = spark.range(3)
    first = files.materialise({"train": df, "dev": df.limit(1)}, f"file://{tmp_path}")
    again = files.materialise({"train": spark.range(9), "dev": df}, f"file://{tmp_path}")
    assert first == again and spark.read.json(first["train"]).count() == 3


def test_finished_experiments_are_skipped(spark):
    merged = spark.createDataFrame([("a",), ("b",), ("c",)], "experiment string")
    have = spark.createDataFrame([("a", m) for m in experiment.METRIC_KINDS] + [("b", "choice")], "experiment string, metric string")
    assert sorted(r[0] for r in experiment.pending(merged, have).collect()) == ["b", "c"]


def test_odds_names_and_decimals(spark):
    m = fixtures.merged(spark, SF)
    found = logit.fits(m)
    assert set(found) == {e for e, _, _ in fixtures.EXPERIMENTS}
    table = {name: (ratio, low, high) for name, ratio, low, high in logit.odds_table(next(iter(found.values())))}
    assert set(table) == {*logit.ODDS_NAMES.values(), *logit.RATIO_NAMES.values()}
    assert all(v[0] == round(v[0], 3) for v in table.values()) and table["intercept"][1] is None and table["user_selectivity"][1] is not None
    metrics = {r["metric"] for r in experiment.metrics(m).select("metric").distinct().collect()}
    assert "odds_ratio_intercept_ci_lower" in metrics and any(x.startswith("choice_") for x in metrics)


def test_balanced_sample_with_equal_hashes(spark):
    """Rows of one question have one hash: the targets are met all the same."""
    weights = spark.createDataFrame([("bare", 0, 60.0), ("upos", 1, 40.0)], "probe_variant string, at int, pct double")
    pool = spark.createDataFrame([("t", v, str(i % 7)) for v in ("bare", "upos") for i in range(100)], "tier string, probe_variant string, qid string")
    for total in (0, 1, 37, 100):
        got = {r[0]: r[1] for r in sampling.balanced_sample(pool, weights, ["tier"], total=total).groupBy("probe_variant").count().collect()}
        assert got == {k: v for k, v in (("bare", int(0.6 * total)), ("upos", int(0.4 * total))) if v}


def test_poisson_intervals_of_many_groups(spark):
    """Groups that share questions, more than meet at once, with a null key, against the weights themselves."""
    rows = [(None if g == 3 else f"g{g}", q, float((g * 7 + q * q) % 23)) for g in range(70) for q in range(40) if (g + q) % 3]
    df = spark.createDataFrame(rows, "g string, qid int, value double").orderBy("qid").coalesce(1)
    got = {r["g"]: r for r in distribution.poisson_intervals(df, ["g"], "value", "qid", 50).collect()}
    bits = {r["qid"]: r["b"] for r in df.select("qid", F.xxhash64(F.lit(42), "qid").alias("b")).distinct().collect()}
    assert len(got) == 70
    for g, r in got.items():
        mine = [(q, v) for k, q, v in rows if k == g]
        weights = distribution.poisson_weights(np.array([bits[q] for q, _ in mine]), 50)
        found = weights @ np.array([v for _, v in mine]) / weights.sum(1)
        assert r["n"] == len(mine) and abs(r["mean"] - np.mean([v for _, v in mine])) < 1e-9
        assert np.allclose([r["ci_low"], r["ci_high"]], np.percentile(found, [2.5, 97.5]), atol=1e-9)
