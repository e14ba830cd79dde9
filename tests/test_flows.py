"""Resumed runs, the metric store, reasoning traces, files below folders, reports."""

import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from spindrift.operators import report
from spindrift.plans import experiment, fixtures, steps, store
from spindrift.schemas import MERGED, MissingColumns
from spindrift.sources import files

SF = "/root/testdata/sf0.001"


def actions(outcomes):
    return {o.name: o.action for o in outcomes}


def test_steps_resume(spark, tmp_path):
    folder, made = f"file://{tmp_path}/run", []
    df = spark.range(10).withColumn("k", F.col("id") % 3)
    df.write.parquet(f"{folder}/in")
    read = lambda: {"in": spark.read.parquet(f"{folder}/in")}

    def step(name, needs, f, version="1"):
        def make(t):
            made.append(name)
            return f(t)

        return steps.Step(name, needs, make, version)

    def graph(fail=False, version="1"):
        def last(t):
            if fail:
                raise OSError("disk lost")
            return t["b"].join(t["a"], "k").groupBy("k").agg(F.sum("n").alias("s"))

        return [step("a", ("in",), lambda t: t["in"].groupBy("k").count()), step("b", ("in",), lambda t: t["in"].withColumn("n", F.col("id") * 2), version), step("c", ("a", "b"), last)]

    assert actions(steps.run_graph(spark, graph(), read(), folder, dry=True)[1]) == {"a": "run", "b": "run", "c": "run"} and not made
    with pytest.raises(steps.StepFailed) as e:
        steps.run_graph(spark, graph(fail=True), read(), folder)
    log = files.read_text(spark, steps.write_log(spark, folder, "run", e.value.outcomes, ["end"]))
    assert log == "a run 3 rows\nb run 10 rows\nc failed disk lost\nend\n"
    assert actions(e.value.outcomes) == {"a": "run", "b": "run", "c": "failed"} and "disk lost" in e.value.outcomes[2].error
    made.clear()
    tables, outcomes = steps.run_graph(spark, graph(), read(), folder)
    assert made == ["c"] and actions(outcomes) == {"a": "reused", "b": "reused", "c": "run"} and [o.rows for o in outcomes] == [3, 10, 3]
    assert {r["k"]: r["s"] for r in tables["c"].collect()} == {k: sum(2 * i for i in range(10) if i % 3 == k) for k in range(3)}
    # a result without its marker is made again
    place = next(p for p, *_ in files.files_below(spark, f"{folder}/b", "COMMITTED"))
    files.remove(spark, place)
    assert actions(steps.run_graph(spark, graph(), read(), folder, dry=True)[1]) == {"a": "reused", "b": "run", "c": "reused"}
    made.clear()
    steps.run_graph(spark, graph(), read(), folder)
    assert made == ["b"]
    # another version makes what needs it void, other inputs everything
    assert actions(steps.run_graph(spark, graph(version="2"), read(), folder, dry=True)[1]) == {"a": "reused", "b": "run", "c": "run"}
    made.clear()
    assert actions(steps.run_graph(spark, graph(), read(), folder, start="b")[1]) == {"a": "reused", "b": "run", "c": "run"}
    with pytest.raises(ValueError, match="before c has no result"):
        steps.run_graph(spark, graph(version="3"), read(), folder, start="c")
    df.limit(4).write.mode("overwrite").parquet(f"{folder}/in")
    assert set(actions(steps.run_graph(spark, graph(), read(), folder, dry=True)[1]).values()) == {"run"}
    with pytest.raises(ValueError, match="needs x"):
        steps.run_graph(spark, [step("a", ("x",), None)], read(), folder)
    with pytest.raises(ValueError, match="two steps"):
        steps.run_graph(spark, [step("in", (), None)], read(), folder)


def test_store_keeps_failures_and_skips(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    m = fixtures.merged(spark, SF).cache()
    one, other = (e for e, *_ in fixtures.EXPERIMENTS)
    of = lambda e: {(r["kind"], r["error"]) for r in store.read_store(spark, path).where(F.col("experiment") == e).collect()}
    whole = {("choice", None), ("distribution", None), ("logistic", None)}
    assert store.read_store(spark, path).count() == 0
    lacking = m.where(F.col("experiment") == other).where("probe_variant <> 'bare'")
    store.store_metrics(m.where(F.col("experiment") == one).unionByName(lacking), path)
    assert of(one) == whole and of(other) == {("failed", "no row without sources")}
    before = files.files_below(spark, f"{path}/experiment={one}")
    twice = m.where(F.col("experiment") == other).where("probe_variant in ('bare', 'upos')")
    store.store_metrics(m.where(F.col("experiment") == one).unionByName(twice.unionByName(twice)), path)
    assert of(other) == {("failed", "several rows of one question and variant")}
    assert files.files_below(spark, f"{path}/experiment={one}") == before  # skipped
    store.store_metrics(m, path)
    assert of(other) == whole and files.files_below(spark, f"{path}/experiment={one}") == before
    store.store_metrics(m.where(F.col("experiment") == one), path, skip_existing=False)
    assert of(one) == of(other) == whole and files.files_below(spark, f"{path}/experiment={one}") != before
    want = {(r["experiment"], r["metric"]): r["value"] for r in experiment.metrics(m).collect()}
    got = {(r["experiment"], r["metric"]): r["value"] for r in store.read_store(spark, path).collect()}
    assert got.keys() == want.keys() and all(got[k] == v or abs(got[k] - v) < 1e-9 for k, v in want.items() if v is not None)
    m.unpersist()


def test_reasoning(spark):
    q = spark.createDataFrame([("1", "q1", ["x", "y"], "A"), ("2", "q2", ["x", "y"], "B")], "qid string, question string, choices array<string>, gold string")
    names = spark.createDataFrame([("csqa__m_r__d1nu1nin__nocot",), ("csqa__m__d1nu1nin__nocot",)], "experiment string")
    said = q.select("qid", *(F.lit(c).alias(c) for c in ("t1_user_correct", "t1_doc_correct", "t1_user_wrong", "t1_doc_wrong", "t2_user_correct", "t2_doc_correct", "t2_user_wrong", "t2_doc_wrong")))
    variants = ["bare", "upos", "uneg", "dpos", "dneg", "dpup", "dpun", "dnup", "dnun"]
    traces = [("csqa__m_r__d1nu1nin__nocot", v, i, f"<think>{v}{i}</think>") for v in variants for i in ("1", "2")]
    frame = lambda rows: spark.createDataFrame(rows, "experiment string, probe_variant string, qid string, thinking_with_tags string").coalesce(1)
    out = {(r["experiment"], r["probe_variant"], r["qid"]): r for r in experiment.prompts(q, names, said, frame([(*traces[0][:3], "first"), *traces])).collect()}
    assert len(out) == 36
    r = out["csqa__m_r__d1nu1nin__nocot", "bare", "1"]
    assert r["scored_prompt"] == "Question: q1\n\nA. x\nB. y\n<think>bare1</think> Answer: " and r["user_prompt"] == "Question: q1\n\nA. x\nB. y\n"
    plain = out["csqa__m__d1nu1nin__nocot", "upos", "2"]
    assert plain["scored_prompt"] == plain["user_prompt"] == "t1_user_correct\n\nQuestion: q2\n\nA. x\nB. y\n\nAnswer: "
    for bad in (traces[1:], [(*traces[0][:3], ""), *traces[1:]], [(*traces[0][:3], None), *traces[1:]]):
        with pytest.raises(Exception, match="no reasoning for question 1 of bare"):
            experiment.prompts(q, names, said, frame(bad)).collect()


def test_complete_traces(spark):
    questions = spark.createDataFrame([("a",), ("b",)], "id string")
    traces = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", None), ("c", "z")], "qid string, thinking_with_tags string").coalesce(1)
    seen = Observation()
    assert {tuple(r) for r in files.complete_reasoning(traces, questions, seen).collect()} == {("a", ""), ("b", "y")}
    assert seen.get == {"questions": 2, "empty": 1}
    with pytest.raises(Exception, match="no reasoning for question b"):
        files.complete_reasoning(traces.where("qid <> 'b'"), questions).collect()


def test_files_below_folders(spark, tmp_path):
    folder = f"file://{tmp_path}/h"
    lines = lambda rows: "".join(json.dumps(r) + "\n" for r in rows)
    for name, text in (("b/x/samples_mmlu_pro_law_1.jsonl", lines([{"doc_id": 1, "acc": 1.0}, {"doc_id": 1, "exact_match": 0.5}])), ("a/samples_mmlu_pro_art_1.jsonl", lines([{"doc_id": 1}])), ("a/samples_other.jsonl", lines([{"doc_id": 9, "acc": 1.0}])), ("b/results_2.json", '{"acc,none": 0.25}'), ("b/x/results_1.json", "{}"), ("z/results.txt", "")):
        files.write_text(spark, f"{folder}/{name}", text)
    assert [p.rsplit("/h/", 1)[1] for p in files.sample_files(spark, folder, "samples_mmlu_pro")] == ["a/samples_mmlu_pro_art_1.jsonl", "b/x/samples_mmlu_pro_law_1.jsonl"]
    assert {tuple(r) for r in files.read_samples(spark, folder, prefix="samples_mmlu_pro").collect()} == {("art", 1, 0.0), ("law", 1, 0.5)}
    assert files.first_results(spark, folder) == {"acc,none": 0.25} and files.first_results(spark, f"{folder}/a") is None and files.first_results(spark, f"{folder}/none") is None
    files.write_text(spark, f"{folder}/b/results_2.json", '{"acc,none": 0.5}')
    assert files.preferred(files.first_results(spark, folder), ["acc,none"]) == 0.5
    assert [p for p, *_ in files.files_below(spark, f"{folder}/b", ".")] == []  # nothing is left beside


def test_compared_files_need_the_bare_variant(spark, tmp_path):
    folder = f"file://{tmp_path}/csqa__qwen3_8b__d1nu1nin__nocot"
    m = fixtures.merged(spark, SF).where("experiment like '%d1nu1n%'")
    files.write_lines(m.where("probe_variant = 'upos'").drop("experiment"), f"{folder}/merged_results.jsonl")
    with pytest.raises(files.NotFound):
        files.read_compared(spark, folder, MERGED)
    files.write_lines(m.select("qid", "canonical_wrong").distinct(), f"{folder}/canonical_wrong.jsonl")
    with pytest.raises(MissingColumns, match="variant bare"):
        files.read_compared(spark, folder, MERGED)


def test_interval_text(spark):
    rows = [(1.0, 0.5, 2.0), (1.0, None, 2.0), (1.0, float("nan"), 2.0), (None, 1.0, 2.0), (float("nan"), None, None), (-0.123456, -1.0, 0.0)]
    df = spark.createDataFrame(rows, "m double, l double, h double")
    assert [r[0] for r in df.select(report.interval_text(F.col("m"), F.col("l"), F.col("h"))).collect()] == ["1.0000 [0.5000, 2.0000]", "1.0000", "1.0000", "N/A", "N/A", "-0.1235 [-1.0000, 0.0000]"]


def test_wide_leaves_empty_columns_out(spark):
    long = spark.createDataFrame([("e", "a", 1.0), ("e", "b", None), ("f", "β.c", 2.0)], "experiment string, metric string, value double")
    out = report.wide(long, ["β.c", "b", "a", "x"])
    assert out.columns == ["experiment", "β.c", "a"] and {tuple(r) for r in out.collect()} == {("e", None, 1.0), ("f", 2.0, None)}
    assert report.wide(long, ["x"]).columns == ["experiment"] and report.wide(long, []).count() == 2


def test_lines_are_compressed(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "qid long, text string")
    files.write_lines(df, f"{tmp_path}/lines.jsonl")
    parts = [p for p in (tmp_path / "lines.jsonl").iterdir() if p.name.startswith("part-")]
    assert parts and all(p.name.endswith(".json.gz") for p in parts)
    assert sorted(files.read_lines(spark, f"{tmp_path}/lines.jsonl", "qid long, text string").collect()) == sorted(df.collect())


def test_no_task_of_the_merged_table_grows_with_the_questions(spark, monkeypatch):
    from spindrift.plans import fixtures

    monkeypatch.setattr(fixtures, "DEALT", 10)
    n = spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    assert fixtures.questions(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == -(-n // 10)
    merged = fixtures.merged(spark, "/root/testdata/sf0.001")
    assert merged.count() == 18 * n and merged.where("canonical_wrong = ''").isEmpty()
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan.split("Window")[0]  # nothing is shuffled after the window


def test_metric_store_computes_the_merged_table_once(spark, monkeypatch):
    from spindrift.plans import flows, store

    plans = []
    monkeypatch.setattr(store, "store_metrics", lambda m, path: plans.append(m._jdf.queryExecution().executedPlan().toString()))
    flows.metric_store(spark, "/root/testdata/sf0.001")
    assert len(plans) == 2 and not any("Window" in p for p in plans)
