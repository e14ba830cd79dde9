"""Registered queries of whole flows: resumed runs, the metric store, reasoning in prompts, order, files, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import canonical, choice, distribution, merge, pairs, ranks, report
from spindrift.plans import experiment as whole
from spindrift.plans import fixtures, steps, store
from spindrift.plans.registry import query, read
from spindrift.plans.sql import BASE, SHIFT, SINGLE
from spindrift.schemas import MERGED
from spindrift.session import shared_folder, written
from spindrift.sources import files


def _folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/spindrift-{tag}-{uuid.uuid4().hex}"


# -- runs that go on ------------------------------------------------------------------------


def experiment_steps(spark: SparkSession) -> list[steps.Step]:
    """From the questions' table to accuracies, as steps of a graph."""

    return [
        steps.Step("questions", ("part",), lambda t: fixtures.questions_of(t["part"])),
        steps.Step("bare", ("questions",), lambda t: fixtures.probe_results(t["questions"])),
        steps.Step("canonical", ("bare",), lambda t: canonical.canonical_wrong(t["bare"]).select("qid", "canonical_wrong").join(F.broadcast(fixtures.experiments(spark).select("experiment")))),  # two rows
        steps.Step("probes", ("questions", "canonical"), lambda t: fixtures.probes_of(spark, t["questions"], t["canonical"].select("qid", "canonical_wrong").distinct())),
        steps.Step("merged", ("probes", "canonical"), lambda t: merge.merge_results(t["probes"], t["canonical"])),
        steps.Step("accuracy", ("merged",), lambda t: choice.accuracy(t["merged"])),
    ]


@query(BASE + """, sizes(step, place, first, rows) AS (SELECT 'questions', 1, 'run', count(*) FROM q UNION ALL SELECT 'bare', 2, 'run', count(*) FROM q UNION ALL SELECT 'canonical', 3, 'run', 2 * count(*) FROM q
UNION ALL SELECT 'probes', 4, 'run', count(*) FROM m UNION ALL SELECT 'merged', 5, 'failed', count(*) FROM m UNION ALL SELECT 'accuracy', 6, 'left', count(DISTINCT (experiment, probe_variant)) FROM m)
SELECT step, first, CASE WHEN place < 5 THEN 'reused' ELSE 'run' END AS resumed, CASE WHEN place < 4 THEN 'reused' ELSE 'run' END AS restarted, rows FROM sizes""")
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that is lost while a step writes, what a second one still does, and one started from a step."""
    graph, inputs, folder = experiment_steps(spark), {"part": read(spark, sf_dir, "part")}, _folder(spark, "run")

    def lost(tables: dict[str, DataFrame]) -> DataFrame:
        half = merge.merge_results(tables["probes"], tables["canonical"])
        return half.withColumn("experiment", F.when(F.col("probe_variant") == "dneg", F.raise_error(F.lit("executor lost")).cast("string")).otherwise(F.col("experiment")))

    broken = [steps.Step(s.name, s.needs, lost, s.version) if s.name == "merged" else s for s in graph]
    try:
        first = steps.run_graph(spark, broken, inputs, folder)[1]
    except steps.StepFailed as e:
        first = e.outcomes
    _, second = steps.run_graph(spark, graph, inputs, folder)
    _, third = steps.run_graph(spark, graph, inputs, folder, start="probes")
    rows = [(a.name, a.action, b.action, c.action, c.rows) for a, b, c in zip(first, second, third, strict=True)]
    return spark.createDataFrame(rows, "step string, first string, resumed string, restarted string, rows long")


_BROKEN = "csqa__qwen3_8b__d2nu2nin__nocot"


@query(SINGLE + ", lm AS (" + " UNION ALL ".join(f"SELECT experiment, 'choice' AS kind, {m} AS v FROM cm" for m in choice.METRICS) + f"""), {SHIFT.split(BASE)[1].lstrip().removeprefix(',').strip()},
mm AS (SELECT experiment, probe_variant, {', '.join(f'avg({m}) AS {m}' for m in distribution.SHIFTS)} FROM sh GROUP BY experiment, probe_variant),
ld AS ({' UNION ALL '.join(f"SELECT experiment, 'distribution' AS kind, {m} AS v FROM mm" for m in distribution.SHIFTS)}),
al AS (SELECT * FROM lm UNION ALL SELECT * FROM ld)
SELECT experiment, kind, count(v) AS metrics, round(sum(v), 5) AS total, NULL::VARCHAR AS error FROM al GROUP BY experiment, kind UNION ALL SELECT '{_BROKEN}', 'failed', 0, NULL, 'no row without sources'""")
def metric_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One experiment stored, then all of three, of which one can't be computed; sums by kind (the regression's have
    queries of their own)."""
    m, path = written(fixtures.merged(spark, sf_dir), "merged"), _folder(spark, "store")  # read three times
    store.store_metrics(m.where("experiment like '%d1nu1n%'"), path)
    broken = m.where("experiment like '%d1nu1n%' and probe_variant <> 'bare'").withColumn("experiment", F.lit(_BROKEN))
    store.store_metrics(m.unionByName(broken), path)
    found = store.read_store(spark, path).where("kind <> 'logistic'")
    out = found.groupBy("experiment", "kind").agg(F.count("value").alias("metrics"), F.sum("value").alias("total"), F.max("error").alias("error"))
    return out.withColumn("total", F.round("total", 5))


# -- prompts --------------------------------------------------------------------------------


@query(BASE + """, src AS (SELECT * FROM m WHERE experiment LIKE '%d1nu1n%'),
told AS (SELECT probe_variant, qid, question, concept, k, CASE WHEN user_present AND doc_present THEN d || chr(10) || u WHEN user_present THEN u WHEN doc_present THEN d END AS said FROM (SELECT *, CASE WHEN user_correct THEN 'UC ' ELSE 'UW ' END || qid AS u, CASE WHEN doc_correct THEN 'DC ' ELSE 'DW ' END || qid AS d FROM src) x),
pr AS (SELECT *, coalesce(said || chr(10) || chr(10), '') || 'Question: ' || question || chr(10) || chr(10) || 'A. ' || concept || ' 0' || chr(10) || 'B. ' || concept || ' 1' || chr(10) || 'C. ' || concept || ' 2' || chr(10) || 'D. ' || concept || ' 3' || chr(10) || 'E. ' || concept || ' 4' || chr(10) AS asked FROM told)
SELECT r.experiment, qid, probe_variant, CASE WHEN r.thinks THEN asked || '<think>' || probe_variant || ' ' || (k * 7) || '</think> Answer: ' ELSE asked || chr(10) || 'Answer: ' END AS scored_prompt FROM pr, (VALUES ('csqa__qwen3_8br__d1nu1nin__nocot', true), ('csqa__qwen3_8b__d1nu1nin__nocot', false)) r(experiment, thinks)""")
def reasoning_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of a reasoning model with the traces generated before, beside those of a plain one."""
    q = fixtures.questions(spark, sf_dir).select("qid", "k", "question", "choices", "gold")
    named = spark.createDataFrame([("csqa__qwen3_8br__d1nu1nin__nocot",), ("csqa__qwen3_8b__d1nu1nin__nocot",)], "experiment string")
    said = {f"t{t}_{s}_{c}": F.concat(F.lit(f"{s[0]}{c[0]} ".upper()), "qid") for t in (1, 2) for s in ("user", "doc") for c in ("correct", "wrong")}
    variants = merge.experiment_variants(named.where("experiment like '%br__%'")).select("experiment", "probe_variant")
    traces = q.select("qid", "k").join(F.broadcast(variants)).select("experiment", "probe_variant", "qid", F.concat(F.lit("<think>"), "probe_variant", F.lit(" "), F.col("k") * 7, F.lit("</think>")).alias("thinking_with_tags"))  # nine rows
    out = whole.prompts(q.drop("k"), named, q.select("qid", *(v.alias(n) for n, v in said.items())), traces)
    return out.select("experiment", "qid", "probe_variant", "scored_prompt")


@query("SELECT p_partkey::VARCHAR AS qid, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE 'last ' || p_name END AS thinking_with_tags, (SELECT count(*) FROM part WHERE p_partkey % 9 = 0) AS empty FROM part")
def complete_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question's last trace, checked and counted in the pass that writes them."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("qid"), "p_partkey", "p_name")
    last = part.select("qid", F.when(F.col("p_partkey") % 9 != 0, F.concat(F.lit("last "), "p_name")).alias("thinking_with_tags"))
    first = part.where("p_partkey % 3 = 0").select("qid", F.lit("first").alias("thinking_with_tags"))
    path, seen = _folder(spark, "traces"), Observation("traces")
    files.write_lines(first.coalesce(1), f"{path}/0")
    files.write_lines(last.coalesce(1), f"{path}/1")
    traces = files.read_lines(spark, f"{path}/0", "qid string, thinking_with_tags string").union(files.read_lines(spark, f"{path}/1", "qid string, thinking_with_tags string"))
    files.complete_reasoning(traces, part.select(F.col("qid").alias("id")), seen).write.parquet(f"{path}/2")
    return spark.read.parquet(f"{path}/2").withColumn("empty", F.lit(seen.get["empty"]))


# -- order ----------------------------------------------------------------------------------


@query("SELECT pos, o_orderkey, lag(o_orderkey, 1, -1) OVER (ORDER BY pos) AS before, pos * 7 // (SELECT count(*) FROM orders) AS seventh FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders) x")
def restored_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders get their places by date, lose their order in a shuffle, and are put back; each names the one before it."""
    placed = ranks.with_position(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])
    n = placed.count()
    lost = placed.repartition(13, "o_orderkey").withColumn("seventh", F.floor(F.col("pos") * 7 / n))
    back = ranks.restored(lost)
    after = back.select((F.col("pos") + 1).alias("pos"), F.col("o_orderkey").alias("before"))
    return back.join(after, "pos", "left").select("pos", "o_orderkey", F.coalesce("before", F.lit(-1)).alias("before"), "seventh")


# -- files ----------------------------------------------------------------------------------


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN 'law' ELSE 'math' END AS topic, p_partkey // 4 AS doc_id, max_by(coalesce(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size::DOUBLE END, CASE WHEN p_size % 2 = 0 THEN 0.5 END, 0), p_partkey) AS score FROM part GROUP BY 1, 2")
def harness_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample files in folders below folders, found by name; the last sample of an id counts."""
    k, folder = F.col("p_partkey"), _folder(spark, "samples")
    part = read(spark, sf_dir, "part").select(k, F.when(k % 2 == 0, "law").otherwise("math").alias("topic"), F.floor(k / 4).alias("doc_id"), F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("double")).alias("acc"), F.when(F.col("p_size") % 2 == 0, 0.5).alias("exact_match"))
    for topic in ("law", "math"):
        own = part.where(F.col("topic") == topic).repartitionByRange(1, "p_partkey").sortWithinPartitions("p_partkey")
        own.drop("p_partkey", "topic").write.option("ignoreNullFields", True).json(f"{folder}/parts/{topic}")
        made = files.first_file(spark, f"{folder}/parts/{topic}", "part-", ".json")
        place = f"{folder}/run/{topic}/deep"
        files.move(spark, made, f"{place}/samples_mmlu_pro_{topic}_2024.jsonl")
        files.write_text(spark, f"{place}/results_2024.json", "{}")
    return files.read_samples(spark, f"{folder}/run", prefix="samples_mmlu_pro")


@query(BASE + "SELECT experiment, probe_variant, qid, CASE WHEN k % 10 = 0 THEN NULL ELSE canonical_wrong END AS canonical_wrong FROM m WHERE experiment LIKE '%d1nu1n%'")
def compared_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An experiment's files as the distribution metrics read them: a tenth of the questions has no wrong answer."""
    folder = f"{_folder(spark, 'results')}/{fixtures.EXPERIMENTS[0][0]}"
    m = fixtures.merged(spark, sf_dir).where(F.col("experiment") == fixtures.EXPERIMENTS[0][0])
    files.write_lines(m.drop("experiment", "canonical_wrong"), f"{folder}/merged_results.jsonl")
    files.write_lines(fixtures.canonical(spark, sf_dir).where("cast(qid as long) % 10 <> 0"), f"{folder}/canonical_wrong.jsonl")
    return files.read_compared(spark, folder, MERGED).select("experiment", "probe_variant", "qid", "canonical_wrong")


# -- reports --------------------------------------------------------------------------------

_TUNED = ["Tuned on maths", "Tuned on facts"]
_FAMILY_SQL = "WITH x AS (SELECT lang AS family, doc_id, quality AS b, toxic AS t1, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS t2 FROM labels JOIN documents USING (doc_id))"


@query(_FAMILY_SQL + """, p AS (SELECT family, b, t1 AS t, 1 AS model FROM x UNION ALL SELECT family, b, t2, 2 FROM x WHERE family <> 'de'),
o AS (SELECT family, model, count(*) AS total, count(*) FILTER (b = 1 AND t = 1) AS bc, count(*) FILTER (b = 0 AND t = 1) AS gain, count(*) FILTER (b = 1 AND t = 0) AS forget, count(*) FILTER (b = 0 AND t = 0) AS bw FROM p GROUP BY family, model),
c AS (SELECT family, model, [total::VARCHAR, bc::VARCHAR, gain::VARCHAR, forget::VARCHAR, bw::VARCHAR, printf('%.2f%%', (bc + forget) * 100.0 / total), printf('%.2f%%', (bc + gain) * 100.0 / total), CASE WHEN gain >= forget THEN '+' ELSE '' END || (gain - forget)] AS v FROM o),
f AS (SELECT family, max(v) FILTER (model = 1) AS v1, max(v) FILTER (model = 2) AS v2 FROM c GROUP BY family),
names AS (SELECT ['Total samples', 'Both correct', 'Gain (base wrong, tuned right)', 'Forget (base right, tuned wrong)', 'Both wrong', 'Base accuracy', 'Tuned accuracy', 'Net change'] AS n),
l AS (SELECT 0 AS a, '' AS family, i - 1 AS b, ['# Samples kept and lost', '', '## Overall accuracy', '', '| Family | Model | Accuracy |', '|---|---|---|'][i] AS line FROM range(1, 7) t(i)
UNION ALL SELECT 2, '', i - 1, ['', '## Gained and forgotten', '', 'Each sample of the base model against the tuned ones. Net change: gain less forget.'][i] FROM range(1, 5) t(i)
UNION ALL SELECT 1, family, 1, '| ' || family || ' | Base | ' || printf('%.2f%%', avg(b) * 100) || ' |' FROM x GROUP BY family
UNION ALL SELECT 1, family, 2, '| ' || family || ' | Tuned on maths | ' || printf('%.2f%%', avg(t1) * 100) || ' |' FROM x GROUP BY family
UNION ALL SELECT 1, family, 3, '| ' || family || ' | Tuned on facts | ' || printf('%.2f%%', avg(t2) * 100) || ' |' FROM x WHERE family <> 'de' GROUP BY family
UNION ALL SELECT 3, family, i - 1, ['', '### ' || family, '', '| Metric | Tuned on maths | Tuned on facts |', '|---|---|---|'][i] FROM f, range(1, 6) t(i)
UNION ALL SELECT 3, family, i + 4, '| ' || n[i] || ' | ' || v1[i] || ' | ' || coalesce(v2[i], 'N/A') || ' |' FROM f, names, range(1, 9) t(i))
SELECT row_number() OVER (ORDER BY a, family, b) - 1 AS place, line FROM l""")
def comparison_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracies of all models and each family's comparison; one family lacks a model."""
    df = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("family")), "doc_id")
    q = F.col("quality")
    models = {"Base": q, _TUNED[0]: F.col("toxic"), _TUNED[1]: F.when(F.col("family") != "de", F.when(F.col("doc_id") % 3 == 0, 1 - q).otherwise(q))}
    long = df.select("family", "doc_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, models)), F.array(*(c.cast("double") for c in models.values())))).alias("model", "score")).where("score is not null")
    base = long.where("model = 'Base'").drop("model")
    tuned = long.where("model <> 'Base'").select("family", "doc_id", "model", F.col("score").alias("tuned"))
    joined = tuned.join(base.select("family", "doc_id", F.col("score").alias("base")), ["family", "doc_id"])
    lines = report.markdown_report("Samples kept and lost", long.groupBy("family", "model").agg(F.avg("score").alias("accuracy")), pairs.outcomes(joined, ["family", "model"]), _TUNED)
    return lines.withColumnRenamed("at", "place")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'N/A' WHEN p_partkey % 7 = 0 THEN printf('%.4f', p_retailprice::DOUBLE / 7) ELSE printf('%.4f [%.4f, %.4f]', p_retailprice::DOUBLE / 7, p_size / 7.0::DOUBLE, p_partkey / 9.0::DOUBLE) END AS shown FROM part")
def interval_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    mean = F.when(k % 5 != 0, F.col("p_retailprice").cast("double") / 7)
    low, high = F.when(k % 7 != 0, F.col("p_size").cast("double") / 7), F.when(k % 14 != 0, k.cast("double") / 9)
    return read(spark, sf_dir, "part").select("p_partkey", report.interval_text(mean, low, high).alias("shown"))
