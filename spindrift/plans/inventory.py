"""More registered queries: training sets, completeness, preparation, prompts for API models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import dims, names, text
from spindrift.operators import merge, prep, report, sampling, scoring, tiers
from spindrift.plans import experiment as whole
from spindrift.plans import fixtures
from spindrift.plans.registry import _NAME_SQL, _NAMED_SQL, _POOL_SQL, _STRATEGY, _named, _names, _narrow, _pairs, _PAIR_SQL, _pool, query, r6, read
from spindrift.plans.sql import BASE

# -- merging --------------------------------------------------------------------------------


@query(BASE + """SELECT experiment, qid, probe_variant, CASE WHEN k % 10 = 0 THEN 'E' ELSE output_letter END AS output_letter, CASE WHEN k % 10 = 0 THEN gold = 'E' ELSE output_correct END AS output_correct, CASE WHEN k % 10 = 0 THEN gold = 'E' ELSE model_correct END AS model_correct FROM m""")
def merged_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the questions has a second row for each variant, which replaces the first."""
    first = fixtures.probes(spark, sf_dir).withColumn("pos", F.lit(1))
    again = first.where("cast(qid as long) % 10 = 0").withColumns({"output_letter": F.lit("E"), "output_correct": F.col("gold") == "E", "pos": F.lit(2)})
    wrong = fixtures.canonical(spark, sf_dir).select("qid", "canonical_wrong").join(F.broadcast(fixtures.experiments(spark).select("experiment")))  # two rows
    m = merge.merge_results(again.unionByName(first), wrong, "pos")
    return m.select("experiment", "qid", "probe_variant", "output_letter", "output_correct", "model_correct")


@query(_NAMED_SQL + "SELECT experiment, probe_variant, CASE WHEN up AND dp THEN CASE WHEN uf THEN 'user_first' ELSE 'doc_first' END END AS source_order FROM vx")
def variant_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.source_order(merge.experiment_variants(_named(spark, sf_dir)).select("experiment", "probe_variant"))


_KNOWN = {"llama3_8b": "meta-llama/Meta-Llama-3-8B", "llama3_2_1b_instruct": "meta-llama/Llama-3.2-1B-Instruct", "gpt_4o": "gpt-4o-2024-08-06", "gemma3_4b_it": "google/gemma-3-4b-it", "gemini_2_0_flash": "gemini-2.0-flash"}


@query(_NAME_SQL + "SELECT k, CASE key WHEN 'llama3_8b' THEN 'meta-llama/Meta-Llama-3-8B' WHEN 'llama3_2_1b_instruct' THEN 'meta-llama/Llama-3.2-1B-Instruct' WHEN 'gpt_4o' THEN 'gpt-4o-2024-08-06' WHEN 'gemma3_4b_it' THEN 'google/gemma-3-4b-it' ELSE 'gemini-2.0-flash' END AS model_id FROM x WHERE key IN ('llama3_8b', 'llama3_2_1b_instruct', 'gpt_4o', 'gemma3_4b_it', 'gemini_2_0_flash')")
def model_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = report.reports_dimensions(_names(spark, sf_dir)).where(F.col("model_key").isin(list(_KNOWN)))
    return names.with_model_id(df, _KNOWN).select("k", "model_id")


# -- scores ---------------------------------------------------------------------------------


@query(BASE + "SELECT qid, round(ln(max(p) FILTER (ci = 0)), 6) AS a, round(ln(max(p) FILTER (ci = 4)), 6) AS e FROM lp WHERE probe_variant = 'bare' AND experiment LIKE '%d1nu1n%' GROUP BY qid")
def log_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixtures.questions(spark, sf_dir).withColumn("lp", scoring.log_softmax(F.col("logits")))
    return df.select("qid", F.round(F.col("lp")[0], 6).alias("a"), F.round(F.col("lp")[4], 6).alias("e"))


# -- report ---------------------------------------------------------------------------------


@query(_PAIR_SQL + """, o AS (SELECT topic, count(*) AS total, count(*) FILTER (b = 0 AND t = 1) AS gain, count(*) FILTER (b = 1 AND t = 0) AS forget FROM x GROUP BY topic)
SELECT 0::BIGINT AS at, '| Topic | Samples | Gain | Forget | Net |' AS line UNION ALL SELECT 1, '|---|---|---|---|---|' UNION ALL
SELECT 1 + row_number() OVER (ORDER BY topic), '| ' || topic || ' | ' || total || ' | ' || gain || ' | ' || forget || ' | ' || (gain - forget) || ' |' FROM o""")
def forgetting_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.operators import pairs

    return report.forgetting_lines(pairs.outcomes(_pairs(spark, sf_dir), ["topic"]), "topic")


# -- training sets --------------------------------------------------------------------------


@query(BASE + "SELECT experiment, qid, probe_variant, 'tier_t1' AS sft_strategy, split_part(experiment, '__', 3) AS tier_config, 'tier1' AS tier, experiment AS source_experiment FROM m WHERE qid IN (SELECT qid FROM (SELECT qid, row_number() OVER (ORDER BY md5('42|' || qid)) AS n FROM q) WHERE n <= 100)")
def sft_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred questions of all (the feature: a fixed number of them), and their rows of all experiments."""
    m = fixtures.merged(spark, sf_dir)
    rows = sampling.tagged(sampling.selected(m, sampling.sample_questions(fixtures.questions(spark, sf_dir), 100)), "t1")
    return rows.select("experiment", "qid", "probe_variant", "sft_strategy", "tier_config", "tier", "source_experiment")


@query(_POOL_SQL + ", h AS (SELECT pool.*, floor((pct / 100.0)::DOUBLE * 500)::BIGINT AS goal, row_number() OVER (PARTITION BY probe_variant ORDER BY md5((42 + ord) || '|' || qid), qid) AS n FROM pool JOIN tgt USING (probe_variant)) SELECT probe_variant, experiment, qid FROM h WHERE n <= goal")
def sft_fixed_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of a given size instead of the largest that the pools allow."""
    out = sampling.balanced_sample(_narrow(spark, sf_dir), sampling.weight_table(spark, _STRATEGY), ["tier"], total=500)
    return out.select("probe_variant", "experiment", "qid")


@query("SELECT v AS probe_variant FROM (VALUES ('bare'), ('upos'), ('uneg'), ('dpos'), ('dneg'), ('dpup'), ('updp'), ('dnun'), ('undn'), ('dpun'), ('dnup'), ('updn'), ('undp')) t(v) WHERE v LIKE 'u%d%'")
def sft_missing_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a strategy wants and document-first experiments alone do not have."""
    pool = _pool(spark, sf_dir).where(F.col("order") == "doc_first")
    return sampling.missing_variants(pool, sampling.weight_table(spark, _STRATEGY))


# -- completeness ---------------------------------------------------------------------------

_REASONING = "csqa__qwen3_8br__d1nu1nin__nocot"


@query(BASE + f"""SELECT experiment, 11::BIGINT AS files, ((CASE WHEN count(*) FILTER (probe_variant = 'updn' AND k % 10 = 0) > 0 THEN 1 ELSE 0 END) + (CASE WHEN count(*) FILTER (probe_variant = 'updn' AND k % 10 = 0) > 0 THEN 1 ELSE 0 END))::BIGINT AS missing, count(*) FILTER (probe_variant = 'updn' AND k % 10 = 0) = 0 AS complete FROM m GROUP BY experiment
UNION ALL SELECT '{_REASONING}', 20, 11 + (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM q WHERE unk), false""")
def experiment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that an experiment should have by its name, against the lines that its results give: one variant lacks a
    tenth of its rows, and a reasoning model has traces only, of which one variant lacks some."""
    m = fixtures.merged(spark, sf_dir).where("not (probe_variant = 'updn' and cast(qid as long) % 10 = 0)")
    named = fixtures.experiments(spark).select("experiment").union(spark.createDataFrame([(_REASONING,)], "experiment string"))
    lines = F.count("*").alias("lines")
    probes = m.groupBy("experiment", F.concat(F.lit("probs_"), "probe_variant", F.lit(".jsonl")).alias("file")).agg(lines)
    whole_table = m.groupBy("experiment", F.lit("merged_results.jsonl").alias("file")).agg(lines)
    wrong = m.select("experiment", "qid").distinct().groupBy("experiment", F.lit("canonical_wrong.jsonl").alias("file")).agg(lines)
    first = m.where("experiment like '%d1nu1n%' and not (probe_variant = 'bare' and output_letter = 'UNKNOWN')")
    traces = first.groupBy(F.lit(_REASONING).alias("experiment"), F.concat("probe_variant", F.lit("_vllm_reasoning.jsonl")).alias("file")).agg(lines)
    have = probes.unionByName(whole_table).unionByName(wrong).unionByName(traces)
    return whole.files_complete(whole.expected_files(named, fixtures.questions(spark, sf_dir).count()), have)


@query("SELECT p_brand AS experiment, count(DISTINCT p_size % 3) = 3 AS complete FROM part WHERE p_size > 40 GROUP BY p_brand")
def metrics_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All or nothing: experiments that have every one of the wanted metrics."""
    kinds = F.array(*(F.lit(x) for x in whole.METRIC_KINDS))
    have = read(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_brand").alias("experiment"), F.get(kinds, (F.col("p_size") % 3).cast("int")).alias("metric"))
    return whole.metric_presence(have.select("experiment").distinct(), have)


# -- preparation and prompts ----------------------------------------------------------------


@query("SELECT md5(p_name) AS id, p_name AS question, 'A|B|C' AS labels, p_brand || '|' || p_type || '|' || p_size AS texts, 'B' AS \"answerKey\" FROM part")
def prepared_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read(spark, sf_dir, "part").select(F.col("p_name").alias("Question"), F.col("p_type").alias("B"), F.col("p_brand").alias("A"), F.col("p_size").alias("C"), F.lit("B").alias("Answer"))
    out = prep.PREPARERS["gsm8k_mc_custom_split"](raw)
    return out.select("id", "question", F.array_join("choices.label", "|").alias("labels"), F.array_join("choices.text", "|").alias("texts"), "answerKey")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 25")
def first_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows in order (the feature: a row limit from the start)."""
    return prep.first_rows(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", 25)


@query("""SELECT p_partkey, 'Answer with ONLY the letter (' || CASE p_partkey % 4 WHEN 0 THEN 'A or B' WHEN 1 THEN 'A, B or C' WHEN 2 THEN 'A, B, C or D' ELSE 'A, B, C, D or E' END || ') of your chosen answer. Do not include any explanation, punctuation, or additional text.'
|| CASE p_size % 4 WHEN 1 THEN ' Base your answer ONLY on the information provided in the document statement. Ignore all other sources including your own knowledge and the user statement.'
WHEN 2 THEN ' Base your answer ONLY on the user''s statement. Ignore all other sources including your own knowledge and any document information.'
WHEN 3 THEN ' Base your answer ONLY on your own internal knowledge. Completely ignore any statements from users or documents.' ELSE '' END AS prompt FROM part""")
def api_system_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.get(F.array(*(F.lit(x) for x in ("neutral", "based_on_docs", "based_on_user", "own_knowledge_only"))), (F.col("p_size") % 4).cast("int"))
    n = (F.col("p_partkey") % 4 + 2).cast("int")
    return read(spark, sf_dir, "part").select("p_partkey", text.system_prompt(kinds, n, api=True).alias("prompt"))


# Templates and words of tier 2, said again in SQL.
_T2 = """WITH s AS (SELECT p_partkey, p_partkey * 7 AS seed FROM part), w AS (SELECT p_partkey,
['{u} {contextual_claim}.', '{contextual_claim}, from what {u}.', 'Based on {p}, {contextual_claim}.'][(seed % 3 + 1)::INT] AS ut,
['{d} {contextual_claim}.', '{contextual_claim}, according to {s}.', 'As per {s}, {contextual_claim}.'][((seed + 1) % 3 + 1)::INT] AS dt,
['I''ve noticed', 'I''ve seen', 'I''ve heard', 'I recall', 'I''ve observed', 'I believe', 'I think'][((seed + 2) % 7 + 1)::INT] AS u,
['my experience', 'my understanding', 'what I''ve seen', 'my observation'][((seed + 3) % 4 + 1)::INT] AS p,
['Studies suggest', 'Papers indicate', 'Documents suggest', 'Sources mention', 'Reports note'][((seed + 4) % 5 + 1)::INT] AS d,
['recent reports', 'available data', 'published studies', 'the literature', 'the documentation', 'recent findings', 'available materials', 'available sources'][((seed + 5) % 8 + 1)::INT] AS s FROM s)
"""


@query(_T2 + "SELECT p_partkey, replace(replace(ut, '{u}', u), '{p}', p) AS user_template, replace(replace(dt, '{d}', d), '{s}', s) AS doc_template FROM w")
def t2_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, doc = text.tier2_templates(F.col("p_partkey") * 7)
    return read(spark, sf_dir, "part").select("p_partkey", user.alias("user_template"), doc.alias("doc_template"))


@query(_T2 + """SELECT p_partkey, replace(replace(ut, '{u}', u), '{p}', p) AS user_template, md5('Write four short statements for a multiple-choice question.' || chr(10) || chr(10) || 'Question: ' || p_name || chr(10) || 'Correct answer: ' || p_brand || chr(10) || 'Wrong answer: ' || p_type || chr(10)
|| 'User template: ' || replace(replace(ut, '{u}', u), '{p}', p) || chr(10) || 'Document template: ' || replace(replace(dt, '{d}', d), '{s}', s) || chr(10)) AS head,
'USER_CORRECT: I''ve worked out the baker has ' || p_brand || ' rolls left over at noon.' || chr(10) || 'DOC_CORRECT: Calculations show the baker has ' || p_brand || ' rolls left over at noon.' || chr(10) || 'USER_WRONG: I''ve worked out the baker has ' || p_type || ' rolls left over at noon.' || chr(10) || 'DOC_WRONG: Calculations show the baker has ' || p_type || ' rolls left over at noon.' || chr(10) AS example FROM w JOIN part USING (p_partkey)""")
def t2_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts' first part, with question, answers and templates, and their example."""
    user, doc = text.tier2_templates(F.col("p_partkey") * 7)
    prompt = tiers.tier2_prompt(F.col("p_name"), F.col("p_brand"), F.col("p_type"), user, doc, "math")
    df = read(spark, sf_dir, "part").select("p_partkey", user.alias("user_template"), prompt.alias("prompt"))
    head, example = F.regexp_extract("prompt", r"(?s)^(.*?)\nHow to write", 1), F.regexp_extract("prompt", r"(?s)\n(USER_CORRECT: I.*?)\nReply with", 1)
    return df.select("p_partkey", "user_template", F.md5(head).alias("head"), example.alias("example"))


@query(BASE + """SELECT experiment, qid, probe_variant, CASE WHEN user_present AND doc_present THEN CASE WHEN user_first THEN u || chr(10) || d ELSE d || chr(10) || u END WHEN user_present THEN u WHEN doc_present THEN d END AS told
FROM (SELECT *, CASE WHEN user_correct THEN 'UC ' ELSE 'UW ' END || qid AS u, CASE WHEN doc_correct THEN 'DC ' ELSE 'DW ' END || qid AS d FROM m)""")
def experiment_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole prompts of all questions and variants; what stands before the question is compared."""
    q = fixtures.questions(spark, sf_dir).select("qid", "question", "choices", "gold")
    said = {f"t{t}_{s}_{c}": F.concat(F.lit(f"{s[0]}{c[0]} ".upper()), "qid") for t in (1, 2) for s in ("user", "doc") for c in ("correct", "wrong")}
    out = whole.prompts(q, fixtures.experiments(spark).select("experiment"), q.select("qid", *(v.alias(k) for k, v in said.items())))
    before = F.regexp_extract("user_prompt", r"(?s)^(.*?)\n\nQuestion: ", 1)
    return out.select("experiment", "qid", "probe_variant", F.when(before != "", before).alias("told"))
