"""Registered queries of the analytics core and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import dims, names, text
from spindrift.operators import breakdown, choice, distribution, logit, merge, pairs, prep, report, sampling, scoring, tiers
from spindrift.plans import experiment as whole
from spindrift.plans import fixtures
from spindrift.sources import files
from spindrift.plans.sql import BASE, FAMILY, SHIFT, SINGLE, STRENGTH, _values, rounded

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    import_module("spindrift.plans.inventory")  # each adds its own
    import_module("spindrift.plans.draws")
    import_module("spindrift.plans.flows")
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- flagship -------------------------------------------------------------------------------


@query(SHIFT + f""", sums AS (SELECT experiment, probe_variant, {rounded('avg(kl)', 'avg(delta_entropy)').replace('AS avg(kl)', 'AS kl').replace('AS avg(delta_entropy)', 'AS delta_entropy')} FROM sh GROUP BY experiment, probe_variant),
fs AS (SELECT experiment, probe_variant, count(*) AS n, round(avg(output_correct::INT), 6) AS accuracy FROM m GROUP BY experiment, probe_variant)
SELECT fs.*, kl, delta_entropy FROM fs LEFT JOIN sums USING (experiment, probe_variant)""")
def variant_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixtures.merged(spark, sf_dir)
    df = distribution.shift_columns(distribution.prob_vectors(m, keep=True))
    shift = lambda c: F.avg(F.when((F.col("probe_variant") != "bare") & distribution.finite(F.col(c)), F.col(c))).alias(c)
    out = df.groupBy("experiment", "probe_variant").agg(F.count("*").alias("n"), F.avg(F.col("output_correct").cast("double")).alias("accuracy"), shift("kl"), shift("delta_entropy"))
    return r6(out, "accuracy", "kl", "delta_entropy")


# -- names ----------------------------------------------------------------------------------

_KEYS = ["llama3_8b", "llama3_2_1b_instruct", "qwen2_5_7b", "qwen3_8br", "gpt_4o", "gemma3_4b_it", "gemini_2_0_flash", "qwen3_8b"]
_NAME_SQL = f"""
WITH n AS (SELECT p_partkey AS k, 'ds' || (p_size % 3) || '__' || ['{"', '".join(_KEYS)}'][p_partkey % 8 + 1] || '__'
  || CASE WHEN p_partkey % 2 = 0 THEN 'd' || (p_size % 2 + 1) || 'wnc'[p_partkey % 3 + 1] || 'u' || (p_partkey % 2 + 1) || 'cwn'[p_size % 3 + 1] ELSE 'u' || (p_size % 2 + 1) || 'wnc'[p_partkey % 3 + 1] || 'd' || (p_partkey % 2 + 1) || 'cwn'[p_size % 3 + 1] END
  || 'i' || 'nduo'[p_size % 4 + 1] || '__' || CASE WHEN p_size % 5 = 0 THEN 'cot' WHEN p_size % 5 = 1 THEN 'maybe' ELSE 'nocot' END AS experiment FROM part),
p AS (SELECT *, split_part(experiment, '__', 1) AS dataset, split_part(experiment, '__', 2) AS tok, split_part(experiment, '__', 3) AS prior, split_part(experiment, '__', 4) AS cot FROM n WHERE split_part(experiment, '__', 4) <> 'maybe'),
x AS (SELECT *, CASE WHEN suffix(tok, 'r') THEN tok[:-2] ELSE tok END AS key, prior[1] = 'u' AS uf FROM p)
"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    at = lambda s, i: F.substring(F.lit(s), (i + 1).cast("int"), F.lit(1))
    tier = lambda a: (a % 2 + 1).cast("string")
    first = F.concat(tier(size), at("wnc", k % 3))
    second = F.concat(tier(k), at("cwn", size % 3))
    prior = F.when(k % 2 == 0, F.concat(F.lit("d"), first, F.lit("u"), second)).otherwise(F.concat(F.lit("u"), first, F.lit("d"), second))
    cot = F.when(size % 5 == 0, "cot").when(size % 5 == 1, "maybe").otherwise("nocot")
    name = F.concat(F.lit("ds"), (size % 3).cast("string"), F.lit("__"), F.get(F.array(*map(F.lit, _KEYS)), (k % 8).cast("int")), F.lit("__"), prior, F.lit("i"), at("nduo", size % 4), F.lit("__"), cot)
    return read(spark, sf_dir, "part").select(k.alias("k"), name.alias("experiment"))


@query(_NAME_SQL + f"""SELECT k, experiment, dataset, key AS model_key, suffix(tok, 'r') AS reasoning_mode, CAST(prior[CASE WHEN uf THEN 2 ELSE 5 END] AS INTEGER) AS user_tier, CAST(prior[CASE WHEN uf THEN 5 ELSE 2 END] AS INTEGER) AS doc_tier,
{STRENGTH.format('prior[CASE WHEN uf THEN 3 ELSE 6 END]')} AS user_strength, {STRENGTH.format('prior[CASE WHEN uf THEN 6 ELSE 3 END]')} AS doc_strength, uf AS user_first,
CASE prior[8] WHEN 'n' THEN 'neutral' WHEN 'd' THEN 'based_on_docs' WHEN 'u' THEN 'based_on_user' ELSE 'own_knowledge_only' END AS instruction, cot = 'cot' AS use_cot FROM x""")
def parse_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.reports_dimensions(_names(spark, sf_dir)).drop("model_token", "model_family")


@query(_NAME_SQL + "SELECT k, experiment FROM x")
def build_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _names(spark, sf_dir).withColumn("p", names.parsed(F.col("experiment"))).where("p is not null")
    return df.select("k", names.built(F.col("p")).alias("experiment"))


@query(_NAME_SQL + f"SELECT k, {FAMILY} AS model_family FROM x")
def model_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.reports_dimensions(_names(spark, sf_dir)).select("k", "model_family")


_RECIPE_SQL = f"""WITH r AS (SELECT p_brand, 'ds' || (p_size % 3) AS ds, ['{"', '".join(_KEYS)}'][p_partkey % 8 + 1] AS mt, CASE WHEN p_partkey % 2 = 0 THEN 'd1nu' || (p_size % 2 + 1) || 'w' ELSE 'u2cd1' || 'wnc'[p_size % 3 + 1] END AS pt, 'no'[p_size % 2 + 1] AS ins, CASE WHEN p_size % 4 = 0 THEN 'cot' ELSE 'nocot' END AS cot FROM part)
"""


@query(_RECIPE_SQL + """SELECT DISTINCT ds || '__' || mt || '__' || pt || 'i' || ins || '__' || cot AS experiment FROM (SELECT DISTINCT p_brand, ds FROM r) a JOIN (SELECT DISTINCT p_brand, mt FROM r) b USING (p_brand) JOIN (SELECT DISTINCT p_brand, pt FROM r) c USING (p_brand) JOIN (SELECT DISTINCT p_brand, ins FROM r) d USING (p_brand) JOIN (SELECT DISTINCT p_brand, cot FROM r) e USING (p_brand) WHERE NOT (suffix(mt, 'r') AND cot = 'cot')""")
def recipe_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe for each brand, with the values that its parts have."""
    k, size = F.col("p_partkey"), F.col("p_size")
    at = lambda s, i: F.substring(F.lit(s), (i + 1).cast("int"), F.lit(1))
    prior = F.when(k % 2 == 0, F.concat(F.lit("d1nu"), (size % 2 + 1).cast("string"), F.lit("w"))).otherwise(F.concat(F.lit("u2cd1"), at("wnc", size % 3)))
    part = read(spark, sf_dir, "part").select("p_brand", F.concat(F.lit("ds"), (size % 3).cast("string")).alias("ds"), F.get(F.array(*map(F.lit, _KEYS)), (k % 8).cast("int")).alias("mt"), prior.alias("pt"), at("no", size % 2).alias("ins"), F.when(size % 4 == 0, "cot").otherwise("nocot").alias("cot"))
    recipes = part.groupBy(F.col("p_brand").alias("i")).agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in ("ds", "mt", "pt", "ins", "cot")))
    return names.expanded(recipes)


# -- variants and merging -------------------------------------------------------------------


_NAMED_SQL = _NAME_SQL + f""", dim(probe_variant, up, dp, uc, dc, fst, variant_rank) AS (VALUES {_values([(*v, i) for i, v in enumerate(dims.VARIANTS)])}),
vx AS (SELECT DISTINCT experiment, uf, dim.* FROM x, dim WHERE fst = '' OR (fst = 'u') = uf)
"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid names, each once."""
    return report.reports_dimensions(_names(spark, sf_dir)).select("experiment").distinct()


@query(_NAMED_SQL + "SELECT experiment, probe_variant, up AS user_present, dp AS doc_present, uc AS user_correct, dc AS doc_correct, uf AND fst <> '' AS user_first FROM vx")
def variant_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.experiment_variants(_named(spark, sf_dir)).drop("variant_rank")


@query(_NAMED_SQL + "SELECT experiment, probe_variant, variant_rank FROM vx")
def variants_of_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.experiment_variants(_named(spark, sf_dir)).select("experiment", "probe_variant", "variant_rank")


@query(BASE + "SELECT experiment, qid, probe_variant, gold, canonical_wrong, output_letter, output_correct, model_correct, user_present, doc_present, user_correct, doc_correct, user_first FROM m")
def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.merged(spark, sf_dir).select("experiment", "qid", "probe_variant", "gold", "canonical_wrong", "output_letter", "output_correct", "model_correct", "user_present", "doc_present", "user_correct", "doc_correct", "user_first")


@query(BASE + "SELECT experiment, probe_variant, count(*) FILTER (NOT (probe_variant = 'dneg' AND k % 10 = 0)) AS n, count(*) FILTER (probe_variant = 'dneg' AND k % 10 = 0) AS missing FROM m GROUP BY experiment, probe_variant")
def merge_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of one variant is taken away first, so that something is missing."""
    m = fixtures.merged(spark, sf_dir).where("NOT (probe_variant = 'dneg' AND cast(qid as long) % 10 = 0)")
    return merge.coverage(m)


# -- scores ---------------------------------------------------------------------------------


@query(BASE + "SELECT qid, round(max(p) FILTER (ci = 0), 6) AS p_a, round(max(p) FILTER (ci = 1), 6) AS p_b, round(max(p) FILTER (ci = 4), 6) AS p_e, round(max(p), 6) AS max_prob, CASE WHEN unk THEN 'UNKNOWN' ELSE chr((65 + arg_max(ci, l * 1000000 - ci))::INTEGER) END AS output_letter FROM lp WHERE probe_variant = 'bare' AND experiment LIKE '%d1nu1n%' GROUP BY qid, unk")
def choice_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixtures.bare_results(spark, sf_dir)
    p = lambda i: F.round(F.col("probs")[i]["prob"], 6)
    return df.select("qid", p(0).alias("p_a"), p(1).alias("p_b"), p(4).alias("p_e"), F.round("max_prob", 6).alias("max_prob"), "output_letter")


@query(BASE + "SELECT qid, round(max(l) FILTER (ci = 0), 6) AS l_a, round(max(l) FILTER (ci = 3), 6) AS l_d, NOT unk AS seen FROM bl GROUP BY qid, unk")
def token_letter_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    choices = fixtures.questions(spark, sf_dir).select("qid", F.size("choices").alias("n_choices"))
    df = scoring.letter_logits(fixtures.tokens(spark, sf_dir), choices)
    return df.select("qid", F.round(F.col("logits")[0], 6).alias("l_a"), F.round(F.col("logits")[3], 6).alias("l_d"), "seen")


@query(BASE + "SELECT qid, chr((65 + gi)::INTEGER) AS gold, concept || ' ' || gi AS gold_text, chr((65 + wi)::INTEGER) AS canonical_wrong, concept || ' ' || wi AS canonical_wrong_text FROM cw")
def canonical_wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.canonical(spark, sf_dir)


# -- choice ---------------------------------------------------------------------------------


@query(BASE + "SELECT experiment, probe_variant, count(*) AS n, round(avg(output_correct::INT), 6) AS accuracy FROM m GROUP BY experiment, probe_variant")
def accuracy_by_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(choice.accuracy(fixtures.merged(spark, sf_dir)), "accuracy")


@query(BASE + "SELECT experiment, probe_variant, count(*) AS n, count(*) FILTER (bare_letter <> output_letter) AS changed, count(*) FILTER (NOT model_correct AND output_correct) AS helped, count(*) FILTER (model_correct AND NOT output_correct) AS hurt FROM m WHERE probe_variant <> 'bare' GROUP BY experiment, probe_variant")
def helped_hurt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choice.changed(fixtures.merged(spark, sf_dir))


def _choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choice.choice_metrics(fixtures.merged(spark, sf_dir))


_CONFLICT = ["own_answer_rate", "context_answer_rate", "memory_ratio"]
_PRIOR = ["prior_bias", "prior_correction", "prior_neither"]
_CONTEXT = ["context_bias", "context_robustness", "context_neither"]


@query(SINGLE + f"SELECT experiment, probe_variant, n_present, n_conflict, {rounded(*_CONFLICT)} FROM cm")
def choice_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_choice(spark, sf_dir), *_CONFLICT).select("experiment", "probe_variant", "n_present", "n_conflict", *_CONFLICT)


@query(SINGLE + f"SELECT experiment, probe_variant, n_prior, {rounded(*_PRIOR)} FROM cm")
def choice_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_choice(spark, sf_dir), *_PRIOR).select("experiment", "probe_variant", "n_prior", *_PRIOR)


@query(SINGLE + f"SELECT experiment, probe_variant, n_context, {rounded(*_CONTEXT)} FROM cm")
def choice_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_choice(spark, sf_dir), *_CONTEXT).select("experiment", "probe_variant", "n_context", *_CONTEXT)


@query(SINGLE + "SELECT experiment, source, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in choice.METRICS) + " FROM cm GROUP BY experiment, source")
def choice_source_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(choice.source_averages(_choice(spark, sf_dir)), *choice.METRICS)


# -- breakdown ------------------------------------------------------------------------------

_WORDS = "'User ' || CASE WHEN user_present THEN 'present' ELSE 'absent' END || ' (' || CASE WHEN user_correct THEN 'correct' ELSE 'wrong' END || '), Doc ' || CASE WHEN doc_present THEN 'present' ELSE 'absent' END || ' (' || CASE WHEN doc_correct THEN 'correct' ELSE 'wrong' END || ')'"
_BREAK = "FROM m GROUP BY experiment, user_present, doc_present, user_correct, doc_correct"
_COND = "'U' || user_present::INT || 'D' || doc_present::INT || '_Ucorr' || user_correct::INT || 'Dcorr' || doc_correct::INT"


@query(BASE + f"SELECT experiment, {_COND} AS condition, {_WORDS} AS description, count(*) AS n, round(avg(output_correct::INT), 6) AS correct_rate {_BREAK}")
def breakdown_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(breakdown.breakdown(fixtures.merged(spark, sf_dir)), "correct_rate").select("experiment", "condition", "description", "n", "correct_rate")


@query(BASE + f"SELECT experiment, {_COND} AS condition, round(avg((output_letter = 'UNKNOWN')::INT), 6) AS unknown_rate, count(*) FILTER (output_letter = 'UNKNOWN') AS unknown_count {_BREAK}")
def unknown_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(breakdown.breakdown(fixtures.merged(spark, sf_dir)), "unknown_rate").select("experiment", "condition", "unknown_rate", "unknown_count")


@query(BASE + "SELECT experiment, count(*) AS n, count(DISTINCT qid) AS questions, count(DISTINCT probe_variant) AS variants, round(avg(output_correct::INT), 6) AS correct_rate, round(avg((output_letter = 'UNKNOWN')::INT), 6) AS unknown_rate, count(*) FILTER (output_letter = 'UNKNOWN') AS unknown_count FROM m GROUP BY experiment")
def overall_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(breakdown.overall(fixtures.merged(spark, sf_dir)), "correct_rate", "unknown_rate")


# -- distribution ---------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.prob_vectors(fixtures.merged(spark, sf_dir))


@query(BASE + "SELECT experiment, probe_variant, qid, round(pg, 6) AS p_gold, round(pw, 6) AS p_wrong, round(po, 6) AS p_other FROM m")
def prob_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_vectors(spark, sf_dir).select("experiment", "probe_variant", "qid", *distribution.PARTS), *distribution.PARTS)


@query(SHIFT + "SELECT experiment, probe_variant, round(avg(-(a * log2(a) + b * log2(b) + o * log2(o))), 6) AS entropy FROM v GROUP BY experiment, probe_variant")
def entropy_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(distribution.means(distribution.absolute_metrics(_vectors(spark, sf_dir)), ["entropy"]).drop("n_samples"), "entropy")


@query(SHIFT + "SELECT experiment, probe_variant, round(avg(-log2(a)), 6) AS neglogp FROM v GROUP BY experiment, probe_variant")
def neglogp_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(distribution.means(distribution.absolute_metrics(_vectors(spark, sf_dir)), ["neglogp"]).drop("n_samples"), "neglogp")


@query(SHIFT + f"SELECT experiment, probe_variant, qid, {rounded('kl', 'delta_entropy', 'delta_neglogp')} FROM sh")
def kl_entropy_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(distribution.shift_metrics(_vectors(spark, sf_dir)).drop("pearson"), "kl", "delta_entropy", "delta_neglogp")


@query(SHIFT + "SELECT experiment, probe_variant, qid, round(pearson, 5) AS pearson FROM sh")
def pearson_logp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.shift_metrics(_vectors(spark, sf_dir)).select("experiment", "probe_variant", "qid", F.round("pearson", 5).alias("pearson"))


@query(SHIFT + "SELECT experiment, probe_variant, count(*) AS n_samples, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in distribution.SHIFTS) + " FROM sh GROUP BY experiment, probe_variant")
def distribution_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(distribution.means(distribution.shift_metrics(_vectors(spark, sf_dir))), *distribution.SHIFTS)


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = distribution.shift_metrics(_vectors(spark, sf_dir)).unpivot(["experiment", "probe_variant", "qid"], distribution.SHIFTS, "metric", "value")
    return distribution.poisson_intervals(long, ["experiment", "probe_variant", "metric"])


# -- regression -----------------------------------------------------------------------------


@query(BASE + "SELECT experiment, model_correct::INT AS P_i, user_present::INT AS U_present, doc_present::INT AS D_present, (user_present AND user_correct)::INT AS U_correct, (doc_present AND doc_correct)::INT AS D_correct, count(*) AS n, count(*) FILTER (output_correct) AS correct FROM m GROUP BY 1, 2, 3, 4, 5, 6")
def logit_design_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logit.design_counts(fixtures.merged(spark, sf_dir))


# -- paired models --------------------------------------------------------------------------


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("topic")), "doc_id")
    return df.select("topic", "doc_id", F.col("quality").cast("double").alias("base"), F.col("toxic").cast("double").alias("tuned"))


_PAIR_SQL = "WITH x AS (SELECT lang AS topic, doc_id, quality AS b, toxic AS t FROM labels JOIN documents USING (doc_id)) "


@query(_PAIR_SQL + """SELECT topic, count(*) AS total, count(*) FILTER (b = 1 AND t = 1) AS both_correct, count(*) FILTER (b = 0 AND t = 1) AS gain, count(*) FILTER (b = 1 AND t = 0) AS forget, count(*) FILTER (NOT (b = 1 AND t = 1) AND NOT (b = 0 AND t = 1) AND NOT (b = 1 AND t = 0)) AS both_wrong,
round(count(*) FILTER (b = 1) / count(*), 6) AS base_acc, round(count(*) FILTER (t = 1) / count(*), 6) AS tuned_acc, round((count(*) FILTER (b = 0 AND t = 1) - count(*) FILTER (b = 1 AND t = 0)) / count(*), 6) AS net FROM x GROUP BY topic""")
def forgetting_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _pairs(spark, sf_dir)
    joined = pairs.paired(df.withColumn("score", F.col("base")), df.withColumn("score", F.col("tuned")), ["topic", "doc_id"], strict=True)
    return r6(pairs.outcomes(joined, ["topic"]), "base_acc", "tuned_acc", "net")


@query(_PAIR_SQL + "SELECT doc_id, CASE WHEN b = 0 THEN 'gain' ELSE 'forget' END AS outcome FROM x WHERE (b = 0 AND t = 1) OR (b = 1 AND t = 0)")
def forgetting_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.outcome_ids(_pairs(spark, sf_dir), "doc_id").select("doc_id", "outcome")


# -- sampling -------------------------------------------------------------------------------

_STRATEGY = "bare_10_upos_10_uneg_10_dpos_10_dneg_10_dpup_5_updp_5_dnun_10_undn_10_dpun_5_dnup_5_updn_5_undp_5"
_PCT = ", ".join(f"('{v}', {i}, {p})" for i, (v, p) in enumerate((sampling.weights(_STRATEGY) or {}).items()))
_POOL_SQL = BASE + f""", w(probe_variant, ord, pct) AS (VALUES {_PCT}),
pool AS (SELECT * FROM m WHERE CASE WHEN probe_variant IN ('updp', 'updn', 'undp', 'undn') THEN experiment LIKE '%u1nd1n%' ELSE experiment LIKE '%d1nu1n%' END),
cap AS (SELECT probe_variant, ord, pct, count(*) AS available, floor(count(*) / (pct / 100.0)::DOUBLE)::BIGINT AS max_size FROM pool JOIN w USING (probe_variant) GROUP BY probe_variant, ord, pct),
tgt AS (SELECT *, min(max_size) OVER () AS T, floor((pct / 100.0)::DOUBLE * min(max_size) OVER ())::BIGINT AS target FROM cap)
"""


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixtures.merged(spark, sf_dir).withColumn("order", F.when(F.col("experiment").contains("u1nd1n"), "user_first").otherwise("doc_first"))
    return sampling.pools(m).withColumn("tier", F.lit("tier1"))


def _narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool's columns that a sample names."""
    return _pool(spark, sf_dir).select("tier", "probe_variant", "experiment", "qid")


@query(_POOL_SQL + "SELECT probe_variant, available, max_size, T, target FROM tgt")
def sft_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.capacity(_pool(spark, sf_dir), sampling.weight_table(spark, _STRATEGY), ["tier"]).select("probe_variant", "available", "max_size", "T", "target")


@query(_POOL_SQL + ", hs AS (SELECT pool.*, target, row_number() OVER (PARTITION BY probe_variant ORDER BY md5((42 + ord) || '|' || qid), qid) AS n FROM pool JOIN tgt USING (probe_variant)) SELECT probe_variant, experiment, qid FROM hs WHERE n <= target")
def sft_sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balanced_sample(_narrow(spark, sf_dir), sampling.weight_table(spark, _STRATEGY), ["tier"]).select("probe_variant", "experiment", "qid")


_SPLIT = "WITH g AS (SELECT {0} AS x, row_number() OVER (ORDER BY md5('42|' || {0})) AS n, count(*) OVER () AS total FROM (SELECT DISTINCT {0} FROM part)) SELECT p_partkey, {0}, CASE WHEN n <= floor(total * 0.7) THEN 'train' ELSE 'dev' END AS split FROM part JOIN g ON {0} = x"


@query(_SPLIT.format("p_brand"))
def group_split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.group_split(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand")


@query("SELECT p_partkey, CASE WHEN row_number() OVER (ORDER BY md5('42|' || p_partkey)) <= floor((SELECT count(*) FROM part) * 0.7) THEN 'train' ELSE 'dev' END AS split FROM part")
def row_split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.row_split(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey")


# -- preparation, prompts, extraction -------------------------------------------------------


@query("""WITH l AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS k, text FROM documents), r AS (SELECT k, arg_max(doc_id, doc_id) AS reasoning_id FROM l GROUP BY k) SELECT doc_id, md5(text) AS id, reasoning_id::VARCHAR AS gold_reasoning FROM l JOIN r USING (k)""")
def whitespace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    right = docs.select(F.concat(F.lit("  "), F.regexp_replace("text", " ", "  ")).alias("question"), F.col("doc_id").cast("string").alias("answer"), F.col("doc_id").alias("pos"))
    out = prep.attach_reasoning(docs.select("doc_id", F.col("text").alias("question")), right)
    return out.select("doc_id", F.md5("question").alias("id"), "gold_reasoning")


_SENT = {"u": "'I think the answer is ' || {} || '.'", "d": "'Records state the answer is ' || {} || '.'"}


def _side(source: str, right: str) -> str:
    return _SENT[source].format(f"(concept || ' ' || CASE WHEN {right} THEN gi ELSE wi END)")


@query(BASE + f"""SELECT experiment, qid, probe_variant, CASE WHEN user_present AND doc_present THEN CASE WHEN user_first THEN {_side('u', 'user_correct')} || chr(10) || {_side('d', 'doc_correct')} ELSE {_side('d', 'doc_correct')} || chr(10) || {_side('u', 'user_correct')} END || chr(10) || chr(10)
WHEN user_present THEN {_side('u', 'user_correct')} || chr(10) || chr(10) WHEN doc_present THEN {_side('d', 'doc_correct')} || chr(10) || chr(10) ELSE '' END
|| 'Question: ' || question || chr(10) || chr(10) || 'A. ' || concept || ' 0' || chr(10) || 'B. ' || concept || ' 1' || chr(10) || 'C. ' || concept || ' 2' || chr(10) || 'D. ' || concept || ' 3' || chr(10) || 'E. ' || concept || ' 4' || chr(10) || chr(10) || 'Answer: ' AS user_prompt,
'Answer with ONLY the letter (A, B, C, D or E) of your chosen answer. Do not include any explanation, punctuation, or additional text.' AS system_prompt FROM m""")
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = fixtures.questions(spark, sf_dir).select("qid", "question")
    df = fixtures.merged(spark, sf_dir).join(q, "qid")
    answer = lambda right: scoring.choice_text(F.col("choices"), F.when(F.col(right), F.col("gold")).otherwise(F.col("canonical_wrong")))
    user = F.when(F.col("user_present"), F.concat(F.lit("I think the answer is "), answer("user_correct"), F.lit(".")))
    doc = F.when(F.col("doc_present"), F.concat(F.lit("Records state the answer is "), answer("doc_correct"), F.lit(".")))
    sources = F.when(F.col("user_first"), F.array(user, doc)).otherwise(F.array(doc, user))
    return df.select("experiment", "qid", "probe_variant", text.user_prompt(sources, F.col("question"), F.col("choices")).alias("user_prompt"), text.system_prompt(F.lit("neutral"), F.size("choices")).alias("system_prompt"))


def _sql_sentence(source: str, kind: str) -> str:
    def pick(words: list[str], add: int) -> str:
        return f"['{"', '".join(words)}'][((seed + {add}) % {len(words)}) + 1]"

    out = pick(dims.USER_TEMPLATES if source == "user" else dims.DOC_TEMPLATES, 0)
    for i, (slot, words) in enumerate(dims.WORDS[kind].items(), 1):
        out = f"replace({out}, '{{{slot}}}', {pick(words, i)})"
    return f"replace({out}, '{{answer}}', concept || ' ' || gi)"


@query(BASE + f"""SELECT qid, {_sql_sentence('user', 'default')} AS user_sentence, {_sql_sentence('doc', 'math')} AS doc_sentence FROM (SELECT *, CAST('0x' || substr(md5(qid), 1, 8) AS BIGINT) AS seed FROM q)""")
def t1_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = fixtures.questions(spark, sf_dir)
    answer, seed = scoring.choice_text(F.col("choices"), F.col("gold")), text.md5_number(F.col("qid"))
    return q.select("qid", text.tier1_sentence("user", answer, seed).alias("user_sentence"), text.tier1_sentence("doc", answer, seed, "math").alias("doc_sentence"))


@query("""WITH a AS (SELECT doc_id, upper(regexp_extract(text, '([A-Da-d])', 1)) AS plain, upper(regexp_extract(substr(text, 1, 20) || '<answer> ' || substr(text, 21), '<answer>.*?([A-Da-d])', 1, 's')) AS cot FROM documents) SELECT doc_id, CASE WHEN plain = '' THEN 'Cannot parse answer' ELSE plain END AS plain, CASE WHEN cot = '' THEN 'Cannot parse answer' ELSE cot END AS cot FROM a""")
def extract_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", text.extract_letter(F.col("text"), 4).alias("plain"), text.extract_letter(F.concat(F.substring("text", 1, 20), F.lit("<answer> "), F.substr("text", F.lit(21))), 4, True).alias("cot"))


def _completion_sql() -> str:
    tests = " ".join(f"WHEN instr(u, '{c}') > 0 AND (instr(u, '{c}') = 1 OR NOT regexp_matches(substr(u, instr(u, '{c}') - 1, 1), '\\p{{L}}')) AND (instr(u, '{c}') = length(u) OR NOT regexp_matches(substr(u, instr(u, '{c}') + 1, 1), '\\p{{L}}')) THEN '{c}'" for c in "ABCDE")
    return f"CASE {tests} ELSE 'UNKNOWN' END"


@query(f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'why</think> so Answer: ' || chr((65 + doc_id % 7)::INTEGER) WHEN doc_id % 3 = 1 THEN chr((65 + doc_id % 6)::INTEGER) || '. ' || lang ELSE 'it (' || chr((97 + doc_id % 6)::INTEGER) || ')' END AS c FROM documents), x AS (SELECT *, upper(c) AS u, upper(regexp_extract(c, '^.*?</think>.*?Answer:\\s*([A-Ea-e])', 1, 's')) AS after FROM t)
SELECT doc_id, {_completion_sql()} AS plain, CASE WHEN after <> '' THEN after ELSE {_completion_sql()} END AS reasoned FROM x""")
def extract_completion_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    c = F.when(i % 3 == 0, F.concat(F.lit("why</think> so Answer: "), F.char(65 + i % 7))).when(i % 3 == 1, F.concat(F.char(65 + i % 6), F.lit(". "), F.col("lang"))).otherwise(F.concat(F.lit("it ("), F.char(97 + i % 6), F.lit(")")))
    df = read(spark, sf_dir, "documents").select("doc_id", c.alias("c"))
    return df.select("doc_id", text.completion_answer(F.col("c")).alias("plain"), text.completion_answer(F.col("c"), True).alias("reasoned"))


@query("""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 30) || '</think>' || substr(text, 31) || '</think> end' ELSE text END AS c FROM documents) SELECT doc_id, CASE WHEN regexp_extract(c, '^(.*</think>)', 1, 's') = '' THEN c ELSE regexp_extract(c, '^(.*</think>)', 1, 's') END AS thinking FROM t""")
def thinking_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(F.col("doc_id") % 2 == 0, F.concat(F.substring("text", 1, 30), F.lit("</think>"), F.substr("text", F.lit(31)), F.lit("</think> end"))).otherwise(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", text.thinking_text(c).alias("thinking"))


@query("SELECT doc_id, contains(lower(text), lower(CASE WHEN doc_id % 2 = 0 THEN 'The And' ELSE 'ION' END)) AS has FROM documents")
def contains_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.contains_answer(F.col("text"), F.when(F.col("doc_id") % 2 == 0, "The And").otherwise("ION")).alias("has"))


# -- incremental, distinct, report ----------------------------------------------------------


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def incremental_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return merge.missing_rows(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("SELECT p_brand AS experiment, count(*)::DOUBLE AS value, NULL::DOUBLE AS extra FROM part WHERE p_size <= 20 GROUP BY p_brand UNION ALL SELECT p_type, NULL, count(*)::DOUBLE FROM part WHERE p_type NOT IN (SELECT p_brand FROM part WHERE p_size <= 20) GROUP BY p_type")
def append_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    old = part.where("p_size <= 20").groupBy(F.col("p_brand").alias("experiment")).agg(F.count("*").cast("double").alias("value"))
    fresh = part.groupBy(F.col("p_type").alias("experiment")).agg(F.count("*").cast("double").alias("extra"))
    again = part.groupBy(F.col("p_brand").alias("experiment")).agg(F.count("*").cast("double").alias("extra")).join(old.select("experiment"), "experiment")
    return report.appended(old, fresh.unionByName(again))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.latest(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query(SINGLE + """SELECT experiment, 'csqa' AS dataset, 'qwen3' AS model_family, """ + ", ".join(f"round(max({m}) FILTER (probe_variant = '{v}'), 6) AS choice_{v}_{m}" for v, m in (("upos", "own_answer_rate"), ("uneg", "context_answer_rate"), ("dneg", "context_bias"), ("dpos", "prior_correction"))) + " FROM cm GROUP BY experiment")
def report_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["choice_upos_own_answer_rate", "choice_uneg_context_answer_rate", "choice_dneg_context_bias", "choice_dpos_prior_correction", "choice_upos_context_bias"]
    out = report.core_report(report.long_rows(_choice(spark, sf_dir), choice.METRICS, "choice"), columns)
    kept = [c for c in columns if c in out.columns]
    return r6(out, *kept).select("experiment", "dataset", "model_family", *kept)


@query(BASE + """SELECT qid, 'bare' AS probe_variant, 5 AS n_choices, chr((65 + arg_max(ci, x * 1000000 - ci))::INTEGER) AS output_letter, max(x) FILTER (ci = 0) AS logp_a, max(x) FILTER (ci = 4) AS logp_e
FROM (SELECT q.*, ci, ((((k + 1) * 7919 + ci * 104729) % 1009) / 100.0)::DOUBLE AS x FROM q, c) GROUP BY qid""")
def openai_letter_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer that answers from the question's fixture logits in an API's form."""
    prompts = fixtures.questions(spark, sf_dir).select("qid", F.lit("bare").alias("probe_variant"), F.lit("").alias("system_prompt"), F.col("question").alias("user_prompt"), F.size("choices").alias("n_choices"))
    found = scoring.scored(prompts, _stub)
    return found.select("qid", "probe_variant", "n_choices", "output_letter", F.col("logps")[0].alias("logp_a"), F.col("logps")[4].alias("logp_e"))


def _stub() -> scoring.Scorer:
    def answer(rows: list[dict]) -> list:
        out = []
        for r in rows:
            k = int(r["qid"])
            logits = [(((k + 1) * 7919 + i * 104729) % 1009) / 100.0 for i in range(r["n_choices"])]
            top = [(f" {chr(65 + i)}", x) for i, x in enumerate(logits)]
            out.append([("\n", [("\n", 0.0)]), (max(top, key=lambda t: t[1])[0], top)])
        return out

    return answer




# -- more of the inventory ------------------------------------------------------------------


@query(_NAMED_SQL + "SELECT experiment, probe_variant, up AS user_present, dp AS doc_present, uc AS user_correct, dc AS doc_correct, uf AS user_first FROM vx")
def variant_letter_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.letter_flags(merge.experiment_variants(_named(spark, sf_dir)).select("experiment", "probe_variant"))


@query(_NAMED_SQL + "SELECT experiment, 'U' || up::INT || 'D' || dp::INT || '_Ucorr' || uc::INT || 'Dcorr' || dc::INT AS condition, probe_variant FROM vx")
def condition_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant that shows each condition of an experiment, by its order."""
    named = _named(spark, sf_dir).withColumn("user_first", names.parsed(F.col("experiment"))["user_first"])
    return named.join(F.broadcast(dims.conditions(spark)), "user_first").drop("user_first")  # 18 rows


@query(BASE + "SELECT experiment, count(*) AS rows, count(DISTINCT qid) AS questions, count(*) = 9 * count(DISTINCT qid) AS complete FROM m GROUP BY experiment")
def experiment_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole.complete(fixtures.merged(spark, sf_dir))


@query("SELECT p_partkey, CAST('0x' || substr(md5(p_partkey::VARCHAR), 1, 8) AS BIGINT) AS base_seed, ((CAST('0x' || substr(md5(p_partkey::VARCHAR), 1, 8) AS HUGEINT) * 2654435761) % 4294967296)::BIGINT AS t1_seed, ((CAST('0x' || substr(md5(p_partkey::VARCHAR), 1, 8) AS HUGEINT) * 3141592653) % 4294967296)::BIGINT AS t2_seed FROM part")
def tier_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part").select("p_partkey", text.md5_number(F.col("p_partkey").cast("string")).alias("base_seed"))
    return df.withColumns(prep.seeds(F.col("base_seed")))


@query(BASE + """SELECT qid, 'I saw ' || concept || ' ' || gi AS t2_user_correct, CASE WHEN k % 5 = 0 THEN NULL ELSE 'Papers say ' || concept || ' ' || gi END AS t2_doc_correct,
CASE WHEN k % 5 = 0 THEN 'fields missing' WHEN k % 7 = 0 THEN 'answer missing in t2_doc_wrong' END AS error FROM cw""")
def tier2_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of which some lack a field and some an answer."""
    q = fixtures.canonical(spark, sf_dir).select("qid", F.col("gold_text").alias("correct_answer"), F.col("canonical_wrong_text").alias("wrong_answer"))
    k = F.col("qid").cast("long")
    lines = F.concat(F.lit("USER_CORRECT: I saw "), "correct_answer", F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("\nDOC_CORRECT: Papers say "), "correct_answer")), F.lit("\nUSER_WRONG: I saw "), "wrong_answer", F.lit("\nDOC_WRONG: Papers say "), F.when(k % 7 == 0, "nothing").otherwise(F.col("wrong_answer")))
    df = tiers.tier2_parsed(q.withColumn("reply", lines))
    user = F.when(F.col("t2_user_correct").isNull(), F.concat(F.lit("I saw "), "correct_answer")).otherwise(F.col("t2_user_correct"))
    return df.select("qid", user.alias("t2_user_correct"), "t2_doc_correct", "error")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'computer' ELSE 'law' END AS subject, CASE WHEN p_partkey % 2 = 0 THEN 'counting_and' ELSE 'algebra' END AS subtask FROM part")
def sample_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("p_partkey") % 2 == 0
    one = F.concat(F.lit("/x/samples_mmlu_pro_"), F.when(even, "computer_science").otherwise("law"), F.lit("_2024.jsonl"))
    two = F.concat(F.lit("/x/samples_math_"), F.when(even, "counting_and_probabilities").otherwise("algebra_2024"), F.lit(".jsonl"))
    return read(spark, sf_dir, "part").select("p_partkey", files.subject(one).alias("subject"), files.subtask(two, "math").alias("subtask"))


@query("SELECT doc_id, topic, score FROM (SELECT doc_id % 50 AS doc_id, lang AS topic, quality::DOUBLE AS score, row_number() OVER (PARTITION BY lang, doc_id % 50 ORDER BY doc_id DESC) AS n FROM labels JOIN documents USING (doc_id)) WHERE n = 1")
def last_sample_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("topic")), "doc_id")
    df = df.select((F.col("doc_id") % 50).alias("doc_id"), "topic", F.col("quality").cast("double").alias("score"), F.col("doc_id").alias("at"))
    return pairs.last_per_id(df, ["topic", "doc_id"], "at").drop("at")


@query(_POOL_SQL + ", hs AS (SELECT pool.*, target, row_number() OVER (PARTITION BY probe_variant ORDER BY md5((42 + ord) || '|' || qid), qid) AS n FROM pool JOIN tgt USING (probe_variant)) SELECT probe_variant, CASE WHEN grouping(tier) = 1 THEN NULL ELSE tier END AS tier, count(*) AS n FROM (SELECT *, 'tier1' AS tier FROM hs WHERE n <= target) GROUP BY CUBE (probe_variant, tier)")
def sft_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.tier_counts(sampling.balanced_sample(_narrow(spark, sf_dir), sampling.weight_table(spark, _STRATEGY), ["tier"]))


@query("SELECT p_partkey, CASE WHEN n < (t % 7) * (t // 7 + 1) THEN n // (t // 7 + 1) ELSE t % 7 + (n - (t % 7) * (t // 7 + 1)) // (t // 7) END::INTEGER AS part FROM (SELECT p_partkey, p_partkey - (SELECT min(p_partkey) FROM part) AS n, (SELECT count(*) FROM part) AS t FROM part)")
def range_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    low = part.agg(F.min("p_partkey")).first()[0]
    return sampling.range_parts(part.select("p_partkey", (F.col("p_partkey") - low).alias("at")), "at", 7).drop("at")


@query(BASE + "SELECT probe_variant, experiment AS from_experiment, CASE WHEN probe_variant IN ('bare', 'upos', 'uneg', 'dpos', 'dneg') THEN count(*) ELSE 0 END AS reused FROM (SELECT * FROM m WHERE experiment LIKE '%d1nu1n%') GROUP BY probe_variant, experiment")
def result_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which results of one experiment serve a sibling of the other order."""
    have = fixtures.merged(spark, sf_dir).where("experiment like '%d1nu1n%'").select("experiment", "qid", "probe_variant", "output_letter")
    wanted = have.select(F.lit(fixtures.EXPERIMENTS[1][0]).alias("experiment"), "probe_variant", "qid")
    found, _ = whole.shared_results(wanted, have)
    counts = found.groupBy("probe_variant").agg(F.count("*").alias("reused"))
    return have.select("probe_variant", F.col("experiment").alias("from_experiment")).distinct().join(counts, "probe_variant", "left").withColumn("reused", F.coalesce("reused", F.lit(0)))


@query("""SELECT p_partkey, p_name AS plain, 'Question: ' || p_name || chr(10) || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'C. ' || p_size ELSE '' END || chr(10) || chr(10)
|| 'Answer with ONLY the letter (' || CASE WHEN p_size % 2 = 0 THEN 'A, B or C' ELSE 'A or B' END || ') of your chosen answer.' || chr(10) || 'Answer: ' AS base_prompt FROM part""")
def base_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    choices = F.array_compact(F.array("p_brand", "p_type", F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string"))))
    asked = text.user_prompt(F.array(F.lit(None).cast("string")), F.col("p_name"), choices)
    quoted = F.concat(F.lit('"'), "p_name", F.lit('"'))
    return read(spark, sf_dir, "part").select("p_partkey", text.unquoted(quoted).alias("plain"), text.base_model_prompt(asked, text.letter_options(F.size(choices))).alias("base_prompt"))
