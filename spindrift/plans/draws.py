"""Registered queries of what seeded generators draw, and of the fits that need an SQL of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import dims, templates, text
from spindrift.operators import distribution, logit, prep, sampling, scoring
from spindrift.plans import draws_sql as mt
from spindrift.plans import fixtures, logit_sql
from spindrift.plans.registry import _POOL_SQL, _STRATEGY, _pool, _vectors, query, r6, read
from spindrift.plans.sql import BASE, SHIFT, rounded

# -- bootstrap ------------------------------------------------------------------------------

_BOUNDS = ["mean", "ci_low", "ci_high"]
_LONG = " UNION ALL ".join(f"SELECT experiment, probe_variant, qid, '{m}' AS metric, {m} AS value FROM sh" for m in distribution.SHIFTS)


@query(SHIFT.replace("WITH ex", "WITH RECURSIVE ex", 1) + f""", lg AS ({_LONG}),
vl AS (SELECT experiment, probe_variant, metric, value, row_number() OVER (PARTITION BY experiment, probe_variant, metric ORDER BY qid) - 1 AS rank, count(*) OVER (PARTITION BY experiment, probe_variant, metric) AS n FROM lg WHERE value IS NOT NULL AND isfinite(value)),
sz AS (SELECT DISTINCT n, (1::BIGINT << length(bin(n - 1))) AS mask FROM vl WHERE n >= 10),
{mt.plain_words(42)}, {mt.twisted('mt', '(SELECT max((1000.0 * mask + 16 * sqrt(1000.0 * mask) + 64) / 624 + 1) FROM sz)')}, {mt.outputs('tw')},
st AS (SELECT unnest(o) AS y, generate_subscripts(o, 1) AS pos FROM mo),
dr AS (SELECT n, y & (mask - 1) AS rank, row_number() OVER (PARTITION BY n ORDER BY pos) - 1 AS d FROM st, sz WHERE (y & (mask - 1)) < n),
ct AS (SELECT n, d // n AS resample, rank, count(*) AS c FROM dr WHERE d < 1000 * n GROUP BY n, d // n, rank),
mn AS (SELECT experiment, probe_variant, metric, resample, sum(c * value) / max(n) AS m FROM ct JOIN vl USING (n, rank) GROUP BY experiment, probe_variant, metric, resample),
bd AS (SELECT experiment, probe_variant, metric, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM mn GROUP BY experiment, probe_variant, metric),
av AS (SELECT experiment, probe_variant, metric, avg(value) AS mean, count(*) AS n FROM vl GROUP BY experiment, probe_variant, metric)
SELECT experiment, probe_variant, metric, n, {rounded(*_BOUNDS)} FROM av LEFT JOIN bd USING (experiment, probe_variant, metric)""")
def bootstrap_ci_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draws of the seeded generator, counted once for all groups of a size."""
    long = distribution.shift_metrics(_vectors(spark, sf_dir)).unpivot(["experiment", "probe_variant", "qid"], distribution.SHIFTS, "metric", "value")
    return r6(distribution.bootstrap_intervals(long, ["experiment", "probe_variant", "metric"]), *_BOUNDS)


# -- samples and splits ---------------------------------------------------------------------


@query(_POOL_SQL.replace("WITH ex", "WITH RECURSIVE ex", 1) + f""", jb AS (SELECT probe_variant, 42 + ord AS s, available AS n, least(available, target) AS k FROM tgt WHERE target > 0),
{mt.BASE_WORDS}, {mt.keyed_words('jb')}, {mt.twisted('mt', '(SELECT 2.2 * max(n) / 624 + 2 FROM jb)')}, {mt.outputs('tw')},
dl AS (SELECT jb.*, {mt.falling_draws('o', 'n', 'k')} AS dr FROM jb JOIN mo USING (s)),
sw AS (SELECT probe_variant, n, k, {mt.swapped('n', 'dr')} AS a FROM dl),
hit AS (SELECT probe_variant, t AS place, a[n - t] AS rank FROM (SELECT *, unnest(range(0, k)) AS t FROM sw) u),
rk AS (SELECT probe_variant, qid, row_number() OVER (PARTITION BY probe_variant ORDER BY qid) - 1 AS rank FROM pool)
SELECT probe_variant, qid, place FROM rk JOIN hit USING (probe_variant, rank)""")
def sft_sample_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws as the standard generator does, from the sorted questions of each variant."""
    out = sampling.exact_sample(_pool(spark, sf_dir).select("tier", "probe_variant", "qid"), sampling.weight_table(spark, _STRATEGY), ["tier"])
    return out.select("probe_variant", "qid", F.col("at").alias("place"))


_SHUFFLE = f""", jb AS (SELECT 42::BIGINT AS s, count(*) AS n FROM rk),
{mt.BASE_WORDS}, {mt.keyed_words('jb')}, {mt.twisted('mt', '(SELECT 2.2 * n / 624 + 2 FROM jb)')}, {mt.outputs('tw')},
dl AS (SELECT n, {mt.falling_draws('o', 'n', 'n - 1')} AS dr FROM jb JOIN mo USING (s)),
sw AS (SELECT n, {mt.swapped('n', 'dr')} AS a FROM dl),
ps AS (SELECT t AS place, a[t + 1] AS rank, n FROM (SELECT *, unnest(range(0, n)) AS t FROM sw) u)
"""


@query("WITH RECURSIVE rk AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS rank FROM (SELECT DISTINCT p_brand FROM part) d)" + _SHUFFLE + "SELECT p_partkey, p_brand, CASE WHEN place < floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'dev' END AS split FROM part JOIN rk USING (p_brand) JOIN ps USING (rank)")
def group_split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.exact_group_split(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand")


@query("WITH RECURSIVE rk AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS rank FROM part)" + _SHUFFLE + "SELECT p_partkey, place, CASE WHEN place < floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'dev' END AS split FROM rk JOIN ps USING (rank)")
def row_split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.exact_row_split(read(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"]).withColumnRenamed("at", "place")


@query(f"""WITH RECURSIVE rk AS (SELECT p_partkey::VARCHAR AS qid, row_number() OVER (ORDER BY p_partkey::VARCHAR) - 1 AS rank FROM part), jb AS (SELECT 42::BIGINT AS s, count(*) AS n, 100::BIGINT AS k FROM rk),
{mt.BASE_WORDS}, {mt.keyed_words('jb')}, {mt.twisted('mt', '2')}, {mt.outputs('tw')},
few AS (SELECT n, k, {mt.swapped('n', mt.falling_draws('o', 'n', 'k'))} AS a FROM jb JOIN mo USING (s) WHERE n <= 1045),
ins AS (SELECT y >> (32 - length(bin(n))) AS rank, n, k, pos FROM (SELECT n, k, unnest(o) AS y, generate_subscripts(o, 1) AS pos FROM jb JOIN mo USING (s) WHERE n > 1045) u),
first AS (SELECT rank, k, row_number() OVER (ORDER BY min(pos)) AS t FROM ins WHERE rank < n GROUP BY rank, k),
hit AS (SELECT a[n - t] AS rank FROM (SELECT *, unnest(range(0, k)) AS t FROM few) u UNION ALL SELECT rank FROM first WHERE t <= k)
SELECT qid FROM rk JOIN hit USING (rank)""")
def questions_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred questions of all (the feature: a fixed number of them)."""
    return sampling.exact_questions(fixtures.questions(spark, sf_dir), 100)


# -- templates ------------------------------------------------------------------------------


def _template_sql(tier: int, kind: str, seed: str) -> str:
    """``tpl(qid, s, user, doc)`` from ``q`` and a seed expression: one draw for each template, then one for each
    word that it has."""
    user, doc, user_slots, doc_slots, words = templates.TIERS[tier]
    lit = lambda x: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in x) + "]"
    slots, steps = [*user_slots, *doc_slots], []
    # draws of every seed that may be needed, for every size of a list, then looked up
    sizes = sorted({len(user), len(doc), *(len(words[kind][s]) for s in slots)})
    parts = [f"sd AS (SELECT qid, {seed} AS seed FROM q)", "ss AS (SELECT DISTINCT seed + unnest(range(0, 6)) AS s FROM sd)", mt.BASE_WORDS, mt.keyed_heads("ss"),
             "dw AS (SELECT s, " + ", ".join(f"{mt.first_draw('h', str(n))} AS d{n}" for n in sizes) + " FROM mt)"]
    parts.append(f"t0 AS (SELECT qid, seed, {lit(user)}[a.d{len(user)} + 1] AS \"user\", {lit(doc)}[b.d{len(doc)} + 1] AS doc, 2 AS used FROM sd JOIN dw a ON a.s = seed JOIN dw b ON b.s = seed + 1)")
    for i, slot in enumerate(slots):
        own, options = '"user"' if slot in user_slots else "doc", words[kind][slot]
        new = f"replace({own}, '{{{slot}}}', {lit(options)}[d{len(options)} + 1])"
        columns = f"{new} AS \"user\", doc" if slot in user_slots else f"\"user\", {new} AS doc"
        parts.append(f"t{i + 1} AS (SELECT qid, seed, {columns}, used + CASE WHEN contains({own}, '{{{slot}}}') THEN 1 ELSE 0 END AS used FROM t{i} JOIN dw ON dw.s = seed + used)")
        steps.append(slot)
    return ", ".join(parts) + f", tpl AS (SELECT qid, \"user\", doc FROM t{len(steps)})"


def _seed_sql(factor: int) -> str:
    return f"((CAST('0x' || substr(md5(qid), 1, 8) AS HUGEINT) * {factor}) % 4294967296)::BIGINT"


@query(BASE + ", " + _template_sql(1, "default", _seed_sql(2654435761)) + """ SELECT qid, replace("user", '{answer}', concept || ' ' || gi) AS user_sentence, replace(doc, '{answer}', concept || ' ' || gi) AS doc_sentence FROM tpl JOIN q USING (qid)""")
def t1_sentences_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates and words as the standard generator draws them from the question's seed."""
    q = fixtures.questions(spark, sf_dir)
    answer, seed = scoring.choice_text(F.col("choices"), F.col("gold")), prep.seeds(text.md5_number(F.col("qid")))["t1_seed"]
    df = q.select("qid", answer.alias("answer"), templates.exact_templates(seed, 1).alias("t"))
    return df.select("qid", *(templates.exact_sentence(F.col(f"t.{s}"), F.col("answer")).alias(f"{s}_sentence") for s in ("user", "doc")))


@query(BASE + ", " + _template_sql(2, "math", _seed_sql(3141592653)) + """ SELECT qid, "user" AS user_template, doc AS doc_template FROM tpl""")
def t2_templates_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = prep.seeds(text.md5_number(F.col("qid")))["t2_seed"]
    df = fixtures.questions(spark, sf_dir).select("qid", templates.exact_templates(seed, 2, "math").alias("t"))
    return df.select("qid", F.col("t.user").alias("user_template"), F.col("t.doc").alias("doc_template"))


# -- regression -----------------------------------------------------------------------------


def _fits(spark: SparkSession, sf_dir: str) -> list[tuple[str, logit.Fit]]:
    return sorted(logit.fits(fixtures.merged(spark, sf_dir)).items())


@query(logit_sql.COEFFICIENTS)
def logit_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(e, *c) for e, f in _fits(spark, sf_dir) for c in logit.coefficients(f)]
    names = ["estimate", "se", "z", "p", "low", "high", "odds", "odds_low", "odds_high"]
    return r6(spark.createDataFrame(rows, "experiment string, term string, " + ", ".join(f"{n} double" for n in names)), *names)


@query(logit_sql.ODDS)
def logit_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(e, k, *(v or (None,) * 3)) for e, f in _fits(spark, sf_dir) for k, v in logit.odds(f).items()]
    return r6(spark.createDataFrame(rows, "experiment string, ratio string, value double, low double, high double"), "value", "low", "high")


@query(logit_sql.STATISTICS)
def logit_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(e, *logit.statistics(f).values()) for e, f in _fits(spark, sf_dir)]
    out = spark.createDataFrame(rows, "experiment string, converged boolean, n long, clusters long, df int, pseudo_r2 double, llf double, llnull double, llr_p double, aic double, bic double")
    return r6(out, "pseudo_r2", "llf", "llnull", "llr_p", "aic", "bic")


@query(logit_sql.ODDS_TABLE)
def logit_odds_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(e, *r) for e, f in _fits(spark, sf_dir) for r in logit.odds_table(f)]
    return spark.createDataFrame(rows, "experiment string, name string, ratio double, low double, high double")


@query(logit_sql.REPORT)
def report_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regression's part of the cross-experiment report: one row an experiment."""
    from spindrift.operators import report

    columns = [f"odds_ratio_{n}{b}" for n in [*logit.ODDS_NAMES.values(), *logit.RATIO_NAMES.values()] for b in ("", "_ci_lower", "_ci_upper")]
    rows = spark.createDataFrame(logit.report_rows(dict(_fits(spark, sf_dir))), "experiment string, metric string, value double")
    out = report.wide(rows, columns)
    return r6(out, *(c for c in columns if c in out.columns and "_ci_" in c))


@query()
def logit_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms without a finite estimate, where only rows without sources are fitted (``only_bare``) and where a user who
    is right is always followed (``as_told``)."""
    m = fixtures.merged(spark, sf_dir)
    bare = m.where("probe_variant = 'bare'").withColumn("experiment", F.concat("experiment", F.lit("/only_bare")))
    told = m.withColumn("output_correct", F.col("output_correct") | (F.col("user_present") & F.col("user_correct"))).withColumn("experiment", F.concat("experiment", F.lit("/as_told")))
    rows = logit.term_states(m.unionByName(bare).unionByName(told))
    return spark.createDataFrame(rows, "experiment string, term string, state string")


@query(logit_sql.LOG)
def regression_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text log of each experiment's regression."""
    rows = [(e, i, line) for e, f in _fits(spark, sf_dir) for i, line in enumerate(logit.summary_lines(e, f))]
    return spark.createDataFrame(rows, "experiment string, place int, line string")
