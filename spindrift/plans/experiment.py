"""Whole experiments: from questions to the report, as one chain of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.names import parsed
from spindrift.functions.text import system_prompt, user_prompt
from spindrift.operators import breakdown, choice, distribution, logit, merge, report
from spindrift.operators.pairs import last_read
from spindrift.operators.tiers import source_sentence


def prompts(questions: DataFrame, experiments: DataFrame, sentences: DataFrame | None = None, reasoning: DataFrame | None = None) -> DataFrame:
    """``experiment, qid, probe_variant, n_choices, system_prompt, user_prompt`` for every question and variant.

    A question without the sentence that a variant needs is an error. With ``reasoning`` (``experiment, probe_variant,
    qid, thinking_with_tags``; the last of several rows counts) there is also ``scored_prompt``: experiments of
    reasoning models end with the trace and then ask for the answer, others are as they are. A reasoning model's question
    without a trace, or with an empty one, is an error of the plan that reads it.
    """
    named = merge.experiment_variants(experiments).withColumn("_p", parsed(F.col("experiment")))
    df = questions.join(F.broadcast(named))  # nine rows an experiment
    if sentences is not None:
        df = df.join(sentences, "qid", "left")
        user, doc = (source_sentence(s, F.col(f"_p.{s}_tier"), F.col(f"{s}_correct")) for s in ("user", "doc"))
        need = lambda present, s: F.when(F.col(present), F.coalesce(s, F.raise_error(F.concat(F.lit("no sentence for question "), "qid")).cast("string")))
        user, doc = need("user_present", user), need("doc_present", doc)
        told = F.when(F.col("_p.user_first"), F.array(user, doc)).otherwise(F.array(doc, user))
    else:
        df = df.where("not user_present and not doc_present")
        told = F.array(F.lit(None).cast("string"))
    n, asked = F.size("choices"), user_prompt(told, F.col("question"), F.col("choices"))
    if reasoning is None:
        extra = []
    else:
        df, told = df.withColumn("_told", told), F.col("_told")
        last = last_read(reasoning, ["experiment", "probe_variant", "qid"]).withColumnRenamed("thinking_with_tags", "_trace").select("experiment", "probe_variant", "qid", "_trace")
        df = df.join(last, ["experiment", "probe_variant", "qid"], "left")
        lacking = F.raise_error(F.concat(F.lit("no reasoning for question "), "qid", F.lit(" of "), "probe_variant")).cast("string")
        trace = F.when(F.coalesce(F.col("_trace"), F.lit("")) == "", lacking).otherwise(F.col("_trace"))
        plain, open_ = (user_prompt(told, F.col("question"), F.col("choices"), answer_line=line) for line in (True, False))
        thinks = F.col("_p.reasoning_mode")
        asked = F.when(thinks, open_).otherwise(plain)
        extra = [F.when(thinks, F.concat(open_, trace, F.lit(" Answer: "))).otherwise(plain).alias("scored_prompt")]
    return df.select("experiment", "qid", "probe_variant", "gold", "choices", n.alias("n_choices"), system_prompt(F.col("_p.instruction"), n).alias("system_prompt"), asked.alias("user_prompt"), *extra)


def reuse_key(df: DataFrame) -> DataFrame:
    """Adds ``scope``: experiments of equal scope share a variant's results. Results without sources depend
    on neither tier nor order, single sources on their own tier and strength only, doubles on everything."""
    p = parsed(F.col("experiment"))
    base = F.concat_ws("|", p["dataset"], p["model_token"], p["instruction"], p["use_cot"].cast("string"))
    one = lambda s: F.concat_ws("|", base, F.lit(s), p[f"{s}_tier"].cast("string"), p[f"{s}_strength"])
    v = F.col("probe_variant")
    return df.withColumn("scope", F.when(v == "bare", base).when(v.isin("upos", "uneg"), one("user")).when(v.isin("dpos", "dneg"), one("doc")).otherwise(F.concat_ws("|", base, "experiment")))


def shared_results(wanted: DataFrame, have: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wanted rows with a result that some experiment of the same scope has, rows still to be scored)."""
    known = reuse_key(have).groupBy("scope", "probe_variant", "qid").agg(F.first(F.struct(*[c for c in have.columns if c not in ("experiment", "probe_variant", "qid")])).alias("r"))
    keyed = reuse_key(wanted)
    found = keyed.join(known, ["scope", "probe_variant", "qid"]).select("experiment", "probe_variant", "qid", "r.*")
    return found, keyed.join(known, ["scope", "probe_variant", "qid"], "left_anti").drop("scope")


#: Kinds of metrics that an experiment is asked for.
METRIC_KINDS = ["logistic", "choice", "distribution"]


def expected_files(experiments: DataFrame, questions: int) -> DataFrame:
    """``experiment, file, lines``: results of nine variants, canonical wrong answers and the merged table;
    reasoning models also have a file of reasoning for each variant."""
    named = merge.experiment_variants(experiments).withColumn("_r", parsed(F.col("experiment"))["reasoning_mode"])
    own = named.select("experiment", F.concat(F.lit("probs_"), "probe_variant", F.lit(".jsonl")).alias("file"))
    thought = named.where("_r").select("experiment", F.concat("probe_variant", F.lit("_vllm_reasoning.jsonl")).alias("file"))
    single = experiments.select("experiment", F.explode(F.array(F.lit("canonical_wrong.jsonl"), F.lit("merged_results.jsonl"))).alias("file"))
    lines = F.when(F.col("file") == "merged_results.jsonl", 9 * questions).otherwise(questions).cast("long")
    return own.unionByName(thought).unionByName(single).withColumn("lines", lines)


def files_complete(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """``experiment, files, missing, complete``: a file counts if it has the lines it should have."""
    found = have.select("experiment", "file", F.col("lines").alias("_have"))
    df = wanted.join(found, ["experiment", "file"], "left")
    lacks = F.coalesce(F.col("_have") != F.col("lines"), F.lit(True)) | (F.col("lines") == 0)
    out = df.groupBy("experiment").agg(F.count("*").alias("files"), F.count_if(lacks).alias("missing"))
    return out.withColumn("complete", F.col("missing") == 0)


def metric_presence(experiments: DataFrame, have: DataFrame, wanted: list[str] = METRIC_KINDS) -> DataFrame:
    """``experiment, complete``: whether all wanted kinds of ``have`` (``experiment, metric``) are there."""
    n = have.where(F.col("metric").isin(wanted)).groupBy("experiment").agg(F.count_distinct("metric").alias("_n"))
    return experiments.join(n, "experiment", "left").select("experiment", (F.coalesce("_n", F.lit(0)) == len(wanted)).alias("complete"))


def pending(merged: DataFrame, have: DataFrame, wanted: list[str] = METRIC_KINDS) -> DataFrame:
    """The rows of experiments that lack one of the wanted kinds: the others are skipped."""
    done = metric_presence(have.select("experiment").distinct(), have, wanted).where("complete")
    return merged.join(done, "experiment", "left_anti")


def metrics(merged: DataFrame) -> DataFrame:
    """All metrics of all experiments as long rows: one job where a pool of processes would go one by one. An
    experiment whose regression cannot be told apart has null there and all else."""
    rows = report.long_rows(choice.choice_metrics(merged), choice.METRICS, "choice")
    shifts = distribution.means(distribution.shift_metrics(distribution.prob_vectors(merged)))
    rows = rows.unionByName(report.long_rows(shifts, distribution.SHIFTS, "distribution"))
    flat = breakdown.breakdown(merged)
    rows = rows.unionByName(report.long_rows(flat, ["correct_rate", "unknown_rate"], "breakdown", "condition"))
    ratios = merged.sparkSession.createDataFrame(logit.report_rows(logit.fits(merged)), "experiment string, metric string, value double")
    return rows.unionByName(ratios)


def complete(merged: DataFrame) -> DataFrame:
    """Experiments with nine rows for every question."""
    sizes = merged.groupBy("experiment").agg(F.count("*").alias("rows"), F.countDistinct("qid").alias("questions"))
    return sizes.withColumn("complete", F.col("rows") == 9 * F.col("questions"))
