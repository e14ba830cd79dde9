"""Choice metrics: how answers move from the result without sources to the result with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.merge import with_bare

SINGLE = {"upos": "user", "uneg": "user", "dpos": "document", "dneg": "document"}


def ratio(n: Column, d: Column) -> Column:
    """Null unless the denominator is positive."""
    return F.when(d > 0, n.cast("double") / d)


def choice_rows(merged: DataFrame) -> DataFrame:
    """Each single-source result beside the question's result without sources, with outcome flags.

    A null on either side makes answers differ.
    """
    df = with_bare(merged, ["output_letter", "output_correct"]).where("bare is not null").where(F.col("probe_variant").isin(list(SINGLE)))
    df = df.select("experiment", "qid", "probe_variant", "output_letter", "gold", "canonical_wrong", "user_present", "doc_present", "user_correct", "doc_correct", F.col("bare.output_letter").alias("bare_letter"), F.col("bare.output_correct").alias("bare_correct"))
    source = F.when(F.col("probe_variant").startswith("u"), "user").otherwise("document")
    present = F.when(source == "user", F.col("user_present")).otherwise(F.col("doc_present"))
    right = F.when(source == "user", F.col("user_correct")).otherwise(F.col("doc_correct"))
    df = df.withColumns({"source": source, "source_correct": right, "suggestion": F.when(right, F.col("gold")).otherwise(F.col("canonical_wrong"))}).where(present)
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    df = df.withColumns({"stick": same("output_letter", "bare_letter"), "adopt": same("output_letter", "suggestion")})
    return df.withColumns({"conflict": F.coalesce(F.col("suggestion") != F.col("bare_letter"), F.lit(True)), "prior_base": ~F.col("bare_correct") & F.col("source_correct"), "context_base": F.col("bare_correct") & ~F.col("source_correct")})


def choice_metrics(merged: DataFrame) -> DataFrame:
    """One row an experiment and single-source variant: conflict rates (own answer kept, source followed,
    their share), and what becomes of wrong priors and right priors. Rates with an empty base are null."""
    df = choice_rows(merged)
    n = lambda cond: F.count_if(cond)
    conflict, stick, adopt = F.col("conflict"), F.col("stick"), F.col("adopt")
    prior, context = F.col("prior_base"), F.col("context_base")
    out = df.groupBy("experiment", "probe_variant", "source").agg(
        F.count("*").alias("n_present"),
        n(conflict).alias("n_conflict"),
        n(conflict & stick).alias("_oar"),
        n(conflict & adopt).alias("_car"),
        n(prior).alias("n_prior"),
        n(prior & stick).alias("_pb"),
        n(prior & adopt).alias("_pc"),
        n(prior & ~stick & ~adopt).alias("_pn"),
        n(context).alias("n_context"),
        n(context & adopt).alias("_cb"),
        n(context & stick).alias("_cr"),
        n(context & ~stick & ~adopt).alias("_cn"),
    )
    made = {
        "own_answer_rate": ratio(F.col("_oar"), F.col("n_conflict")),
        "context_answer_rate": ratio(F.col("_car"), F.col("n_conflict")),
        "memory_ratio": ratio(F.col("_oar"), F.col("_oar") + F.col("_car")),
        "prior_bias": ratio(F.col("_pb"), F.col("n_prior")),
        "prior_correction": ratio(F.col("_pc"), F.col("n_prior")),
        "prior_neither": ratio(F.col("_pn"), F.col("n_prior")),
        "context_bias": ratio(F.col("_cb"), F.col("n_context")),
        "context_robustness": ratio(F.col("_cr"), F.col("n_context")),
        "context_neither": ratio(F.col("_cn"), F.col("n_context")),
    }
    return out.select("experiment", "probe_variant", "source", "n_present", "n_conflict", "n_prior", "n_context", *(c.alias(k) for k, c in made.items()))


METRICS = ["own_answer_rate", "context_answer_rate", "memory_ratio", "prior_bias", "prior_correction", "prior_neither", "context_bias", "context_robustness", "context_neither"]


def source_averages(metrics: DataFrame) -> DataFrame:
    """Mean over an experiment's variants of each source; variants without a value do not count."""
    return metrics.groupBy("experiment", "source").agg(*(F.avg(m).alias(m) for m in METRICS))


def accuracy(merged: DataFrame) -> DataFrame:
    return merged.groupBy("experiment", "probe_variant").agg(F.count("*").alias("n"), F.avg(F.col("output_correct").cast("double")).alias("accuracy"))


def changed(merged: DataFrame) -> DataFrame:
    """Against the result without sources: answers changed, helped, hurt, for each other variant."""
    df = with_bare(merged, ["output_letter", "output_correct"]).where("bare is not null and probe_variant <> 'bare'")
    df = df.withColumns({"b": F.col("bare.output_letter"), "bc": F.col("bare.output_correct")})
    return df.groupBy("experiment", "probe_variant").agg(F.count("*").alias("n"), F.count_if(F.col("b") != F.col("output_letter")).alias("changed"), F.count_if(~F.col("bc") & F.col("output_correct")).alias("helped"), F.count_if(F.col("bc") & ~F.col("output_correct")).alias("hurt"))
