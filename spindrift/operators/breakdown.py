"""Rates by which sources are present and right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAGS = ["user_present", "doc_present", "user_correct", "doc_correct"]


def condition_key() -> Column:
    bit = lambda c: F.col(c).cast("int")
    return F.format_string("U%dD%d_Ucorr%dDcorr%d", *(bit(c) for c in FLAGS))


def condition_text() -> Column:
    word = lambda c, a, b: F.when(F.col(c), a).otherwise(b)
    return F.format_string("User %s (%s), Doc %s (%s)", word("user_present", "present", "absent"), word("user_correct", "correct", "wrong"), word("doc_present", "present", "absent"), word("doc_correct", "correct", "wrong"))


def breakdown(merged: DataFrame) -> DataFrame:
    """Correct and unknown rates of each condition, from one aggregation."""
    unknown = (F.col("output_letter") == "UNKNOWN").cast("double")
    out = merged.groupBy("experiment", *FLAGS).agg(F.count("*").alias("n"), F.avg(F.col("output_correct").cast("double")).alias("correct_rate"), F.avg(unknown).alias("unknown_rate"), F.count_if(F.col("output_letter") == "UNKNOWN").alias("unknown_count"))
    return out.select("experiment", condition_key().alias("condition"), condition_text().alias("description"), "n", "correct_rate", "unknown_rate", "unknown_count")


def overall(merged: DataFrame) -> DataFrame:
    unknown = F.col("output_letter") == "UNKNOWN"
    return merged.groupBy("experiment").agg(F.count("*").alias("n"), F.countDistinct("qid").alias("questions"), F.countDistinct("probe_variant").alias("variants"), F.avg(F.col("output_correct").cast("double")).alias("correct_rate"), F.avg(unknown.cast("double")).alias("unknown_rate"), F.count_if(unknown).alias("unknown_count"))
