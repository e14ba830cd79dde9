"""Paired comparison of two models on the same samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_per_id(samples: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with the same keys the last one in order."""
    return samples.groupBy(keys).agg(F.max_by(F.struct(*[c for c in samples.columns if c not in keys]), order).alias("_r")).select(*keys, "_r.*")


def last_read(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with the same keys the last one as they are read."""
    return last_per_id(df.withColumn("_read", F.monotonically_increasing_id()), keys, "_read").drop("_read")


def score(acc: str = "acc", match: str = "exact_match"):
    return F.coalesce(F.col(acc), F.col(match), F.lit(0.0))


def paired(base: DataFrame, tuned: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """``keys, base, tuned``. Strict: every sample of base must be there, a missing one is an error."""
    b, t = base.select(*keys, F.col("score").alias("base")), tuned.select(*keys, F.col("score").alias("tuned"))
    if not strict:
        return b.join(t, keys)
    df = b.join(t.withColumn("_have", F.lit(True)), keys, "left")
    said = F.concat(F.lit("sample missing in the tuned model: "), F.concat_ws("_", *(F.col(k).cast("string") for k in keys)))
    return df.withColumn("tuned", F.when(F.col("_have"), F.col("tuned")).otherwise(F.raise_error(said).cast("double"))).drop("_have")


def outcomes(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Both right, gained, forgotten, both wrong (which takes whatever is not exactly 0 or 1)."""
    b, t = F.col("base"), F.col("tuned")
    is_ = lambda x, y: F.coalesce((b == x) & (t == y), F.lit(False))
    out = pairs.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(is_(1, 1)).alias("both_correct"), F.count_if(is_(0, 1)).alias("gain"), F.count_if(is_(1, 0)).alias("forget"))
    out = out.withColumn("both_wrong", F.col("total") - F.col("both_correct") - F.col("gain") - F.col("forget"))
    share = lambda c: F.when(F.col("total") > 0, c.cast("double") / F.col("total"))
    return out.withColumns({"base_acc": share(F.col("both_correct") + F.col("forget")), "tuned_acc": share(F.col("both_correct") + F.col("gain")), "net": share(F.col("gain") - F.col("forget"))})


def outcome_ids(pairs: DataFrame, id_: str) -> DataFrame:
    """One row for each gained or forgotten sample, in order of its id within its outcome."""
    kind = F.when((F.col("base") == 0) & (F.col("tuned") == 1), "gain").when((F.col("base") == 1) & (F.col("tuned") == 0), "forget")
    return pairs.select(kind.alias("outcome"), F.col(id_)).where("outcome is not null")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Order-preserving distinct: the first row of each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
