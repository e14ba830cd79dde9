"""A store of metrics with one partition an experiment: written side by side, skipped where whole, failures kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.plans import experiment as whole
from spindrift.session import written
from spindrift.sources import files

#: The kind of the row that says why an experiment has no metrics.
FAILED = "failed"


def experiment_errors(merged: DataFrame) -> DataFrame:
    """``experiment, error``: the first reason for which an experiment's metrics would be wrong."""
    each = merged.groupBy("experiment", "qid", "probe_variant").agg(F.count("*").alias("n"), F.count_if(F.col("gold").isNull() | F.col("output_correct").isNull()).alias("blank"))
    sums = each.groupBy("experiment").agg(F.count_if(F.col("probe_variant") == "bare").alias("bare"), F.max("n").alias("n"), F.sum("blank").alias("blank"), F.count_if(F.col("probe_variant") != "bare").alias("told"))
    error = F.when(F.col("bare") == 0, "no row without sources").when(F.col("told") == 0, "no row with sources").when(F.col("n") > 1, "several rows of one question and variant").when(F.col("blank") > 0, "a row without a right answer or an outcome")
    return sums.select("experiment", error.alias("error")).where("error is not null")


def kind_of(metric: str = "metric"):
    """The kind of metric by its name."""
    m = F.col(metric)
    return F.when(m.startswith("choice_"), "choice").when(m.startswith("distribution_"), "distribution").otherwise("logistic")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``experiment, kind, metric, value, error`` of the store, an empty table if there is none."""
    schema = "kind string, metric string, value double, error string, experiment string"
    found = spark.read.schema(schema).parquet(path) if files.exists(spark, path) else spark.createDataFrame([], schema)
    return found.select("experiment", "kind", "metric", "value", "error")


def store_metrics(merged: DataFrame, path: str, skip_existing: bool = True) -> None:
    """Write the metrics of all experiments of ``merged`` in one job, each into its own partition.

    Experiments that have every kind of metric are skipped. One that can't be computed gets a row with the reason instead
    (and loses what it had), and the others are written all the same. An experiment that is written replaces what it had,
    failures too; experiments that ``merged`` has not stay as they are.
    """
    spark = merged.sparkSession
    if skip_existing:
        have = read_store(spark, path).select("experiment", F.col("kind").alias("metric")).distinct()
        merged = whole.pending(merged, have)
    merged = written(merged, "merged")  # read by every kind of metric
    errors = written(experiment_errors(merged), "errors")
    good = merged.join(F.broadcast(errors), "experiment", "left_anti")  # one row an experiment
    rows = whole.metrics(good).select("experiment", kind_of().alias("kind"), "metric", "value", F.lit(None).cast("string").alias("error"))
    failed = errors.select("experiment", F.lit(FAILED).alias("kind"), F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value"), "error")
    out = rows.unionByName(failed).repartition("experiment")
    out.write.partitionBy("experiment").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
