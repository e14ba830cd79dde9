"""Incremental scoring: new questions arrive as files and leave as probe results.

The reference tables are plain batches; this is the same expression over a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.operators.scoring import probe_results

QUESTIONS = "qid string, gold string, choices array<string>, logits array<double>"


def results_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Probe results of questions with logits, file by file. Nothing is kept between batches."""
    return probe_results(spark.readStream.schema(QUESTIONS).json(folder))


def write_stream(df: DataFrame, out: str, checkpoint: str):
    """Append to Parquet; the checkpoint makes a restart go on where it stopped."""
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
