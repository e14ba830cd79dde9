"""Corpus pipeline: quality rules, line dedup, near-duplicate join, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet into the
shared folder and reads it again as the next one's documents. All but the last return the columns of
``documents``; other columns are not carried, whatever their names. A null text fails the base rules, so it
goes in the first stage; a document with a null id is kept by the join, which names copies by their ids. An
empty table passes every stage empty. Rows of one id and text are judged alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import SPACE, table, written
from spindrift.llm.decontaminate import without_items
from spindrift.llm.jaccard import linked_classes
from spindrift.llm.linededup import dedup_lines
from spindrift.llm.quality import judge_documents, learn_lists
from spindrift.llm.sentencepiece import encode_texts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = "[^" + SPACE[1:]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a learned decision list (low quality, toxic) reject go."""
    labels = table(spark, sf_dir, "labels")
    return judge_documents(docs, *learn_lists(docs, labels)).where("kept").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; so do documents left without a word, such as whole copies."""
    out = dedup_lines(docs)
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest id stays."""
    classes = linked_classes(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(written(classes, "copies").hint("merge"), "doc_id", "left_anti").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_items(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, checked by decoding them again."""
    import public_tokenizers

    return encode_texts(docs.select(COLUMNS), public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("SentencePiece encoding", tokens)]

#: The learned rules, the line dedup, the join and the encoder are beyond one SQL text.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
