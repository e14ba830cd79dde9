"""A multiple-choice experiment derived from ``part``, and the texts that text operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.text import letter
from spindrift.operators.canonical import canonical_wrong
from spindrift.operators.merge import experiment_variants, merge_results
from spindrift.operators.scoring import probe_results
from spindrift.session import written

#: (name, weight of the user's assertion, weight of the document's)
EXPERIMENTS = [("csqa__qwen3_8b__d1nu1nin__nocot", 1.5, 2.5), ("csqa__qwen3_8b__u1nd1nin__nocot", 2.5, 1.5)]

#: Questions that a partition holds, on average, at most: a task sorts eighteen rows of each.
DEALT = 10_000


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions_of(spark.read.parquet(f"{sf_dir}/part.parquet"))


def questions_of(part: DataFrame) -> DataFrame:
    """The questions, dealt by their ids once: what is made of a question stays in its partition, so windows over the
    variants of a question need no other shuffle, and one small file is not one task. There are as many partitions as
    the session's shuffles have, and more for larger tables, so that no task's share grows with the table."""
    k, part = F.col("p_partkey"), part.select("p_partkey", "p_name", "p_brand")
    choices = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat("p_brand", F.lit(" "), i.cast("string")))
    bare = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (((k + 1) * 7919 + i * 104729) % 1009) / F.lit(100.0) + F.when(i == (k * 31 + 7) % 5, 2.0).otherwise(0.0))
    made = part.select(k.alias("k"), k.cast("string").alias("qid"), F.col("p_name").alias("question"), F.col("p_brand").alias("concept"), choices.alias("choices"), letter(((k * 31 + 7) % 5).cast("int")).alias("gold"), F.when(k % 37 == 0, F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.lit(-100.0))).otherwise(bare).alias("logits"))
    return made.repartition(max(int(part.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-part.count() // DEALT)), "qid")


def experiments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXPERIMENTS, "experiment string, uw double, dw double")


def bare_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe_results(questions(spark, sf_dir))


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_wrong(bare_results(spark, sf_dir))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of all variants of both experiments: the bare logits, raised where a source asserts."""
    return probes_of(spark, questions(spark, sf_dir), wrong_answers(spark, sf_dir))


def probes_of(spark: SparkSession, asked: DataFrame, wrong: DataFrame, *carried: str) -> DataFrame:
    """``carried``: columns of the questions and their wrong answers that each row keeps."""
    q = asked.join(wrong, "qid")
    dims = experiment_variants(experiments(spark)).join(experiments(spark), "experiment")
    df = q.join(F.broadcast(dims))  # 18 rows
    told = lambda present, right, weight, i: F.when(F.col(present) & (letter(i) == F.when(F.col(right), F.col("gold")).otherwise(F.col("canonical_wrong"))), F.col(weight)).otherwise(0.0)
    raised = F.transform("logits", lambda x, i: x + told("user_present", "user_correct", "uw", i) + told("doc_present", "doc_correct", "dw", i))
    df = df.withColumn("logits", F.when(F.col("k") % 37 == 0, F.col("logits")).otherwise(raised))
    return probe_results(df).select("experiment", "qid", "probe_variant", "gold", "choices", "concept", "output_letter", "output_correct", "probs", "max_prob", *carried)


def wrong_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, canonical_wrong``, written once for all that needs it."""
    return written(canonical(spark, sf_dir).select("qid", "canonical_wrong"), "canonical")


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows carry their question's wrong answer, so the merged table is neither shuffled nor sorted for it again."""
    return merge_results(probes_of(spark, questions(spark, sf_dir), wrong_answers(spark, sf_dir), "canonical_wrong"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token logits of the questions without sources: each letter as a token, in lower case or with a blank
    before it by turns; none for every 37th question."""
    q = questions(spark, sf_dir).select("k", "qid", F.posexplode("logits").alias("i", "logit"))
    form = F.when((F.col("k") + F.col("i")) % 3 == 0, F.lower(letter(F.col("i")))).when((F.col("k") + F.col("i")) % 3 == 1, F.concat(F.lit(" "), letter(F.col("i")))).otherwise(letter(F.col("i")))
    token = F.when(F.col("k") % 37 == 0, F.lit("the")).otherwise(form)
    return q.select("qid", F.lit("bare").alias("probe_variant"), (F.col("i") + 1).alias("rank"), token.alias("token"), "logit")
