"""Preparation of question sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import canonical_space


def to_questions(raw: DataFrame) -> DataFrame:
    """Rows with ``question`` (or ``Question``), one column a letter and ``Answer`` as questions with an id
    by MD5."""
    letters = sorted(c for c in raw.columns if len(c) == 1 and c.isalpha())
    question = F.col("question" if "question" in raw.columns else "Question")
    choices = F.struct(F.array(*(F.lit(c) for c in letters)).alias("label"), F.array(*(F.col(c).cast("string") for c in letters)).alias("text"))
    return raw.select(F.md5(question).alias("id"), question.alias("question"), choices.alias("choices"), F.col("Answer").alias("answerKey"))


def attach_reasoning(questions: DataFrame, gold: DataFrame, question: str = "question", order: str = "pos") -> DataFrame:
    """Adds ``gold_reasoning`` by the question's text, white space aside; of several the last in order, and
    only where it is not empty."""
    right = gold.groupBy(canonical_space(F.col(question)).alias("_k")).agg(F.max_by("answer", order).alias("gold_reasoning"))
    out = questions.withColumn("_k", canonical_space(F.col(question))).join(right, "_k", "left").drop("_k")
    return out.withColumn("gold_reasoning", F.when(F.col("gold_reasoning") != "", F.col("gold_reasoning")))


def normalised_choices(choices_list: Column) -> Column:
    """The list form of choices as labels and texts."""
    return F.struct(F.transform(choices_list, lambda _, i: F.char(F.lit(65) + i)).alias("label"), choices_list.alias("text"))


def concepts(questions: DataFrame, concept: str) -> DataFrame:
    return questions.groupBy(concept).agg(F.count("*").alias("n"))


def seeds(base: Column) -> dict[str, Column]:
    """Two seeds modulo 2 ** 32 from one base, by fixed multipliers."""
    big = base.cast("decimal(20,0)")
    return {"t1_seed": ((big * F.lit(2654435761).cast("decimal(18,0)")) % F.lit(1 << 32)).cast("long"), "t2_seed": ((big * F.lit(3141592653).cast("decimal(18,0)")) % F.lit(1 << 32)).cast("long")}


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows in order."""
    return df.orderBy(order).limit(n)


def with_listed_choices(raw: DataFrame) -> DataFrame:
    """Questions whose choices are a plain list."""
    return raw.withColumn("choices", normalised_choices(F.col("choices")))


#: How questions of each configured type are prepared.
PREPARERS = {"csqa_custom_split": with_listed_choices, "gsm8k_mc_custom_split": to_questions}
