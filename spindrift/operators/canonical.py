"""The canonical wrong answer of each question, from the results without sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import letter, md5_number
from spindrift.operators.scoring import choice_text


def unknown_pick(qid: Column, gold: Column, n_choices: Column) -> Column:
    """A wrong letter by the MD5 of the question's id; A or B where there is none."""
    wrong = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n_choices, F.lit(1)) - 1), lambda i: letter(i)), lambda x: x != gold)
    pick = F.get(wrong, (md5_number(qid) % F.greatest(F.size(wrong), F.lit(1))).cast("int"))
    return F.coalesce(pick, F.when(gold != "A", "A").otherwise("B"))


def canonical_wrong(bare: DataFrame) -> DataFrame:
    """``qid, gold, gold_text, canonical_wrong, canonical_wrong_text``.

    No usable output: :func:`unknown_pick`. A wrong answer: that one. Else the most probable other
    choice, the first of equals.
    """
    others = F.filter("probs", lambda p: p["letter"] != F.col("gold"))
    top = F.array_max(F.transform(others, lambda p: p["prob"]))
    likely = F.get(F.filter(others, lambda p: p["prob"] == top), F.lit(0))["letter"]
    usable = F.col("output_letter").rlike("^[A-Z]$")
    # an answer that is no letter counts as none
    wrong = F.when(F.col("output_letter").isNotNull() & ~usable, unknown_pick(F.col("qid"), F.col("gold"), F.size("choices"))).when(F.col("output_letter") != F.col("gold"), F.col("output_letter")).otherwise(F.coalesce(likely, F.when(F.col("gold") != "A", "A").otherwise("B")))
    df = bare.select("qid", "gold", "choices", wrong.alias("canonical_wrong"))
    return df.select("qid", "gold", choice_text(F.col("choices"), F.col("gold")).alias("gold_text"), "canonical_wrong", choice_text(F.col("choices"), F.col("canonical_wrong")).alias("canonical_wrong_text"))
