"""From token logits to answer distributions, and the interface to models that produce them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions.columns import computed
from spindrift.functions.text import index_of, letter

#: Fixed value: logit of a letter that is not among the inspected tokens.
ABSENT = -100.0


def letter_logits(tokens: DataFrame, choices: DataFrame, top: int = 100) -> DataFrame:
    """``qid, probe_variant, letters, logits, seen``: for every question and variant one logit a choice.

    ``tokens`` has ``qid, probe_variant, rank, token, logit``; only the first ``top`` ranks count. A token
    counts for a letter if, trimmed, it is that one character in either case; the largest logit wins and
    missing letters get ``ABSENT``. ``choices`` has ``qid, n_choices``.
    """
    trimmed = F.upper(F.trim("token"))
    one = tokens.where((F.col("rank") <= top) & (F.length(F.trim("token")) == 1)).withColumn("letter", trimmed)
    keys = tokens.select("qid", "probe_variant").distinct().join(choices, "qid")
    best = one.groupBy("qid", "probe_variant").agg(F.collect_list(F.struct("letter", "logit")).alias("found"))  # at most ``top`` a group
    df = keys.join(best, ["qid", "probe_variant"], "left")
    letters = F.transform(F.sequence(F.lit(0), F.col("n_choices") - 1), lambda i: letter(i))
    value = lambda x: F.coalesce(F.array_max(F.transform(F.filter("found", lambda p: p["letter"] == x), lambda p: p["logit"])), F.lit(ABSENT))
    df = df.withColumn("letters", letters).withColumn("logits", F.transform("letters", value))
    return df.withColumn("seen", F.exists("logits", lambda v: v > F.lit(ABSENT))).drop("found")


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x))
    return F.transform(logits, lambda x: x - top - total)


def probe_results(df: DataFrame) -> DataFrame:
    """Adds ``probs``, ``output_letter``, ``output_correct`` and ``max_prob`` to rows with ``gold``,
    ``choices`` and ``logits``. Equal logits: the first choice. No letter seen: UNKNOWN."""
    df = computed(df, {"_top": F.array_max("logits")})
    df = computed(df, {"_e": F.transform("logits", lambda x: F.exp(x - F.col("_top")))})
    df = computed(df, {"_sum": F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)})
    best = letter(F.array_position("logits", F.col("_top")).cast("int") - 1)
    df = df.withColumn("output_letter", F.when(F.col("_top") > F.lit(ABSENT), best).otherwise("UNKNOWN"))
    probs = F.transform(F.col("choices"), lambda c, i: F.struct(letter(i).alias("letter"), c.alias("text"), (F.get("_e", i) / F.col("_sum")).alias("prob"), F.get("logits", i).alias("logit")))
    return df.withColumns({"probs": probs, "output_correct": F.col("output_letter") == F.col("gold"), "max_prob": F.lit(1.0) / F.col("_sum")}).drop("_top", "_e", "_sum")


def ranked_tokens(tokens: DataFrame, top: int = 100) -> DataFrame:
    """The ``top`` tokens of each question and variant by logit, with ``rank`` from 1."""
    order = Window.partitionBy("qid", "probe_variant").orderBy(F.desc("logit"), "token")
    return tokens.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def api_letters(generated: list[tuple[str, list[tuple[str, float]]]], n: int) -> tuple[str | None, list[float]]:
    """Letter and log-probabilities out of an API's token list: (token, alternatives) in order.

    The first token that holds any valid letter decides; its alternatives count for each letter they
    hold, later ones over earlier ones, and the token itself over all.
    """
    letters = [chr(65 + i) for i in range(n)]
    for token, others in generated:
        if not (own := [x for x in letters if x in token.upper()]):
            continue
        found = dict.fromkeys(letters, ABSENT)
        chosen = next((p for t, p in others if t == token), ABSENT)
        for t, p in others:
            for x in letters:
                if x in t.upper():
                    found[x] = p
        found[own[0]] = chosen
        return own[0], [found[x] for x in letters]
    return None, [ABSENT] * n


Scorer = Callable[[list[dict]], list[list[tuple[str, list[tuple[str, float]]]]]]


def scored(prompts: DataFrame, make_scorer: Callable[[], Scorer], batch: int = 8) -> DataFrame:
    """Run a scorer over ``qid, probe_variant, system_prompt, user_prompt, n_choices``; adds
    ``output_letter`` (null if none) and ``logps``. The scorer is made once in each task."""
    schema = prompts.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make_scorer()
        for b in batches:
            rows, found = b.to_pylist(), []
            for i in range(0, len(rows), batch):
                part = rows[i : i + batch]
                found += [api_letters(g, r["n_choices"]) for g, r in zip(scorer(part), part, strict=True)]
            yield pa.record_batch([*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.list_(pa.float64()))], [*b.schema.names, "output_letter", "logps"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return prompts.mapInArrow(run, f"{fields}, output_letter string, logps array<double>")


def choice_text(choices: Column, letter_: Column) -> Column:
    return F.coalesce(F.get(choices, index_of(letter_)), F.lit(""))
