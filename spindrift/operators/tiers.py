"""Assertions attributed to a user or a document: tier 1 from templates, tier 2 by a language model."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.templates import exact_sentence, exact_templates
from spindrift.functions.text import contains_answer, key_values, md5_number, tier1_sentence
from spindrift.operators.prep import seeds
from spindrift.schemas import SENTENCE_KEYS
from spindrift.session import shared_folder

FIELDS = ["user_correct", "doc_correct", "user_wrong", "doc_wrong"]


def tier1(questions: DataFrame, kind: str = "default") -> DataFrame:
    """Adds ``t1_*`` to ``qid, correct_answer, wrong_answer``, and the seeds, drawn from the question's id.
    The right and the wrong sentence of a source share template and words."""
    df = questions.withColumn("base_seed", md5_number(F.col("qid"))).withColumns(seeds(F.col("base_seed")))
    made = {f"t1_{s}_{c}": tier1_sentence(s, F.col(f"{c}_answer"), F.col("t1_seed") + at, kind) for at, s in ((0, "user"), (1, "doc")) for c in ("correct", "wrong")}
    return df.withColumns(made)


def tier1_exact(questions: DataFrame, kind: str = "default") -> DataFrame:
    """:func:`tier1` with templates and words as the standard generator draws them from the same seeds; about code,
    answers are in lower case."""
    df = questions.withColumn("base_seed", md5_number(F.col("qid"))).withColumns(seeds(F.col("base_seed")))
    df = df.withColumn("_t", exact_templates(F.col("t1_seed"), 1, kind))
    made = {f"t1_{s}_{c}": exact_sentence(F.col(f"_t.{s}"), F.col(f"{c}_answer"), kind) for s in ("user", "doc") for c in ("correct", "wrong")}
    return df.withColumns(made).drop("_t")


#: What a claim of each kind may look like, and how its four sentences begin.
EXAMPLES = {
    "default": ("a ferry ties up for the night at a %s", "I've heard", "Reports note"),
    "math": ("the baker has %s rolls left over at noon", "I've worked out", "Calculations show"),
    "code": ("the second call of the function returns %s", "I've reviewed it:", "References indicate"),
}
TIER2_TASK = """Write four short statements for a multiple-choice question.

Question: %s
Correct answer: %s
Wrong answer: %s
User template: %s
Document template: %s

How to write them:
1. Think of one claim in context that uses key words of the question and has one gap for the answer.
2. Put this very claim, word for word, in the place {contextual_claim} of the templates; use the templates as they are.
3. Fill the gap with the correct answer in USER_CORRECT and DOC_CORRECT, with the wrong answer in USER_WRONG and DOC_WRONG. No gap may be left open.
4. So the four statements differ in source and answer only.
"""
TIER2_FORM = """
Reply with exactly these four lines, plain text without quotation marks:
USER_CORRECT: ...
DOC_CORRECT: ...
USER_WRONG: ...
DOC_WRONG: ..."""


def tier2_example(right: Column, wrong: Column, kind: str = "default") -> Column:
    """Four statements about something else that follow the rules, with the question's own answers."""
    claim, user, doc = EXAMPLES[kind]
    lines = [f"{name}: {source} {claim}." for name, source in (("USER_CORRECT", user), ("DOC_CORRECT", doc), ("USER_WRONG", user), ("DOC_WRONG", doc))]
    return F.format_string(f"\nAn example, with the claim \"{claim.replace('%s', '[answer]')}\":\n" + "\n".join(lines) + "\n", right, right, wrong, wrong)


def tier2_prompt(question: Column, right: Column, wrong: Column, user_template: Column, doc_template: Column, kind: str = "default") -> Column:
    """Asks for one claim in context, said four times: by user and document, with the right and the wrong
    answer; task, an example of the kind of question, and the form of the reply."""
    return F.concat(F.format_string(TIER2_TASK, question, right, wrong, user_template, doc_template), tier2_example(right, wrong, kind), F.lit(TIER2_FORM))


def tier2_parsed(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds ``t2_*`` and ``error`` to rows with ``correct_answer``, ``wrong_answer`` and a reply: a missing
    field, or one without the answer it should give."""
    df = replies.withColumn("_m", key_values(F.col(reply), FIELDS))
    df = df.withColumns({f"t2_{f}": F.col("_m")[f] for f in FIELDS})
    lacking = F.concat_ws(", ", *(F.when(~contains_answer(F.col(f"t2_{f}"), F.col(f"{f.split('_')[1]}_answer")), f"t2_{f}") for f in FIELDS))
    return df.withColumn("error", F.when(F.col("_m").isNull(), "fields missing").when(lacking != "", F.concat(F.lit("answer missing in "), lacking))).drop("_m")


def tier2(questions: DataFrame, make_writer: Callable[[], Callable[[list[str]], list[str]]], attempts: int = 5, batch: int = 100) -> tuple[DataFrame, DataFrame]:
    """(rows with ``t2_*``, rejected rows with ``error``). ``questions`` has ``qid, prompt, correct_answer,
    wrong_answer``; rows that fail are asked again, up to ``attempts`` times in all.

    Every attempt is written to the shared folder, so an expensive reply is never asked for twice.
    """
    spark = questions.sparkSession
    folder = f"{shared_folder(spark)}/tier2-{uuid.uuid4().hex}"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = make_writer()
        for b in batches:
            prompts = b.column("prompt").to_pylist()
            replies = [r for i in range(0, len(prompts), batch) for r in writer(prompts[i : i + batch])]
            yield pa.record_batch([*b.columns, pa.array(replies, pa.string())], [*b.schema.names, "reply"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in questions.schema.fields)
    todo, good = questions, None
    for attempt in range(attempts):
        path = f"{folder}/{attempt}"
        tier2_parsed(todo.mapInArrow(ask, f"{fields}, reply string")).write.parquet(path)
        done = spark.read.parquet(path)
        passed = done.where("error is null").drop("error", "reply")
        good = passed if good is None else good.unionByName(passed)
        bad = done.where("error is not null")
        todo = bad.select(questions.columns)
        if bad.isEmpty():
            break
    return good, bad.select(*questions.columns, "error")


def sentences(tier1_rows: DataFrame, tier2_rows: DataFrame) -> DataFrame:
    """Both tiers of each question; a question without tier 2 is not in the result."""
    return tier1_rows.join(tier2_rows.select("qid", *(f"t2_{f}" for f in FIELDS)), "qid").select("qid", *SENTENCE_KEYS, "base_seed", "t1_seed", "t2_seed")


def source_sentence(source: str, tier: Column, right: Column) -> Column:
    """The sentence of a source by tier and whether it is right, out of the eight columns."""
    pick = lambda t: F.when(right, F.col(f"t{t}_{source}_correct")).otherwise(F.col(f"t{t}_{source}_wrong"))
    return F.when(tier == 1, pick(1)).otherwise(pick(2))
