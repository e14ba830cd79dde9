"""Schemas of the tables that the analytics read and write, and the check for missing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


class MissingColumns(ValueError):
    """A table lacks columns that an operator needs."""


def ddl(text: str) -> StructType:
    return StructType.fromDDL(text)


QUESTION = "id string, question string, choices struct<label: array<string>, text: array<string>>, answerKey string, gold_reasoning string"
PROB = "struct<letter: string, text: string, prob: double, logit: double>"
API_PROB = "struct<letter: string, text: string, prob: double, logp: double>"
PROBE_RESULT = f"qid string, probe_variant string, gold string, output_letter string, output_correct boolean, probs array<{PROB}>, user_prompt string, system_prompt string, max_prob double, choices array<string>, reasoning_probing_method string, reasoning_mode_generated_text string"
CANONICAL_WRONG = "qid string, gold string, gold_text string, canonical_wrong string, canonical_wrong_text string"
MERGED = f"qid string, gold string, canonical_wrong string, choices array<string>, probe_variant string, model_correct boolean, output_letter string, output_correct boolean, user_present boolean, doc_present boolean, user_correct boolean, doc_correct boolean, user_first boolean, probs array<{PROB}>, reasoning_mode_generated_text string"
REASONING = "qid string, probe_variant string, gold string, output_letter string, output_correct boolean, completions array<string>, user_prompt string, system_prompt string, choices array<string>, reasoning_generation_mode string, thinking_with_tags string"
SENTENCE_KEYS = [f"t{t}_{s}_{c}" for t in (1, 2) for s in ("user", "doc") for c in ("correct", "wrong")]
TIER_SENTENCES = "question_id string, question string, correct_answer string, wrong_answer string, " + ", ".join(f"{k} string" for k in SENTENCE_KEYS)
HARNESS_SAMPLE = "doc_id long, acc double, exact_match double, target string"
CALL_LOG = "timestamp string, model string, temperature double, prompt string, response string, error string, metadata map<string, string>"


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df
