"""Text functions: answers out of completions, letter lists, prompts, white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions import dims


def letter(index: Column) -> Column:
    return F.char(F.lit(65) + index)


def index_of(letter_: Column) -> Column:
    return F.ascii(letter_) - 65


def letter_options(n: Column) -> Column:
    """``A, B, C or D`` for n choices."""
    letters = F.transform(F.sequence(F.lit(0), n - 1), lambda i: letter(i))
    return F.when(n <= 1, F.lit("A")).otherwise(F.concat(F.array_join(F.slice(letters, F.lit(1), n - 1), ", "), F.lit(" or "), F.element_at(letters, -1)))


def extract_letter(raw: Column, n: int, use_cot: bool = False) -> Column:
    """First letter of the n choices in an answer, in upper case; with chain of thought, after the first
    ``<answer>``. Null and answers without one: ``Cannot parse answer``."""
    last = chr(64 + n)
    found = F.regexp_extract(F.trim(raw), f"(?is)<answer>.*?([A-{last}])" if use_cot else f"(?i)([A-{last}])", 1)
    return F.when(F.coalesce(found, F.lit("")) == "", F.lit("Cannot parse answer")).otherwise(F.upper(found))


def completion_answer(completion: Column, reasoning: bool = False) -> Column:
    """Of A to E in that order, the first whose first occurrence has no letter beside it, else UNKNOWN. In
    reasoning mode a letter right after ``Answer:`` past the first ``</think>`` goes before."""
    text = F.upper(completion)
    tests = []
    for c in "ABCDE":
        at = F.instr(text, c)
        alone = lambda pos: F.coalesce(~F.substring(text, pos, F.lit(1)).rlike(r"\p{L}"), F.lit(True))
        tests.append(F.when((at > 0) & ((at == 1) | alone(at - 1)) & ((at == F.length(text)) | alone(at + 1)), F.lit(c)))
    answer = F.coalesce(*tests, F.lit("UNKNOWN"))
    if reasoning:
        after = F.regexp_extract(completion, r"(?s)^.*?</think>.*?Answer:\s*([A-Ea-e])", 1)
        answer = F.when(F.coalesce(after, F.lit("")) != "", F.upper(after)).otherwise(answer)
    return answer


def thinking_text(text: Column) -> Column:
    """Up to and with the last ``</think>``; the whole text without one."""
    found = F.regexp_extract(text, r"(?s)^(.*</think>)", 1)
    return F.when(found == "", text).otherwise(found)


def canonical_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", "")


def contains_answer(sentence: Column, answer: Column) -> Column:
    return F.contains(F.lower(sentence), F.lower(answer))


def unquoted(text: Column) -> Column:
    """Without one pair of surrounding double quotes."""
    return F.when((F.length(text) > 1) & text.startswith('"') & text.endswith('"'), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def key_values(response: Column, keys: list[str]) -> Column:
    """``KEY: value`` lines as a map with lower-case keys; null if one of the keys is missing."""
    lines = F.filter(F.split(response, "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.split(x, ":", 2)[0])), F.trim(F.split(x, ":", 2)[1])))
    wanted = F.filter(pairs, lambda p: p["col1"].isin(keys))
    last = F.transform(F.array(*map(F.lit, keys)), lambda k: F.struct(k.alias("k"), F.element_at(F.filter(wanted, lambda p: p["col1"] == k), -1)["col2"].alias("v")))
    return F.when(F.forall(F.array(*map(F.lit, keys)), lambda k: F.exists(wanted, lambda p: p["col1"] == k)), F.map_from_entries(last))


def system_prompt(instruction: Column, n_choices: Column, use_cot: bool = False, api: bool = False) -> Column:
    """``api``: the wording for API models."""
    options = letter_options(n_choices)
    # The wording of the instructions.
    if use_cot:
        base = F.concat(F.lit("First, think through the problem step-by-step inside a `<think>...</think>` block.\nThen, provide ONLY the letter ("), options, F.lit(") inside an `<answer>...</answer>` block.\n\nFormat:\n<think> reasoning process here </think>\n<answer> [letter] </answer>\n\nDo not write anything outside these tags."))
    else:
        base = F.concat(F.lit("Answer with ONLY the letter ("), options, F.lit(") of your chosen answer. Do not include any explanation, punctuation, or additional text."))
    appendix = None
    for k, v in (dims.API_APPENDIX if api else dims.APPENDIX).items():
        appendix = F.when(instruction == k, v) if appendix is None else appendix.when(instruction == k, v)
    return F.trim(F.concat(base, appendix))


def user_prompt(sources: Column, question: Column, choices: Column, answer_line: bool = True) -> Column:
    """Sources in order, a blank line, the question, the lettered choices, ``Answer: ``. Null sources are
    left out."""
    told = F.filter(sources, lambda s: s.isNotNull())
    lines = F.transform(choices, lambda c, i: F.concat(letter(i), F.lit(". "), c))
    parts = F.concat(F.when(F.size(told) > 0, F.concat(told, F.array(F.lit("")))).otherwise(told), F.array(F.concat(F.lit("Question: "), question), F.lit("")), lines, F.array(F.lit(""), *([F.lit("Answer: ")] if answer_line else [])))
    return F.array_join(parts, "\n")


def base_model_prompt(prompt: Column, options: Column) -> Column:
    """For models without a chat template: the letter instruction stands before the final ``Answer: ``."""
    said = F.concat(F.lit("Answer with ONLY the letter ("), options, F.lit(") of your chosen answer.\nAnswer: "))
    return F.when(prompt.endswith("Answer: "), F.concat(F.substring(prompt, F.lit(1), F.length(prompt) - 8), said)).otherwise(prompt)


def picked(words: list[str], seed: Column) -> Column:
    """One of the words by a non-negative number."""
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(seed, F.lit(len(words))) + 1).cast("int"))


def tier1_sentence(source: str, answer: Column, seed: Column, kind: str = "default") -> Column:
    """Template and words chosen by the seed, the answer put in."""
    templates = dims.USER_TEMPLATES if source == "user" else dims.DOC_TEMPLATES
    out = picked(templates, seed)
    for i, (slot, words) in enumerate(dims.WORDS[kind].items(), 1):
        out = F.replace(out, F.lit(f"{{{slot}}}"), picked(words, seed + i))
    return F.replace(out, F.lit("{answer}"), answer)


def tier2_templates(seed: Column, kind: str = "default") -> tuple[Column, Column]:
    """User and document template of tier 2, words put in, with a place for the claim: each choice has a seed
    of its own."""
    out = []
    for at, (templates, slots) in enumerate(((dims.T2_USER_TEMPLATES, ("user_phrase", "user_perspective")), (dims.T2_DOC_TEMPLATES, ("doc_phrase", "doc_source")))):
        made = picked(templates, seed + at)
        for i, slot in enumerate(slots):
            made = F.replace(made, F.lit(f"{{{slot}}}"), picked(dims.T2_WORDS[kind][slot], seed + 2 + 2 * at + i))
        out.append(made)
    return out[0], out[1]


def md5_number(text: Column) -> Column:
    """The first 32 bits of the MD5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
