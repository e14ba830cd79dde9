"""Sentence templates and their words as the standard generator draws them, a batch of seeds at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions import dims, mersenne

#: By tier: templates of user and document, the slots that each may have in the order they are drawn, and the words.
TIERS = {
    1: (dims.USER_TEMPLATES, dims.DOC_TEMPLATES, ("user_verb", "user_noun"), ("doc_verb", "doc_verb_singular", "doc_noun", "doc_noun_plural", "doc_noun_plural_lower"), dims.WORDS),
    2: (dims.T2_USER_TEMPLATES, dims.T2_DOC_TEMPLATES, ("user_phrase", "user_perspective"), ("doc_phrase", "doc_source"), dims.T2_WORDS),
}


def drawn(seeds: np.ndarray, tier: int, kind: str) -> tuple[list[str], list[str]]:
    """The user's and the document's template of each seed with its words, the place for what is said left.

    The user's template is drawn with the seed itself, the document's with the next one; then each word that the
    chosen templates have, the user's first, with one more.
    """
    *templates, user_slots, doc_slots, words = TIERS[tier]
    seeds = np.asarray(seeds, np.uint64)
    same = lambda n: np.full(len(seeds), n, np.int64)
    chosen = [mersenne.first_below(seeds + np.uint64(at), same(len(t))) for at, t in enumerate(templates)]
    used, out = np.full(len(seeds), 2, np.uint64), []
    for own, choices, slots in zip(chosen, templates, (user_slots, doc_slots), strict=True):
        made = [choices[i] for i in own]
        for slot in slots:
            name = f"{{{slot}}}"
            rows = np.flatnonzero(np.array([name in t for t in choices])[own])
            options = words[kind][slot]
            picked = mersenne.first_below((seeds + used)[rows], same(len(options))[rows])
            for row, word in zip(rows.tolist(), picked.tolist(), strict=True):
                made[row] = made[row].replace(name, options[word])
            used[rows] += np.uint64(1)
        out.append(made)
    return out[0], out[1]


def exact_templates(seed: Column, tier: int, kind: str = "default") -> Column:
    """A struct of the ``user`` and ``doc`` template by a seed from 0 below 2**63; null without one."""

    @F.pandas_udf("user string, doc string")
    def draw(seeds: pd.Series) -> pd.DataFrame:
        there = seeds.notna()
        user, doc = drawn(seeds[there].to_numpy(np.uint64), tier, kind)
        return pd.DataFrame({"user": pd.Series(user, seeds.index[there], object), "doc": pd.Series(doc, seeds.index[there], object)}).reindex(seeds.index)

    return draw(seed)


def exact_sentence(template: Column, answer: Column, kind: str = "default") -> Column:
    """The template with the answer; about code, answers are in lower case."""
    return F.replace(template, F.lit("{answer}"), F.lower(answer) if kind == "code" else answer)
