"""Experiment names: parse, build, validate, expand recipes."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import dims

#: Fixed value: dataset, model (a final r marks reasoning), two prior chunks and instruction, cot flag.
PATTERN = r"^([a-zA-Z0-9]+)__([a-zA-Z0-9_]+)__((?:d[12][wnc]u[12][wnc]|u[12][wnc]d[12][wnc])i[nduo])__(cot|nocot)$"


def valid_name(name: Column) -> Column:
    """Exactly four parts between double underscores, one document and one user chunk."""
    return F.coalesce(name.rlike(PATTERN) & (F.size(F.split(name, "__")) == 4), F.lit(False))


def mapped(value: Column, names: dict[str, str]) -> Column:
    out = None
    for k, v in names.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out


def model_family(key: Column) -> Column:
    out = None
    for prefix, family in dims.FAMILIES:
        out = F.when(key.startswith(prefix), family) if out is None else out.when(key.startswith(prefix), family)
    return out.otherwise(F.split(key, "_")[0])


def parsed(name: Column) -> Column:
    """Struct of the ten dimensions and the family; null for a name that is not valid."""
    part = lambda i: F.get(F.split(name, "__"), F.lit(i))
    token, prior = part(1), part(2)
    reasoning = token.endswith("r")
    key = F.when(reasoning, F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)
    chunk = lambda letter: F.regexp_extract(prior, f"{letter}([12])([wnc])", 0)
    fields = F.struct(
        part(0).alias("dataset"),
        key.alias("model_key"),
        token.alias("model_token"),
        reasoning.alias("reasoning_mode"),
        F.substring(chunk("u"), 2, 1).cast("int").alias("user_tier"),
        F.substring(chunk("d"), 2, 1).cast("int").alias("doc_tier"),
        mapped(F.substring(chunk("u"), 3, 1), dims.STRENGTHS).alias("user_strength"),
        mapped(F.substring(chunk("d"), 3, 1), dims.STRENGTHS).alias("doc_strength"),
        prior.startswith("u").alias("user_first"),
        mapped(F.substring(prior, 8, 1), dims.INSTRUCTIONS).alias("instruction"),
        (part(3) == "cot").alias("use_cot"),
        model_family(key).alias("model_family"),
    )
    return F.when(valid_name(name), fields)


def built(x: Column) -> Column:
    """The inverse of :func:`parsed`."""
    code = lambda value, names: mapped(value, {v: k for k, v in names.items()})
    user = F.concat(F.lit("u"), x["user_tier"].cast("string"), code(x["user_strength"], dims.STRENGTHS))
    doc = F.concat(F.lit("d"), x["doc_tier"].cast("string"), code(x["doc_strength"], dims.STRENGTHS))
    prior = F.when(x["user_first"], F.concat(user, doc)).otherwise(F.concat(doc, user))
    token = F.when(x["reasoning_mode"], F.concat(x["model_key"], F.lit("r"))).otherwise(x["model_key"])
    return F.concat_ws("__", x["dataset"], token, F.concat(prior, F.lit("i"), code(x["instruction"], dims.INSTRUCTIONS)), F.when(x["use_cot"], "cot").otherwise("nocot"))


def reports_dimensions(df: DataFrame, name: str = "experiment") -> DataFrame:
    """Rows with a valid name, with the dimensions beside them; others are left out."""
    return df.withColumn("_p", parsed(F.col(name))).where("_p is not null").select("*", "_p.*").drop("_p")


def _listed(recipe: dict[str, Any], plural: str, singular: str, default: str | None = None) -> list:
    value = recipe.get(plural) or recipe.get(singular) or default
    return [] if value is None else list(value) if isinstance(value, (list, tuple)) else [value]


def expand_recipes(spark: SparkSession, recipes: Iterable[dict[str, Any]]) -> DataFrame:
    """``pos, experiment``: names of all recipes in order, each once.

    Reasoning models are not combined with chain of thought; a combination that is no valid name is an
    error.
    """
    parts = []
    for i, r in enumerate(recipes):
        axes = [_listed(r, "datasets", "dataset"), _listed(r, "model_tokens", "model_token"), _listed(r, "prior_tokens", "prior_token"), _listed(r, "instructions", "instruction", "n"), _listed(r, "cot_flags", "cot_flag", "nocot")]
        if not all(axes[:3]):
            raise ValueError("a recipe needs datasets, model_tokens and prior_tokens")
        parts.append((i, *axes))
    return expanded(spark.createDataFrame(parts, "i int, ds array<string>, mt array<string>, pt array<string>, ins array<string>, cot array<string>"))


def expanded(recipes: DataFrame) -> DataFrame:
    """``experiment``: the names of all recipes in order, each once. A recipe is a row: its place ``i`` and the lists
    ``ds`` (datasets), ``mt`` (models), ``pt`` (priors), ``ins`` (instructions) and ``cot``; an empty list gives none."""
    df = recipes
    for k in ("ds", "mt", "pt", "ins", "cot"):
        df = df.select("*", F.posexplode(k).alias(f"{k}_at", f"{k}_v"))
    df = df.where(~(F.col("mt_v").endswith("r") & (F.col("cot_v") == "cot")))
    name = F.concat_ws("__", "ds_v", "mt_v", F.concat("pt_v", F.lit("i"), "ins_v"), "cot_v")
    at = F.struct("i", "ds_at", "mt_at", "pt_at", "ins_at", "cot_at")
    checked = F.when(valid_name(name), name).otherwise(F.raise_error(F.concat(F.lit("invalid experiment name: "), name)))
    return df.groupBy(checked.alias("experiment")).agg(F.min(at).alias("at")).orderBy("at").select("experiment")


def with_model_id(df: DataFrame, models: dict[str, str], key: str = "model_key") -> DataFrame:
    """Adds ``model_id`` by the configured models; a key that is not among them is an error."""
    found = mapped(F.col(key), models)
    return df.withColumn("model_id", F.coalesce(found, F.raise_error(F.concat(F.lit("model is not configured: "), key)).cast("string")))
