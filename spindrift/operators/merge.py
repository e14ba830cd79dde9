"""The central fact table: all variants of all experiments, one row a question and variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.dims import variants
from spindrift.functions.names import parsed, valid_name
from spindrift.operators.pairs import last_per_id


def experiment_variants(experiments: DataFrame) -> DataFrame:
    """The nine variants of each experiment (column ``experiment``) with their flags."""
    named = experiments.select("experiment", parsed(F.col("experiment"))["user_first"].alias("_uf"))
    dim = F.broadcast(variants(experiments.sparkSession))  # 13 rows
    fits = (dim["first"] == "") | (dim["first"] == F.when(named["_uf"], "u").otherwise("d"))
    out = named.join(dim, fits)
    return out.withColumn("user_first", F.col("_uf") & (F.col("first") != "")).drop("_uf", "first")


def with_flags(probes: DataFrame) -> DataFrame:
    """Rows of an experiment's nine variants with their flags, by the name of each row: nothing is read before."""
    dim = F.broadcast(variants(probes.sparkSession))  # 13 rows
    uf = F.coalesce(F.when(valid_name(F.col("experiment")), F.get(F.split("experiment", "__"), F.lit(2)).startswith("u")), F.lit(False))
    df = probes.withColumn("_uf", uf).join(dim, "probe_variant").where((F.col("first") == "") | (F.col("first") == F.when(F.col("_uf"), "u").otherwise("d")))
    return df.withColumn("user_first", F.col("_uf") & (F.col("first") != "")).drop("_uf", "first")


def merge_results(probes: DataFrame, canonical: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """``probes``: results of all variants, with ``experiment``. Gold and choices are those of the first
    variant (in display order) that has the question; ``model_correct`` is the question's result without
    sources, false where there is none; a missing canonical wrong answer is the empty string; without ``canonical`` the
    rows of ``probes`` carry theirs. ``order`` names
    a column by which the last of several rows of one question and variant wins; without it there must be one.

    One window over (experiment, question) serves all three, so the table is shuffled once.
    """
    if order is not None:
        probes = last_per_id(probes, ["experiment", "qid", "probe_variant"], order)
    df = with_flags(probes)
    ranked = Window.partitionBy("experiment", "qid").orderBy("variant_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({
        "gold": F.first("gold").over(ranked),
        "choices": F.first("choices").over(ranked),
        "model_correct": F.coalesce(F.max(F.when(F.col("probe_variant") == "bare", F.col("output_correct"))).over(ranked), F.lit(False)),
    })
    if canonical is not None:
        df = df.join(canonical.select("experiment", "qid", "canonical_wrong"), ["experiment", "qid"], "left")
    return df.withColumn("canonical_wrong", F.coalesce("canonical_wrong", F.lit("")))


def with_bare(merged: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``bare``: the given columns of the question's row without sources, null where there is none. The
    window has the keys of the merged table's own, so nothing is shuffled or joined again."""
    own = F.when(F.col("probe_variant") == "bare", F.struct(*columns))
    return merged.withColumn("bare", F.max(own).over(Window.partitionBy("experiment", "qid")))


def source_order(df: DataFrame) -> DataFrame:
    """Adds ``source_order`` to rows of ``experiment`` and ``probe_variant``: which source stands first, null
    without two of them. A variant of the other order than its experiment's is an error."""
    first, uf = F.substring("probe_variant", 1, 1), parsed(F.col("experiment"))["user_first"]
    two = F.col("probe_variant").rlike("^[ud][pn][ud][pn]$")
    wrong = F.raise_error(F.concat(F.lit("variant "), "probe_variant", F.lit(" has another order than "), "experiment")).cast("string")
    order = F.when((first == "u") != uf, wrong).when(uf, "user_first").otherwise("doc_first")
    return df.withColumn("source_order", F.when(two, order))


def coverage(merged: DataFrame) -> DataFrame:
    """Rows of each expected variant, and how many questions of the experiment lack it."""
    expected = experiment_variants(merged.select("experiment").distinct()).select("experiment", "probe_variant")
    counts = merged.groupBy("experiment", "probe_variant").agg(F.count("*").alias("n"))
    total = merged.groupBy("experiment").agg(F.countDistinct("qid").alias("questions"))
    out = expected.join(counts, ["experiment", "probe_variant"], "left").join(total, "experiment")
    return out.select("experiment", "probe_variant", F.coalesce("n", F.lit(0)).alias("n"), (F.col("questions") - F.coalesce("n", F.lit(0))).alias("missing"))


def missing_rows(expected: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``expected`` that are still to be done."""
    return expected.join(have.select(keys).distinct(), keys, "left_anti")


def letter_flags(df: DataFrame) -> DataFrame:
    """Flags read off the variant's letters alone, with the experiment's order on every variant. Differs from
    the merged table, whose single-source rows have no order."""
    v = F.col("probe_variant")
    double = F.length(v) == 4
    bare = v == "bare"

    def side(letter: str) -> tuple[Column, Column]:
        first, second = v.startswith(letter), F.substring(v, 3, 1) == letter
        there = ~bare & (first | ((F.substring(v, 3, 1) == letter) & double & v.rlike("^[ud][pn][ud][pn]$")))
        pair = double & v.rlike("^[ud][pn][ud][pn]$")
        right = F.when(first, F.substring(v, 2, 1) == "p").when(pair & second, F.substring(v, 4, 1) == "p").otherwise(False)
        return there, there & right

    (up, uc), (dp, dc) = side("u"), side("d")
    return df.withColumns({"user_present": up, "doc_present": dp, "user_correct": uc, "doc_correct": dc, "user_first": parsed(F.col("experiment"))["user_first"]})
