"""Cross-experiment reports: long metric rows, wide tables, append of new experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.names import reports_dimensions
from spindrift.operators.ranks import numbered
from spindrift.session import written


def long_rows(df: DataFrame, metrics: list[str], source: str, probe: str = "probe_variant") -> DataFrame:
    """``experiment, metric, value`` with metrics named ``source_probe_metric``."""
    spread = df.unpivot(["experiment", probe], metrics, "_m", "value")
    return spread.select("experiment", F.concat_ws("_", F.lit(source), probe, "_m").alias("metric"), "value")


def wide(long: DataFrame, columns: list[str]) -> DataFrame:
    """One row an experiment with the given metrics as columns, those that have any value, in that order."""
    out = written(long.groupBy("experiment").pivot("metric", columns).agg(F.first("value", ignorenulls=True)), "wide")  # one row an experiment
    counts = out.agg(*(F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns))).first() if columns else ()
    return out.select("experiment", *(F.col(f"`{c}`") for c, n in zip(columns, counts, strict=True) if n))


def interval_text(mean: Column, low: Column, high: Column, decimals: int = 4) -> Column:
    """A mean with its interval for display; ``N/A`` without a mean, the mean alone without bounds."""
    form = f"%.{decimals}f"
    there = lambda x: x.isNotNull() & ~F.isnan(x)
    return F.when(~there(mean) | mean.isNull(), "N/A").when(there(low) & there(high), F.format_string(f"{form} [{form}, {form}]", mean, low, high)).otherwise(F.format_string(form, mean))


#: Rows of a comparison in the report: label, column, and whether it is a share or has a sign.
COMPARED = [("Total samples", "total", ""), ("Both correct", "both_correct", ""), ("Gain (base wrong, tuned right)", "gain", ""), ("Forget (base right, tuned wrong)", "forget", ""), ("Both wrong", "both_wrong", ""), ("Base accuracy", "base_acc", "%"), ("Tuned accuracy", "tuned_acc", "%"), ("Net change", "net", "+")]


def markdown_report(title: str, accuracies: DataFrame, comparisons: DataFrame, tuned: list[str]) -> DataFrame:
    """``at, line``: a whole report in Markdown: the accuracy of every model, then for each family a table that compares
    its base model with each of the ``tuned`` ones, ``N/A`` where one lacks.

    ``accuracies`` has ``family, model, accuracy``; ``comparisons`` has ``family, model`` and the outcomes of the pair
    (:func:`spindrift.operators.pairs.outcomes`). Families come in the order of their names, models base first, then as
    given. One row a family and model, so few.
    """
    spark = accuracies.sparkSession
    order = F.coalesce(F.array_position(F.array(*(F.lit(m) for m in ["Base", *tuned])), F.col("model")), F.lit(99)).cast("int")
    text = lambda rows: spark.createDataFrame([(a, "", b, x) for a, b, x in rows], "a int, family string, b int, line string")
    head = text([(0, i, x) for i, x in enumerate([f"# {title}", "", "## Overall accuracy", "", "| Family | Model | Accuracy |", "|---|---|---|"])] + [(2, i, x) for i, x in enumerate(["", "## Gained and forgotten", "", "Each sample of the base model against the tuned ones. Net change: gain less forget."])])
    table = accuracies.select(F.lit(1).alias("a"), "family", order.alias("b"), F.format_string("| %s | %s | %.2f%% |", "family", "model", F.col("accuracy") * 100).alias("line"))
    shown = {"": lambda c: F.col(c).cast("string"), "%": lambda c: F.format_string("%.2f%%", F.col(c) * 100), "+": lambda c: F.format_string("%+d", F.col("gain") - F.col("forget"))}
    values = F.array(*(shown[kind](c) for _, c, kind in COMPARED))
    by = comparisons.groupBy("family").agg(*(F.max(F.when(F.col("model") == m, values)).alias(f"_{i}") for i, m in enumerate(tuned)))
    cells = lambda k: [F.coalesce(F.get(F.col(f"_{i}"), F.lit(k)), F.lit("N/A")) for i in range(len(tuned))]
    lines = [F.lit(""), F.concat(F.lit("### "), "family"), F.lit(""), F.lit("| Metric | " + " | ".join(tuned) + " |"), F.lit("|---|" + "---|" * len(tuned))]
    lines += [F.concat(F.lit(f"| {label} | "), F.concat_ws(" | ", *cells(k)), F.lit(" |")) for k, (label, *_) in enumerate(COMPARED)]
    sections = by.select(F.lit(3).alias("a"), "family", F.posexplode(F.array(*lines)).alias("b", "line"))
    whole = head.unionByName(table).unionByName(sections)
    return numbered(whole, [], ["a", "family", "b"], "at").select("at", "line")


def core_report(long: DataFrame, columns: list[str]) -> DataFrame:
    return reports_dimensions(wide(long, columns))


def forgetting_lines(outcomes: DataFrame, by: str) -> DataFrame:
    """``at, line``: a table in Markdown of what was gained and forgotten, one row a group (few: they are
    subjects or models)."""
    head = outcomes.sparkSession.createDataFrame([(0, f"| {by.capitalize()} | Samples | Gain | Forget | Net |"), (1, "|---|---|---|---|---|")], "at long, line string")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", by, "total", "gain", "forget", F.col("gain") - F.col("forget")), F.lit(" |"))
    at = F.row_number().over(Window.orderBy(by)).cast("long") + 1
    return head.unionByName(outcomes.select(at.alias("at"), row.alias("line")))


def new_only(new: DataFrame, old: DataFrame, key: str = "experiment") -> DataFrame:
    """Rows of experiments that the report does not have yet."""
    return new.join(old.select(key).distinct(), key, "left_anti")


def appended(old: DataFrame, new: DataFrame, key: str = "experiment") -> DataFrame:
    """Columns are matched by name; those only one side has are null on the other."""
    return old.unionByName(new_only(new, old, key), allowMissingColumns=True)
