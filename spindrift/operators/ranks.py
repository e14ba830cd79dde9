"""Row numbers of a distributed sort: a range sort, counts of each partition, offsets by their prefix sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.session import written


def joined(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """All columns of ``left`` and the others of ``right``, where the given columns are equal, nulls too."""
    renamed = right.select(*(F.col(c).alias(f"_right_{c}") if c in columns else F.col(c) for c in right.columns))
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in columns))
    return left.join(renamed, on, how).drop(*(f"_right_{c}" for c in columns))


def numbered(df: DataFrame, keys: list[str], order: list[str], rank: str = "rank", size: str | None = None) -> DataFrame:
    """Adds the row's number in its group, from 0 in the order of ``order``, and with ``size`` the rows of the group.

    No task sees more than its range of the sort, however large a group is; only counts (one for each group and
    partition) meet in a window. Rows equal in keys and order are numbered as they come, and are dealt over several
    ranges if there are many. Nulls come first, a null key is a group. The sorted table is written, so numbers do
    not change when a task is run again.
    """
    own = [*keys, *(c for c in order if c not in keys)]
    # written: the range sort reads its rows twice, first for the ranges' bounds
    df = written(df.withColumn("_tie", F.monotonically_increasing_id()), "unsorted")
    ranges = df.repartitionByRange(*own, "_tie").sortWithinPartitions(*own, "_tie").drop("_tie")
    placed = written(ranges.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranks")
    counts = placed.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"_before": before, "_size": F.sum("_n").over(group)}).drop("_n")
    made = {rank: F.col("_before") + F.col("_at") - F.col("_first")} | ({size: F.col("_size")} if size else {})
    out = joined(placed, counts, ["_part", *keys])
    return out.select(*(c for c in df.columns if c not in ("_tie", *made)), *(v.alias(k) for k, v in made.items()))


def with_position(df: DataFrame, order: list[str], position: str = "pos") -> DataFrame:
    """Adds each row's place in the whole table, from 0, to be carried through stages that lose the order."""
    return numbered(df, [], order, position)


def restored(df: DataFrame, position: str = "pos") -> DataFrame:
    """The rows in the order of their places."""
    return df.orderBy(position)
