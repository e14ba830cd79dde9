"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Law ``key``: the key and the shard count decide. Each (key, shard) gets a hash-derived draw
``-ln(u) / weight``; the smallest draw wins. A new shard only adds one more draw, so a record
either stays or goes into the new shard, and a shard of weight w takes w / sum(weights) of the
rows on average.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import octets, table, written


def draw(key: Column, shard: int, weight: float, seed: str) -> Column:
    """The draw of one shard for a key: exponential with rate ``weight``."""
    hashed = F.xxhash64(F.concat(F.lit(f"{seed}#{shard}#"), key))
    unit = (F.shiftrightunsigned(hashed, 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(unit) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float], seed: str = "shard") -> Column:
    """Shard number (0-based) of a key; null keys count as the empty string.

    Equal draws go to the smaller shard number.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    key = F.coalesce(key.cast("string"), F.lit(""))
    draws = [F.struct(draw(key, s, w, seed).alias("d"), F.lit(s).alias("s")) for s, w in enumerate(weights)]
    return F.least(*draws)["s"] if len(draws) > 1 else F.lit(0)


def gapless(df: DataFrame, group: str, order: list[str], name: str = "slot") -> DataFrame:
    """Number the rows of every group from 0 in the given order, with no task per group.

    Rows are range-partitioned by (group, order) and sorted, and each partition counts its own rows
    of each group; only those counts (partitions x groups) are gathered to place the partitions one
    after another. The sorted rows are written once so that both passes see the same partitions.
    """
    ranged = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ranged = ranged.withColumn("_at", F.monotonically_increasing_id())
    ranged = written(ranged, "ranged").withColumn("_part", F.shiftright("_at", 33))
    counts = ranged.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    rows = sorted(((r[group], r["_part"], r["_n"], r["_first"]) for r in counts.collect()), key=lambda r: (r[0], r[1]))
    starts, done = [], {}
    for g, part, n, first in rows:
        starts.append((g, part, first - done.get(g, 0)))
        done[g] = done.get(g, 0) + n
    kind = df.schema[group].dataType.simpleString()
    placed = df.sparkSession.createDataFrame(starts, f"`{group}` {kind}, _part long, _less long")
    return ranged.join(F.broadcast(placed), [group, "_part"]).withColumn(name, F.col("_at") - F.col("_less")).drop("_part", "_at", "_less")


def shard_records(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text", seed: str = "shard") -> DataFrame:
    """Place every record. Input columns other than ``key`` and ``text`` are not carried.

    Adds ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``law``, ``shard``, ``grown_shard`` (with one
    more shard of mean weight) and ``slot``. A null text has size 1 and the CRC of no bytes (0); a
    null key counts as the empty key; repeated rows get a slot each; an empty table gives none.
    """
    grown = [*weights, sum(weights) / len(weights)]
    placed = docs.select(
        F.col(key),
        (octets(F.col(text)) + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights, seed).cast("int").alias("shard"),
        rendezvous(F.col(key), grown, seed).cast("int").alias("grown_shard"),
    )
    return gapless(placed, "shard", [key, "size", "text_crc32"])


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_records(table(spark, sf_dir, "documents").select("doc_id", "text"), [1.0] * 8)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
