import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from spindrift.llm.sharding import gapless, rendezvous, shard_records

TEXTS = {0: "a", 1: "bé", 2: None, 3: "", 5: "a", 9: "x" * 300_000, None: "null id"}


def brute(key, shards, seed="shard"):
    import math

    draws = [(-math.log(((xxhash.xxh64_intdigest(f"{seed}#{s}#{key}".encode(), seed=42) >> 11) + 0.5) / 2**53), s) for s in range(shards)]
    return min(draws)[1]


def test_rows_and_laws(spark, make_docs):
    docs = make_docs(TEXTS).unionByName(make_docs({0: "a"})).withColumn("shard", F.lit("clash"))
    rows = shard_records(docs, [1.0] * 8).collect()
    assert len(rows) == 8
    for r in rows:
        raw = (TEXTS[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "key"
        assert r["shard"] == brute("" if r["doc_id"] is None else r["doc_id"], 8)
        assert r["grown_shard"] in (r["shard"], 8)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_growth_moves_into_the_new_shard_only(spark):
    df = spark.range(20_000).select("id", rendezvous(F.col("id"), [1.0] * 8).alias("a"), rendezvous(F.col("id"), [1.0] * 9).alias("b"))
    moved = df.where("a <> b").groupBy("b").count().collect()
    assert [r["b"] for r in moved] == [8] and abs(moved[0]["count"] - 20_000 / 9) < 200


def test_weights(spark):
    counts = dict(spark.range(20_000).groupBy(rendezvous(F.col("id"), [1.0, 3.0])).count().collect())
    assert abs(counts[1] - 15_000) < 400
    with pytest.raises(ValueError):
        rendezvous(F.col("id"), [1.0, 0.0])


def test_empty_and_one_group(spark, make_docs):
    assert shard_records(make_docs({0: "a"}).limit(0), [1.0]).count() == 0
    df = spark.range(1000).repartition(7).select(F.lit(1).alias("g"), "id")
    assert [r["id"] for r in gapless(df, "g", ["id"]).orderBy("slot").collect()] == list(range(1000))
