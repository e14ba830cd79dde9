"""Splits and balanced samples, by hash (any size) or as the standard generator draws them (exact)."""

from __future__ import annotations

import random
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.dims import SAMPLING_ORDER
from spindrift.operators.ranks import joined, numbered
from spindrift.session import written


def hash_key(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def group_split(df: DataFrame, group: str, ratio: float = 0.7, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: the groups with the smallest hashes, ``floor(ratio * groups)`` of them, are
    train. A group is never divided. The threshold hash is found by counting groups under hash prefixes,
    so no task sorts them all."""
    groups = df.select(group).distinct().withColumn("_h", hash_key(seed, F.col(group)))
    return df.join(ranked_split(groups, ratio).select(group, "split"), group)


def row_split(df: DataFrame, key: str, ratio: float = 0.7, seed: int = 42) -> DataFrame:
    return ranked_split(df.withColumn("_h", hash_key(seed, F.col(key))), ratio).drop("_h")


def hash_bound(df: DataFrame, wanted: int) -> str:
    """The shortest prefix such that the ``wanted`` smallest hashes ``_h`` are those up to it. Rows are
    counted under one digit more each time, 16 counts, so no task sorts them all."""
    prefix, below, bound = "", 0, ""
    while wanted:
        at = len(prefix) + 1
        counts = {r[0]: r[1] for r in df.where(F.col("_h").startswith(prefix)).groupBy(F.substring("_h", at, 1)).count().collect()}
        bound = ""
        for digit in "0123456789abcdef":
            if below + counts.get(digit, 0) >= wanted:
                bound = prefix + digit
                break
            below += counts.get(digit, 0)
        if below + counts.get(bound[-1], 0) == wanted or len(bound) == 32:
            break
        prefix = bound
    return bound


def ranked_split(df: DataFrame, ratio: float) -> DataFrame:
    """``split`` by rank of the column ``_h``: the smallest ``floor(ratio * rows)`` are train."""
    bound = hash_bound(df, int(df.count() * ratio))
    train = F.substring("_h", 1, len(bound)) <= bound if bound else F.lit(False)
    return df.withColumn("split", F.when(train, "train").otherwise("dev"))


def sample_questions(merged: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``qid`` of ``n`` questions of the table, those with the smallest hashes; all if there are not more."""
    every = merged.select("qid").distinct().withColumn("_h", hash_key(seed, F.col("qid")))
    if every.count() <= n:
        return every.select("qid")
    bound = hash_bound(every, n)
    return every.where(F.substring("_h", 1, len(bound)) <= bound if bound else F.lit(False)).select("qid")


def drawn_ranks(jobs: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Keys, ``rank`` and ``at``: what the standard generator draws for each row (keys, ``n``, ``k``, ``seed``) of
    ``jobs``: a ``sample`` of ``k`` of the ranks below ``n``, or the first ``k`` after a ``shuffle`` of them.

    A draw depends on all draws before it, so each row is one task; it holds ranks only, 8 bytes for each of ``n`` in
    a shuffle and about 100 for each of ``k`` in a sample, and no ids.
    """
    kinds = [jobs.schema[k].dataType.simpleString() for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (n, k, seed) in enumerate(zip(*(b.column(c).to_pylist() for c in ("n", "k", "seed")), strict=True)):
                draw = random.Random(seed)
                if how == "sample":
                    ranks = draw.sample(range(n), k)
                else:
                    ranks = array("q", range(n))
                    draw.shuffle(ranks)
                for first in range(0, k, 1 << 16):
                    some = pa.array(ranks[first : min(k, first + (1 << 16))], pa.int64())
                    at = pa.array(range(first, first + len(some)), pa.int64())
                    yield pa.record_batch([*(b.column(c).take(pa.array([i] * len(some))) for c in keys), some, at], [*keys, "rank", "at"])

    spread = jobs.select(*keys, "n", "k", "seed")
    spread = spread.repartition(*keys) if keys else spread
    return spread.mapInArrow(run, "".join(f"`{k}` {t}, " for k, t in zip(keys, kinds, strict=True)) + "rank long, at long")


def of_ranks(ranked: DataFrame, drawn: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the table numbered by ``rank`` that were drawn, with ``at``. Both sides are dealt by rank: Spark takes
    the draws, made in Python, for as small as the jobs they are made from, and would broadcast them."""
    return joined(ranked, drawn.hint("merge"), [*keys, "rank"]).drop("rank")


def exact_questions(merged: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``qid`` of ``n`` questions as the standard generator samples them from the sorted ids; all if there are not
    more."""
    ranked = numbered(merged.select("qid").distinct(), [], ["qid"])
    most = ranked.agg(F.count("*").alias("n")).select("n", F.lit(n).cast("long").alias("k"), F.lit(seed).cast("long").alias("seed"))
    drawn = drawn_ranks(most.where("n > k"), [], "sample").unionByName(most.where("n <= k").select(F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).alias("rank"), F.lit(0).cast("long").alias("at")))
    return of_ranks(ranked, drawn, []).select("qid")


def selected(merged: DataFrame, questions: DataFrame) -> DataFrame:
    """The rows of the chosen questions, tagged for training by :func:`tagged`."""
    return merged.join(questions.select("qid").distinct(), "qid", "left_semi")


def tagged(merged: DataFrame, strategy: str) -> DataFrame:
    """Adds ``sft_strategy``, ``tier_config``, ``tier`` and ``source_experiment`` by the experiment's name."""
    prior = F.get(F.split("experiment", "__"), F.lit(2))
    known = prior.isin("d1nu1nin", "u1nd1nin", "d2nu2nin", "u2nd2nin")
    tier = F.when(known, F.concat(F.lit("tier"), F.substring(prior, 2, 1))).otherwise("unknown")
    return merged.withColumns({"sft_strategy": F.lit(f"tier_{strategy}"), "tier_config": prior, "tier": tier, "source_experiment": F.col("experiment")})


def exact_row_split(df: DataFrame, order: list[str], ratio: float = 0.7, seed: int = 42) -> DataFrame:
    """``df`` with ``split`` and ``at``: its rows in the order of ``order`` are shuffled as the standard generator
    does; the first ``int(rows * ratio)`` are train."""
    ranked = numbered(df, [], order)
    jobs = ranked.agg(F.count("*").alias("n")).select("n", F.col("n").alias("k"), F.lit(seed).cast("long").alias("seed"), F.floor(F.col("n") * F.lit(ratio)).alias("cut"))
    cut = jobs.first()["cut"]
    return of_ranks(ranked, drawn_ranks(jobs, [], "shuffle"), []).withColumn("split", F.when(F.col("at") < cut, "train").otherwise("dev"))


def exact_group_split(df: DataFrame, group: str, ratio: float = 0.7, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: the sorted names of the groups are shuffled as the standard generator does; the first
    ``int(groups * ratio)`` are train. A group is never divided; rows without one are in none."""
    split = exact_row_split(df.select(group).distinct().where(F.col(group).isNotNull()), [group], ratio, seed)
    return df.join(split.select(group, "split"), group)


def weights(strategy: str) -> dict[str, float] | None:
    """``bare_A_upos_B_...``: thirteen weights in sampling order, normalised to 100; None if malformed or
    all zero."""
    pattern = "_".join(rf"{v}_(\d+(?:\.\d+)?)" for v in SAMPLING_ORDER)
    if not (m := re.fullmatch(pattern, strategy)) or not (total := sum(map(float, m.groups()))):
        return None
    return {v: float(x) / total * 100.0 for v, x in zip(SAMPLING_ORDER, m.groups(), strict=True)}


def weight_table(spark: SparkSession, strategy: str) -> DataFrame:
    if (w := weights(strategy)) is None:
        raise ValueError("malformed strategy")
    return spark.createDataFrame([(v, i, w[v]) for i, v in enumerate(SAMPLING_ORDER)], "probe_variant string, at int, pct double")


def experiments_of(dataset: str, model: str, strategy: str) -> list[tuple[str, str | None, str]]:
    """(experiment, tier, order) that a tier strategy (t0, t1, t2, t1t2) draws from."""
    tiers = {"t0": ["1", "2"], "t1": ["1"], "t2": ["2"], "t1t2": ["1", "2"]}[strategy]
    return [(f"{dataset}__{model}__{p}in__nocot", None if strategy == "t0" else f"tier{t}", o) for t in tiers for p, o in ((f"d{t}nu{t}n", "doc_first"), (f"u{t}nd{t}n", "user_first"))]


def pools(merged: DataFrame) -> DataFrame:
    """Rows in the pool they are drawn from: singles and document-first doubles of document-first
    experiments, user-first doubles of user-first ones. ``order`` is the experiment's."""
    mine = F.when(F.col("probe_variant").isin("updp", "updn", "undp", "undn"), F.col("order") == "user_first").otherwise(F.col("order") == "doc_first")
    return merged.where(mine)


def capacity(pool: DataFrame, table: DataFrame, by: list[str], total: int | None = None) -> DataFrame:
    """Per variant: available rows, the size of a whole sample they allow, and the target: the share of
    the smallest of those sizes, or of the given ``total`` (``T``)."""
    return targets(pool.groupBy(*by, "probe_variant").agg(F.count("*").alias("available")), table, by, total)


def targets(counts: DataFrame, table: DataFrame, by: list[str], total: int | None = None) -> DataFrame:
    """:func:`capacity` of counted pools: one row for each variant."""
    df = counts.join(F.broadcast(table), "probe_variant").where("pct > 0")  # 13 rows
    df = df.withColumn("max_size", F.floor(F.col("available") / (F.col("pct") / 100)))
    least = F.min("max_size").over(Window.partitionBy(*by)) if total is None else F.lit(total).cast("long")  # 13 rows a tier
    return df.withColumn("T", least).withColumn("target", F.floor(F.col("pct") / 100 * F.col("T")))


def balanced_sample(pool: DataFrame, table: DataFrame, by: list[str], seed: int = 42, total: int | None = None) -> DataFrame:
    """Rows of each variant up to its target, by hash of the question and the variant. The hash does not
    hold the tier, so equal pools give equal questions in both tiers.

    The pool is read once and written with its hashes. Its rows are counted under the hash's first digits, which
    gives capacities, targets and the digits where each target falls; rows below those are in, and only rows with
    these very digits (one in 65,536) are sorted.
    """
    keys = [*by, "probe_variant"]
    hashed = pool.join(F.broadcast(table.where("pct > 0").select("probe_variant", "at")), "probe_variant")  # 13 rows
    hashed = hashed.withColumn("_h", F.md5(F.concat_ws("|", (F.lit(seed) + F.col("at")).cast("string"), "qid"))).withColumn("_x", F.substring("_h", 1, 4))
    keyed = written(hashed.select(*pool.columns, "_h", "_x"), "pool")
    counts = written(keyed.groupBy(*keys, "_x").agg(F.count("*").alias("_n")), "counts")  # at most 65,536 a variant and tier
    sized = targets(counts.groupBy(*keys).agg(F.sum("_n").alias("available")), table, by, total).select(*keys, "target")
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_x"))
    cut = counts.join(F.broadcast(sized), keys).withColumn("_upto", upto).where(F.col("_upto") >= F.col("target"))  # 13 rows a tier
    cut = cut.groupBy(*keys).agg(F.min(F.struct("_x", (F.col("target") - F.col("_upto") + F.col("_n")).alias("wanted"))).alias("_cut"))
    keyed = keyed.join(F.broadcast(written(cut, "cut")), keys, "left")  # 13 rows a tier
    sure = keyed.where(F.col("_cut").isNull() | (F.col("_x") < F.col("_cut._x")))
    edge = keyed.where(F.col("_x") == F.col("_cut._x"))
    edge = edge.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_h", "qid")))
    edge = edge.where(F.col("_n") <= F.col("_cut.wanted")).drop("_n")
    return sure.unionByName(edge).drop("_h", "_x", "_cut")


def exact_sample(pool: DataFrame, table: DataFrame, by: list[str], seed: int = 42, total: int | None = None) -> DataFrame:
    """Rows of each variant up to its target, as the standard generator samples them from the pool sorted by
    question, with the seed of the variant; ``at``: their place among the draws."""
    keys = [*by, "probe_variant"]
    pool = written(pool, "pool")
    sized = capacity(pool, table, by, total)
    jobs = sized.select(*keys, F.col("available").alias("n"), F.least("available", "target").alias("k"), (F.lit(seed) + F.col("at")).cast("long").alias("seed"))
    ranked = numbered(pool.join(F.broadcast(table.where("pct > 0").select("probe_variant")), "probe_variant", "left_semi"), keys, ["qid"])  # 13 rows
    return of_ranks(ranked, drawn_ranks(jobs, keys, "sample"), keys)


def missing_variants(merged: DataFrame, table: DataFrame) -> DataFrame:
    """Variants with a weight that no row has, in the experiments that should give them."""
    wanted = table.where("pct > 0").select("probe_variant")
    return wanted.join(merged.select("probe_variant").distinct(), "probe_variant", "left_anti")


def tier_counts(sample: DataFrame, by: str = "tier") -> DataFrame:
    """Counts by variant and tier with totals of both kinds (null: all)."""
    return sample.cube("probe_variant", by).agg(F.count("*").alias("n"))


def shuffled(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """``df`` in an order by hash, the same for the same seed."""
    return df.orderBy(hash_key(seed, *map(F.col, keys)), *keys)


def range_parts(df: DataFrame, order: str, parts: int) -> DataFrame:
    """Adds ``part``: contiguous ranges of the row numbers in ``order`` (unique, from 0), the first ones a row
    longer where they do not divide evenly."""
    n = df.count()
    size, more = divmod(n, parts)
    at, cut = F.col(order), more * (size + 1)
    return df.withColumn("part", F.when(at < cut, F.floor(at / (size + 1))).otherwise(more + F.floor((at - cut) / max(size, 1))).cast("int"))
