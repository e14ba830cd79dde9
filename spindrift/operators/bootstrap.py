"""Bootstrap intervals by the draws of a seeded generator, for groups of any size.

All groups of n values share one stream of draws, so how often each resample draws each rank is counted once for
each n: tasks begin at places far apart in the stream, count what is accepted, and deal the counts out by blocks of
ranks. Values get their ranks by a distributed sort and are cut into the same blocks; each block's counts times its
values give partial sums of every resample, which add up to the resamples' means.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import mersenne
from spindrift.operators.ranks import joined, numbered
from spindrift.session import written

#: Ranks of a block; groups whose blocks a task weighs together; values below which there are no bounds.
BLOCK, GROUPS, LEAST = 4_096, 256, 10
#: Outputs of the generator that one task makes, and those made at once; ranks counted in an array; stretches of
#: the streams that tasks begin at, at most, for each partition of the session's shuffles.
CHUNK, PIECE, DENSE, TASKS = 1 << 28, 1 << 22, 1 << 22, 4
_COUNTS = "n long, block long, resample int, dense boolean, counts binary"


def output_bits(n: Column) -> Column:
    """Bits of an output that a draw below ``n`` looks at."""
    return F.length(F.bin(n - 1))


def masked(n: int, generator: np.random.RandomState, outputs: int) -> Iterator[np.ndarray]:
    """The next outputs, piece by piece, without the leading bits that no number below ``n`` has."""
    mask = np.uint32((1 << (n - 1).bit_length()) - 1)
    while outputs > 0:
        made = mersenne.outputs(generator, min(PIECE, outputs)) & mask
        outputs -= len(made)
        yield made


def accepted(n: int, generator: np.random.RandomState, outputs: int) -> Iterator[np.ndarray]:
    """The draws below ``n`` that the next outputs give, piece by piece: what is not below ``n`` is skipped."""
    for made in masked(n, generator, outputs):
        yield made[made < n]


def spread(chunks: DataFrame) -> DataFrame:
    """``chunks`` (``n, chunk``) dealt evenly over tasks. Their rows are few bytes, so adaptive execution would put
    all of them into one task if the number of partitions were left to it."""
    most = TASKS * int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chunks.repartitionByRange(max(1, min(most, chunks.count())), "n", "chunk")


def draw_counts(sizes: DataFrame, resamples: int = 1000, seed: int = 42, chunk: int | None = None) -> DataFrame:
    """``n, block, resample, dense, counts`` for each distinct ``n`` (2 to 2**32) of ``sizes``: how often a resample
    draws the ranks of a block, as 16-bit counts of all its ranks (``dense``) or as the 16-bit places drawn.

    The rows of one resample and block add up: a resample that two tasks share has rows of both.
    """
    chunk = chunk or CHUNK
    words = mersenne.start(seed)
    wanted = F.lit(resamples) * F.pow(F.lit(2.0), output_bits(F.col("n")))
    some = F.ceil((wanted + 16 * F.sqrt(wanted) + 64) / chunk).cast("long")  # outputs that all but surely are enough
    chunks = sizes.select("n").distinct().select("n", F.explode(F.sequence(F.lit(0).cast("long"), some - 1)).alias("chunk"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = sum(int(np.count_nonzero(x < n)) for x in masked(n, mersenne.at(mersenne.ahead(words, k * chunk)), chunk))
                yield pa.record_batch([pa.array([n]), pa.array([k]), pa.array([found])], ["n", "chunk", "found"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, k, done in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield from blocks(n, accepted(n, mersenne.at(mersenne.ahead(words, k * chunk)), chunk), done)

    def blocks(n: int, pieces: Iterator[np.ndarray], done: int) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, own = None, -1
        for draws in pieces:
            draws = draws[: max(0, resamples * n - done)]
            while len(draws):
                r = done // n
                few, draws = draws[: (r + 1) * n - done], draws[(r + 1) * n - done :]
                done += len(few)
                if n > DENSE:
                    own_block = (few // BLOCK).astype(np.uint16 if n <= BLOCK << 16 else np.int64)  # 16 bits: a radix sort
                    few = few[np.argsort(own_block, kind="stable")]
                    at, first = np.unique(few // BLOCK, return_index=True)
                    rows += [(n, int(i), r, False, (x % BLOCK).astype("<u2").tobytes()) for i, x in zip(at, np.split(few, first[1:]), strict=True)]
                else:
                    if own != r and held is not None:
                        rows += whole(n, own, held)
                        held = None
                    new = np.bincount(few, minlength=n)
                    held, own = new if held is None else held + new, r
                if sum(len(x[-1]) for x in rows[-1:]) * len(rows) > 1 << 22:
                    yield batch(rows)
                    rows = []
        if held is not None:
            rows += whole(n, own, held)
        if rows:
            yield batch(rows)

    def whole(n: int, r: int, held: np.ndarray) -> list[tuple]:
        return [(n, i // BLOCK, r, True, held[i : i + BLOCK].astype("<u2").tobytes()) for i in range(0, n, BLOCK)]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["n", "block", "resample", "dense", "counts"])

    found = written(spread(chunks).mapInArrow(count, "n long, chunk long, found long"), "accepted")
    upto = F.sum("found").over(Window.partitionBy("n").orderBy("chunk")) - F.col("found")  # a row for each task
    placed = found.withColumn("done", upto).where(F.col("done") < F.col("n") * resamples)
    return spread(placed.select("n", "chunk", "done")).mapInArrow(deal, _COUNTS)


def resample_sums(values: DataFrame, keys: list[str], counts: DataFrame, resamples: int) -> DataFrame:
    """Keys, ``n`` and ``at, s``: the sum of the values that each resample draws, for groups whose ranked ``values``
    (keys, ``value``, ``rank``, ``n``) are drawn as ``counts`` says."""
    blocks = values.withColumn("block", F.floor(F.col("rank") / BLOCK)).groupBy(*keys, "n", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("values"))  # at most ``BLOCK`` values
    # different sizes of m values in all are fewer than the root of 2 * m; Spark takes the counts, made in Python, for as
    # small as the rows they are made from, and would broadcast them
    groups = F.broadcast(written(values.select(*keys, "n").distinct().groupBy("n").agg(F.ceil(F.count("*") / GROUPS).cast("int").alias("slabs")), "groups"))
    blocks = blocks.join(groups, "n").withColumn("slab", F.pmod(F.xxhash64(*keys) if keys else F.lit(0), F.col("slabs")).cast("int")).drop("slabs")
    dealt = counts.join(groups, "n").withColumn("slab", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1))).drop("slabs")
    fields = "".join(f"`{k}` {values.schema[k].dataType.simpleString()}, " for k in keys)

    def weigh(drawn: pa.Table, blocks: pa.Table) -> pa.Table:
        weights = np.zeros((resamples, BLOCK))
        if blocks.num_rows:
            for r, dense, raw in zip(*(drawn[c].to_pylist() for c in ("resample", "dense", "counts")), strict=True):
                x = np.frombuffer(raw, "<u2")
                if dense:
                    weights[r, : len(x)] += x
                else:
                    weights[r] += np.bincount(x, minlength=BLOCK)
        held = np.zeros((blocks.num_rows, BLOCK))
        for row, x in zip(held, blocks["values"].to_pylist(), strict=True):
            row[: len(x)] = x
        sums = held @ weights.T
        return pa.table({**{k: blocks[k] for k in keys}, "n": blocks["n"], "sums": pa.array(sums.tolist(), pa.list_(pa.float64()))})

    sums = dealt.groupBy("n", "block", "slab").cogroup(blocks.groupBy("n", "block", "slab")).applyInArrow(weigh, f"{fields}n long, sums array<double>")
    return sums.select(*keys, "n", F.posexplode("sums").alias("at", "s")).groupBy(*keys, "n", "at").agg(F.sum("s").alias("s"))


def exact_intervals(clean: DataFrame, keys: list[str], value: str = "value", order: str = "qid", resamples: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Keys, ``mean, ci_low, ci_high, n`` of each group of finite values, drawn from its values in the order of
    ``order`` (ties: of the value) as the seeded generator draws them for one array.

    A group may have up to 2**32 values and is in no task as a whole; groups under ten values have no bounds. A
    null key is a group of its own. An empty table gives no rows.
    """
    ranked = numbered(clean.select(*keys, F.col(value).alias("value"), F.col(order).alias("_order")), keys, ["_order", "value"], "rank", "n").drop("_order")
    ranked = written(ranked, "ranked")
    stats = ranked.groupBy(*keys).agg((F.sum("value") / F.count("*")).alias("mean"), F.count("*").alias("n"))
    large = ranked.where(F.col("n") >= LEAST)
    sums = resample_sums(large, keys, draw_counts(large.select("n"), resamples, seed), resamples)
    tail = (1 - level) / 2
    means = sums.withColumn("m", F.col("s") / F.col("n"))
    bounds = means.groupBy(*keys).agg(F.percentile("m", tail).alias("ci_low"), F.percentile("m", 1 - tail).alias("ci_high"))
    if not keys:
        return stats.where("n > 0").join(bounds, F.lit(True), "left").select("mean", "ci_low", "ci_high", "n")  # two rows
    return joined(stats, bounds, keys, "left").select(*keys, "mean", "ci_low", "ci_high", "n")
