"""Distribution metrics over (right, canonical wrong, all others) and their bootstrap intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.columns import computed
from spindrift.operators.merge import with_bare

#: Fixed value: added to each probability before renormalising.
EPSILON = 1e-9
PARTS = ("p_gold", "p_wrong", "p_other")
#: Cumulated probabilities of Poisson(1) in units of 2 ** -53; rows whose weights are drawn at once,
#: groups that they meet at once, and groups whose sums a task holds before it passes them on.
_POISSON = np.array([int(2**53 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(18)], np.uint64)
_ROWS, _GROUPS, _HELD = 2_000, 64, 1_000


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def prob_vectors(merged: DataFrame, keep: bool = False) -> DataFrame:
    """Adds the three probabilities. Rows without probabilities, with a letter missing among them or with
    gold equal to the canonical wrong answer are left out, or with ``keep`` have none."""
    place = lambda letter: F.coalesce(F.array_position(F.col("probs.letter"), F.col(letter)), F.lit(0)).cast("int")
    total = F.aggregate(F.col("probs.prob"), F.lit(0.0), lambda a, p: a + p)
    df = computed(merged, {"_g": place("gold"), "_w": place("canonical_wrong"), "_t": total})
    whole = (F.col("_g") > 0) & (F.col("_w") > 0) & (F.col("gold") != F.col("canonical_wrong"))
    df, own = (df, lambda c: F.when(whole, c)) if keep else (df.where(whole), lambda c: c)
    at = lambda c: own(F.get(F.col("probs.prob"), F.col(c) - 1))
    return computed(df, {"p_gold": at("_g"), "p_wrong": at("_w")}).withColumn("p_other", F.col("_t") - F.col("p_gold") - F.col("p_wrong")).drop("_g", "_w", "_t")


def smoothed(prefix: str = "") -> dict[str, Column]:
    raised = {p: F.col(prefix + p) + F.lit(EPSILON) for p in PARTS}
    total = raised["p_gold"] + raised["p_wrong"] + raised["p_other"]
    return {prefix + p: c / total for p, c in raised.items()}


def entropy(prefix: str = "") -> Column:
    return -sum((F.col(prefix + p) * F.log2(prefix + p) for p in PARTS[1:]), F.col(prefix + PARTS[0]) * F.log2(prefix + PARTS[0]))


def pearson(xs: list[Column], ys: list[Column]) -> Column:
    """Of three points; null unless both have spread (population deviation above 1e-6)."""
    mx, my = (xs[0] + xs[1] + xs[2]) / 3, (ys[0] + ys[1] + ys[2]) / 3
    sxy = sum(((x - mx) * (y - my) for x, y in zip(xs[1:], ys[1:], strict=True)), (xs[0] - mx) * (ys[0] - my))
    sxx = sum(((x - mx) * (x - mx) for x in xs[1:]), (xs[0] - mx) * (xs[0] - mx))
    syy = sum(((y - my) * (y - my) for y in ys[1:]), (ys[0] - my) * (ys[0] - my))
    return F.when((F.sqrt(sxx / 3) > 1e-6) & (F.sqrt(syy / 3) > 1e-6), sxy / F.sqrt(sxx * syy))


def absolute_metrics(vectors: DataFrame) -> DataFrame:
    """Entropy and -log2 of the right answer's probability, for every row."""
    return computed(vectors, smoothed()).withColumns({"entropy": entropy(), "neglogp": -F.log2("p_gold")})


def shift_columns(vectors: DataFrame) -> DataFrame:
    """Adds to each row, against the question's row without sources: KL divergence, change of entropy, of
    -log2 P(right), and correlation of the log probabilities; null where one of them has no vector."""
    df = with_bare(computed(vectors, smoothed()), list(PARTS)).withColumns({f"b_{p}": F.col(f"bare.{p}") for p in PARTS})
    kl = sum((F.col(p) * F.log2(F.col(p) / F.col(f"b_{p}")) for p in PARTS[1:]), F.col("p_gold") * F.log2(F.col("p_gold") / F.col("b_p_gold")))
    return df.withColumns({
        "kl": kl,
        "delta_entropy": entropy() - entropy("b_"),
        "delta_neglogp": F.log2("b_p_gold") - F.log2("p_gold"),
        "pearson": pearson([F.log2(p) for p in PARTS], [F.log2(f"b_{p}") for p in PARTS]),
    })


def shift_metrics(vectors: DataFrame) -> DataFrame:
    """The shifts of every row with sources whose question has a row without."""
    df = shift_columns(vectors).where("bare is not null and probe_variant <> 'bare'")
    return df.select("experiment", "qid", "probe_variant", "kl", "delta_entropy", "delta_neglogp", "pearson")


SHIFTS = ["kl", "delta_entropy", "delta_neglogp", "pearson"]


def means(shifts: DataFrame, metrics: list[str] = SHIFTS) -> DataFrame:
    """Mean of each metric over its finite values; ``n_samples`` counts all rows."""
    return shifts.groupBy("experiment", "probe_variant").agg(F.count("*").alias("n_samples"), *(F.avg(F.when(finite(F.col(m)), F.col(m))).alias(m) for m in metrics))


def percentile_interval(values: np.ndarray, level: float = 0.95, resamples: int = 1000, seed: int = 42) -> tuple[float | None, float | None, float | None, int]:
    """Mean, percentile bootstrap bounds and count; under ten values no bounds, without values nothing."""
    n = len(values)
    if n == 0:
        return None, None, None, 0
    mean = float(np.mean(values))
    if n < 10:
        return mean, None, None, n
    draw = np.random.RandomState(seed)
    found = np.array([np.mean(draw.choice(values, size=n, replace=True)) for _ in range(resamples)])
    tail = (1 - level) / 2 * 100
    return mean, float(np.percentile(found, tail)), float(np.percentile(found, 100 - tail)), n


def bootstrap_intervals(long: DataFrame, keys: list[str], value: str = "value", order: str = "qid", resamples: int = 1000, seed: int = 42) -> DataFrame:
    """Keys, ``mean, ci_low, ci_high, n`` of each group, drawn from its finite values in the order of ``order`` as
    :func:`percentile_interval` draws them, at any size: no group is gathered in a task. Groups without a finite
    value have no row."""
    from spindrift.operators.bootstrap import exact_intervals

    return exact_intervals(long.where(finite(F.col(value))), keys, value, order, resamples, seed)


def poisson_weights(rows: np.ndarray, resamples: int) -> np.ndarray:
    """Poisson(1) weights (resample, row) from 64 random bits of each row, whatever rows come with it."""
    x = rows.view(np.uint64)[None, :] + np.arange(1, resamples + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_POISSON, (x ^ x >> np.uint64(31)) >> np.uint64(11), side="right")


def poisson_intervals(long: DataFrame, keys: list[str], value: str = "value", order: str = "qid", resamples: int = 1000, seed: int = 42) -> DataFrame:
    """Intervals of groups of any size, with Poisson weights instead of draws: each row is weighted by itself, from the
    seed, the resample and its ``order``, so partial sums are all that moves and partitions change nothing
    but rounding. A row's weights are drawn once for all values of its ``order`` that come near each other. Values that
    are not finite do not count."""
    long = long.where(finite(F.col(value)))
    fields = ", ".join(f"`{k}` {long.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        kinds: list[pa.DataType] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array([key[j] for key in held], t) for j, t in enumerate(kinds)]
            made = [pa.array([x[j].tolist() for x in held.values()], pa.list_(pa.float64())) for j in (0, 1)]
            made += [pa.array([x[2] for x in held.values()], pa.float64()), pa.array([x[3] for x in held.values()], pa.int64())]
            held.clear()
            return pa.record_batch([*columns, *made], [*keys, "s", "w", "total", "n"])

        def add(names: list[tuple], of: np.ndarray, at: np.ndarray, values: np.ndarray, weights: np.ndarray) -> None:
            rows, at = np.unique(at, return_inverse=True)
            own, times = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            np.add.at(own, (at, of), values)
            np.add.at(times, (at, of), 1)
            s, w = weights[:, rows] @ own, weights[:, rows] @ times
            for j, key in enumerate(names):
                x = held.setdefault(key, [np.zeros(resamples), np.zeros(resamples), 0.0, 0])
                held[key] = [x[0] + s[:, j], x[1] + w[:, j], x[2] + float(own[:, j].sum()), x[3] + int(times[:, j].sum())]

        for b in batches:
            kinds = [b.schema.field(k).type for k in keys]
            number: dict[tuple, int] = {}
            of = np.fromiter((number.setdefault(key, len(number)) for key in zip(*(b.column(k).to_pylist() for k in keys), strict=True)), np.int64, b.num_rows)
            values, names = b.column(value).to_numpy(zero_copy_only=False).astype(float), list(number)
            # rows of one ``order`` share their weights, in all groups: those are drawn once
            bits, at = np.unique(b.column("_bits").to_numpy(), return_inverse=True)
            for first in range(0, len(bits), _ROWS):
                weights = poisson_weights(bits[first : first + _ROWS], resamples).astype(float)
                here = (at >= first) & (at < first + _ROWS)
                for group in range(0, len(names), _GROUPS):
                    some = here & (of >= group) & (of < group + _GROUPS)
                    if some.any():
                        present, own = np.unique(of[some], return_inverse=True)
                        add([names[i] for i in present], own, at[some] - first, values[some], weights)
                    if len(held) > _HELD:
                        yield out()
        if held:
            yield out()

    bits = F.xxhash64(F.lit(seed), order).alias("_bits")
    parts = long.select(*keys, value, bits).mapInArrow(run, f"{fields}, s array<double>, w array<double>, total double, n long")
    spread = parts.select(*keys, "total", "n", F.posexplode(F.arrays_zip("s", "w")).alias("at", "z"))
    sums = spread.groupBy(*keys, "at").agg((F.sum("z.s") / F.sum("z.w")).alias("m"), (F.sum("total") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    return sums.groupBy(*keys).agg(F.first("mean").alias("mean"), F.percentile("m", 0.025).alias("ci_low"), F.percentile("m", 0.975).alias("ci_high"), F.first("n").alias("n"))
