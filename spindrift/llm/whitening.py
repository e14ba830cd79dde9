"""Embedding whitening by hierarchical SVD merging.

Each partition turns its rows into a summary: their number, mean, and the singular values and right vectors of
the centred rows, all of them. Two summaries merge without loss: the scaled vectors of both, with one more row
that corrects for the difference of the means, have the same scatter matrix as all rows together, and their SVD
is the merged summary. Partitions merge their own batches; groups of summaries are merged in rounds until one is
left, whose vectors are the components and whose squared values are n times the eigenvalues. No covariance matrix is
formed, so small eigenvalues keep their precision, and no dimension is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import table, written

#: Rows of a batch that are decomposed at once; summaries that one task merges in a round; singular values below
#: this share of the largest, times the root of the dimensions, are noise of rounding and can't be whitened.
ROWS, FAN, LEAST = 2_048, 8, 1e-13
_FIELDS = "id long, n long, sums array<decimal(38,0)>, mean array<double>, scaled array<array<double>>"


@dataclass
class Summary:
    """Of ``n`` rows: exact sums, the mean, and ``scaled``: right singular vectors of the centred rows times their
    singular values, as many rows as dimensions at most."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scaled: np.ndarray


def decomposed(rows: np.ndarray) -> np.ndarray:
    """All right singular vectors times their values; rows of zeros are left out."""
    if not rows.any():
        return rows[:0]
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def summary(rows: np.ndarray) -> Summary:
    """Of rows of numbers, at least one; integers have exact sums."""
    exact = rows.astype(object).sum(0) if rows.dtype == np.int64 and np.abs(rows, dtype=float).max(initial=0) * len(rows) >= 2**62 else rows.sum(0)
    values = rows.astype(np.float64)
    mean = values.mean(0)
    mean += (values - mean).mean(0)
    sums = [int(x) for x in exact] if rows.dtype == np.int64 else []
    return Summary(len(rows), sums, mean, decomposed(values - mean))


def merged(a: Summary, b: Summary) -> Summary:
    """The summary of the rows of both."""
    n = a.n + b.n
    apart = b.mean - a.mean
    correction = np.sqrt(a.n / n * b.n) * apart
    return Summary(n, [x + y for x, y in zip(a.sums, b.sums, strict=True)], a.mean + apart * (b.n / n), decomposed(np.vstack([a.scaled, b.scaled, correction])))


def _batch(at: int, s: Summary) -> pa.RecordBatch:
    sums = pa.array([s.sums], pa.list_(pa.decimal128(38, 0)))
    scaled = pa.array([s.scaled.tolist()], pa.list_(pa.list_(pa.float64())))
    return pa.record_batch([pa.array([at], pa.int64()), pa.array([s.n], pa.int64()), sums, pa.array([s.mean.tolist()], pa.list_(pa.float64())), scaled], ["id", "n", "sums", "mean", "scaled"])


def _read(row: dict) -> Summary:
    dims = len(row["mean"])
    return Summary(row["n"], [int(x) for x in row["sums"]], np.array(row["mean"]), np.array(row["scaled"], np.float64).reshape(-1, dims))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal sizes without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summarised(vectors: DataFrame, vector: str) -> Summary | None:
    """The summary of all rows of ``vectors``, whose column ``vector`` holds arrays of one size of longs or doubles
    without nulls; None of an empty table. What the driver gets is one summary: dims x (dims + 2) numbers."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = None
        for b in batches:
            for first in range(0, b.num_rows, ROWS):
                own = summary(matrix(b.column(0).slice(first, ROWS)))
                held = own if held is None else merged(held, own)
        if held is not None:
            yield _batch(TaskContext.get().partitionId(), held)

    def group(rows: pa.Table) -> pa.Table:
        rows = sorted(rows.to_pylist(), key=lambda r: r["id"])
        held = _read(rows[0])
        for r in rows[1:]:
            held = merged(held, _read(r))
        return pa.Table.from_batches([_batch(rows[0]["id"] // FAN, held)])

    parts = written(vectors.select(vector).mapInArrow(local, _FIELDS), "summaries")
    left = (parts.agg(F.max("id")).first()[0] or 0) + 1
    while left > 1:
        parts = parts.groupBy(F.floor(F.col("id") / FAN)).applyInArrow(group, _FIELDS)
        left = -(-left // FAN)
    found = parts.collect()  # one row
    return _read(found[0].asDict()) if found else None


@dataclass
class Whitening:
    """``n`` vectors with exact ``sums`` of each dimension; unit ``components`` as rows, by falling
    ``eigenvalues`` (divisor n), none of them zero; ``trace`` of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray, most: int | None = None) -> np.ndarray:
        """Rows centred, projected and scaled to unit variance, on the first ``most`` components."""
        mean = np.array([s / self.n for s in self.sums])
        left = np.array([float(s - self.n * round(m)) / self.n for s, m in zip(self.sums, mean.tolist(), strict=True)])  # the mean less its nearest integer, to full precision
        return ((x - np.round(mean)) - left) @ (self.components[:most] / np.sqrt(self.eigenvalues[:most])[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - sum) ** 2 of each row, exactly."""
        most = (int(np.abs(x).max(initial=0)) if x.min(initial=0) > -(2**63) else 2**63) * self.n + max(map(abs, self.sums), default=0)
        if most * most * max(1, x.shape[1]) < 2**63:
            d = x * self.n - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        return [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums, strict=True)) for row in x.tolist()]


def fit_whitening(distinct: DataFrame, vector: str = "x") -> Whitening | None:
    """Of a table of integer vectors of one size, each counted as often as it stands there; None without rows."""
    if (s := summarised(distinct, vector)) is None:
        return None
    _, values, components = np.linalg.svd(s.scaled, full_matrices=False) if len(s.scaled) else (None, np.zeros(0), np.zeros((0, len(s.mean))))
    eigen = values**2 / s.n
    kept = values > values.max(initial=0) * LEAST * np.sqrt(len(s.mean))
    return Whitening(s.n, s.sums, components[kept], eigen[kept], float(eigen.sum()))


def sound(vector: Column) -> Column:
    """The vector is there, not empty, and all its entries are finite."""
    v = vector.cast("array<double>")
    return vector.isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


def integers(df: DataFrame, vector: str, key: str, scale: int = 256) -> DataFrame:
    """``key, x``: sound vectors as ``floor(scale * c)``. Vectors of another size than most rows' take no part, nor
    do those with an entry beyond a long; of equally many the longer size counts."""
    df = df.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v")).where(sound(F.col("_v")) & F.forall("_v", lambda c: F.abs(c * F.lit(float(scale))) < F.lit(float(2**63))))
    sizes = df.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    df = df.where(F.size("_v") == (sizes["d"] if sizes else 0))
    return df.select(F.col("_key").alias(key), F.transform("_v", lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("x"))


def whiten(rows: DataFrame, model: Whitening, key: str, vector: str = "x", most: int | None = None) -> DataFrame:
    """``key, deviation`` (decimal; null beyond 38 digits) and the array ``whitened`` on the first ``most`` components, for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, ROWS):
                part = b.slice(first, ROWS)
                x = matrix(part.column(1))
                far = pa.array([None if d >= 10**38 else d for d in model.deviations(x)], pa.decimal128(38, 0))
                yield pa.record_batch([part.column(0), far, pa.array(model.whitened(x.astype(np.float64), most).tolist(), pa.list_(pa.float64()))], [key, "deviation", "whitened"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, vector).mapInArrow(run, f"`{key}` {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, vector: str = "whitened") -> float | None:
    """The largest absolute entry of the covariance of the whitened fit list less the identity, from its own
    summary; None without rows or components."""
    if (s := summarised(whitened, vector)) is None or not len(s.mean):
        return None
    return float(np.abs(s.scaled.T @ s.scaled / s.n - np.eye(len(s.mean))).max())


def whitened_components(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 4) -> DataFrame:
    """One row for each sound row of ``df`` and component up to ``most``: key, ``component`` from 1 by falling
    eigenvalue, ``n``, ``deviation`` (decimal), ``whitened``, ``explained``, ``identity_error``.

    Vectors become integers first (:func:`integers`), and the fit list has each distinct one once, so copies of any
    number weigh as one and are counted where they are read. Null or empty vectors, those with null or non-finite
    entries, and those of another size than most take no part. Keys may be null or repeat: rows are judged each.
    Where the fit list has less than ``most`` dimensions (a single vector has none), there are fewer components,
    as a component without variance can't be whitened; an empty table gives no rows. Equal eigenvalues come in any
    order, the same for all rows.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = written(integers(df, vector, key), "integers")
    distinct = written(rows.select("x").distinct(), "distinct")
    model = fit_whitening(distinct)
    if model is None or not len(model.components):
        return df.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    error = identity_error(whiten(distinct.withColumn("_none", F.lit(None).cast("long")), model, "_none", most=most))
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues[:most]))
    out = whiten(rows, model, key, most=most).select(key, "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return out.select(key, (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitened_components(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS long)"))
