"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; every row is indexed in the leaf that a descent by nearest centres ends
in. A query walks the tree through a priority queue: the node with the best outlook is opened next, so leaves come
in the order of promise. How many leaves are visited is calibrated: for some queries the true neighbours are found
by a scan of all rows, and visits are widened until the leaves visited hold the wanted share of them.

Leaves are packed into parts of a bounded number of rows, leaves beyond it are dealt over several, and the queries
of a part are dealt into blocks, so a task holds one block of rows and one of queries whatever the skew.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.common import table, written
from spindrift.llm.whitening import matrix, sound

#: Bounds of the fit: rows, and bytes of the rows as doubles.
FIT_ROWS, FIT_BYTES = 20_000, 64 << 20
#: Children of a node, sampled rows that a leaf holds at most, Lloyd rounds.
BRANCH, LEAF_ROWS, ROUNDS = 8, 32, 8
#: Queries whose neighbours are found by a scan, and the share of them that visits must reach there.
CALIBRATION, RECALL = 64, 0.95
#: Most rows of a part, least rows, bytes of a part's rows, queries scored together, pairs scored together.
PART_ROWS, LEAST_ROWS, PART_BYTES, TOGETHER, PAIRS = 4_096, 256, 16 << 20, 256, 1 << 16


@dataclass
class Tree:
    """Nodes with their centre, the root mean square distance of their rows to it (``spread``) and their children;
    ``leaf`` is a leaf's number in the order of the tree, -1 of other nodes."""

    centres: np.ndarray
    spread: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assigned(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: at every node the child with the nearest centre, the first of equals."""
        node = np.zeros(len(x), np.int64)
        open_rows = np.arange(len(x)) if self.children[0] else np.zeros(0, np.int64)
        while len(open_rows):
            open_rows = open_rows[np.argsort(node[open_rows], kind="stable")]
            cuts = np.flatnonzero(np.diff(node[open_rows], prepend=-1))
            for rows in np.split(open_rows, cuts[1:]):
                below = np.array(self.children[node[rows[0]]])
                node[rows] = below[nearest(x[rows], self.centres[below])]
            open_rows = open_rows[self.leaf[node[open_rows]] < 0]
        return self.leaf[node]

    def outlooks(self, x: np.ndarray) -> np.ndarray:
        """For each query and node: the inner product with the centre, and what the spread may add to it."""
        return x @ self.centres.T + np.linalg.norm(x, axis=1)[:, None] * self.spread

    def visits(self, outlook: list[float], most: int) -> list[int]:
        """The first leaves of a query, best bin first."""
        out: list[int] = []
        queue = [(-outlook[0], 0)]
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-outlook[child], child))
            else:
                out.append(int(self.leaf[node]))
        return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    return np.argmax(x @ centres.T - (centres * centres).sum(1) / 2, axis=1)


def clusters(x: np.ndarray, k: int, draw: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """A cluster number for each row: k-means, started at rows drawn far from those drawn before."""
    centres = x[draw.integers(len(x), size=1)]
    far = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k and np.isfinite(total := far.sum()) and total > 0:
        centres = np.vstack([centres, x[min(int(np.searchsorted(np.cumsum(far), draw.random() * total, "right")), len(x) - 1)]])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
    own = nearest(x, centres)
    for _ in range(rounds):
        centres = np.array([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        new = nearest(x, centres)
        if (new == own).all():
            break
        own = new
    return own


def fit_tree(sample: np.ndarray, branch: int = BRANCH, leaf_rows: int = LEAF_ROWS, seed: int = 1) -> Tree:
    """A tree over the distinct rows of the sample; nodes of up to ``leaf_rows`` rows, or whose rows k-means
    can't divide, are leaves."""
    x, draw = np.unique(sample, axis=0), np.random.default_rng(seed)
    rows, children = [np.arange(len(x))], [[]]
    todo = [0]
    while todo:
        node = todo.pop()
        if len(rows[node]) <= leaf_rows:
            continue
        own = clusters(x[rows[node]], branch, draw)
        if len(found := np.unique(own)) < 2:
            continue
        for c in found:
            children[node].append(len(rows))
            todo.append(len(rows))
            rows.append(rows[node][own == c])
            children.append([])
    centres = np.array([x[r].mean(0) for r in rows])
    spread = np.array([np.sqrt(((x[r] - c) ** 2).sum(1).mean()) for r, c in zip(rows, centres, strict=True)])
    leaf, walk, n = np.full(len(rows), -1), [0], 0
    while walk:  # leaves in the order of the tree, so that neighbours are packed together
        node = walk.pop()
        if children[node]:
            walk += children[node][::-1]
        else:
            leaf[node], n = n, n + 1
    return Tree(centres, np.nan_to_num(spread), children, leaf)


def best(q_ids: np.ndarray, q: np.ndarray, wanted: list[list[int]] | None, ids: np.ndarray, x: np.ndarray, leaf: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``q``, places in ``x`` and scores: for each query the ``k`` best rows of the leaves it wants (None:
    all), not counting those of its own id; of rows with one id the best. Ties go to the smaller id.

    Products are made in blocks; those near the k-th are made again, each by itself, so that equal vectors have
    equal scores.
    """
    order = np.lexsort((ids, leaf))
    x, known = x[order], ids[order]
    leaves, start = np.unique(leaf[order], return_index=True)
    ends = np.append(start[1:], len(known))
    once = len(np.unique(known)) == len(known)
    longest = np.sqrt((x * x).sum(1).max(initial=0))
    for first in range(0, len(q), TOGETHER):
        part, part_ids = q[first : first + TOGETHER], q_ids[first : first + TOGETHER]
        score = np.full((len(part), len(known)), -np.inf)
        want = np.ones((len(part), len(leaves)), bool)
        if wanted is not None:
            want[:] = False
            own = wanted[first : first + TOGETHER]
            at = np.concatenate([np.asarray(w, np.int64) for w in own]) if own else np.zeros(0, np.int64)
            column = np.searchsorted(leaves, at)
            there = column < len(leaves)
            there[there] = leaves[column[there]] == at[there]
            want[np.repeat(np.arange(len(own)), [len(w) for w in own])[there], column[there]] = True
        for j, (a, b) in enumerate(zip(start, ends, strict=True)):
            if (some := np.flatnonzero(want[:, j])).size:
                score[some, a:b] = part[some] @ x[a:b].T
        for i in np.flatnonzero(np.isin(part_ids, known)):
            score[i, known == part_ids[i]] = -np.inf
        score[np.isnan(score)] = -np.inf
        least = np.full(len(part), -np.inf)
        if once and len(known) > k:
            slack = 1e-13 * max(1, x.shape[1]) * longest * np.sqrt((part * part).sum(1))
            least = np.partition(score, len(known) - k, axis=1)[:, len(known) - k] - slack
            least[np.isnan(least)] = -np.inf
        i, j = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        exact = np.concatenate([(part[i[a : a + PAIRS]] * x[j[a : a + PAIRS]]).sum(1) for a in range(0, len(i), PAIRS)]) if len(i) else np.zeros(0)
        if not once:
            to = np.lexsort((-exact, known[j], i))
            i, j, exact = i[to], j[to], exact[to]
            new = np.ones(len(i), bool)
            new[1:] = (i[1:] != i[:-1]) | (known[j[1:]] != known[j[:-1]])
            i, j, exact = i[new], j[new], exact[new]
        to = np.lexsort((known[j], -exact, i))
        i, j, exact = i[to], j[to], exact[to]
        rank = np.arange(len(i)) - np.searchsorted(i, i, "left")
        top = rank < k
        yield i[top] + first, order[j[top]], exact[top]


def _doubles(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return matrix(column).astype(np.float64)


@dataclass
class Index:
    """The written table ``_key, _v, _leaf, _salt`` (``_salt`` counts the rows of a task) with its tree, the rows of
    each leaf, and the vectors' size."""

    rows: DataFrame
    tree: Tree
    counts: list[int]
    dims: int


def build_index(df: DataFrame, key: str, vector: str, fit_rows: int = FIT_ROWS) -> Index | None:
    """Every row with a key and a sound vector other than zero, in its leaf; None where there is none.

    Vectors of another size than most rows' take no part; of equally many the longer size counts. The tree is
    fitted on about ``fit_rows`` rows, those with the smallest hashes of key and vector.
    """
    spark = df.sparkSession
    df = df.select(F.col(key).cast("long").alias("_key"), F.col(vector).alias("_v")).where(F.col("_key").isNotNull() & sound(F.col("_v")) & F.exists("_v", lambda c: c != 0))
    sizes = df.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return None
    n, dims = sizes["count"], sizes["d"]
    df = df.where(F.size("_v") == dims)
    most = max(1, min(fit_rows, FIT_BYTES // (8 * dims)))
    few = df if n <= most else df.where(F.pmod(F.xxhash64("_key", "_v"), F.lit(1 << 40)) < F.lit(int(most / n * (1 << 40))))
    tree = fit_tree(_doubles(few.select("_v").limit(2 * most).toArrow()["_v"]))
    held = spark.sparkContext.broadcast(tree)  # bounded by the fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for b in batches:
            leaf = held.value.assigned(_doubles(b.column(1)))
            yield pa.record_batch([*b.columns, pa.array(leaf, pa.int32()), pa.array(np.arange(done, done + len(leaf)), pa.int64())], ["_key", "_v", "_leaf", "_salt"])
            done += len(leaf)

    kind = df.schema["_v"].dataType.simpleString()
    rows = written(df.mapInArrow(run, f"_key long, _v {kind}, _leaf int, _salt long"), "index")
    counts = [0] * tree.leaves
    for r in rows.groupBy("_leaf").count().collect():  # one row a leaf
        counts[r[0]] = r[1]
    return Index(rows, tree, counts, dims)


def ranked(found: DataFrame, k: int, *more: str) -> DataFrame:
    """The ``k`` best rows of each query, each id once, with ``rank``."""
    once = found.groupBy("query_id", "vec_id").agg(F.max(F.struct("score", *more)).alias("_b")).select("query_id", "vec_id", "_b.*")
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", at).where(F.col("rank") <= k)


def calibrated(index: Index, queries: DataFrame, k: int, recall: float = RECALL, most: int = CALIBRATION) -> int:
    """How many leaves a query visits: widened until, over the ``most`` queries with the smallest hashes, the
    leaves visited hold the share ``recall`` of the true ``k`` nearest, which a scan of all rows finds."""
    some = queries.orderBy(F.xxhash64("_key", "_v"), "_key").limit(most).toArrow()
    ids, q = some["_key"].to_numpy(), _doubles(some["_v"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, leaf = b.column(0).to_numpy(), b.column(2).to_numpy()
            for i, j, score in best(ids, q, None, keys, _doubles(b.column(1)), np.zeros(len(keys), np.int64), k):
                yield pa.record_batch([pa.array(i), pa.array(keys[j]), pa.array(score), pa.array(leaf[j])], ["query_id", "vec_id", "score", "leaf"])

    truth = ranked(index.rows.select("_key", "_v", "_leaf").mapInArrow(scan, "query_id long, vec_id long, score double, leaf int"), k, "leaf").select("query_id", "leaf").collect()  # ``most`` times ``k`` rows
    place = []
    for i, outlook in enumerate(index.tree.outlooks(q).tolist()):
        order = {leaf: at for at, leaf in enumerate(index.tree.visits(outlook, index.tree.leaves))}
        place += [order[r["leaf"]] for r in truth if r["query_id"] == i]
    visits = 1
    while visits < index.tree.leaves and sum(at < visits for at in place) < recall * len(place):
        visits += max(1, visits // 8)
    return min(visits, index.tree.leaves)


def packed(counts: list[int], most: int) -> list[tuple[int, int]]:
    """For each leaf its first part and its number of parts: neighbours share a part of up to ``most`` rows, a
    leaf with more has parts of its own."""
    out, part, held = [], 0, 0
    for n in counts:
        if held and held + n > most:
            part, held = part + 1, 0
        parts = -(-n // most) if n > most else 1
        out.append((part, parts))
        if parts > 1:
            part, held = part + parts, 0
        else:
            held += n
    return out


def nearest_neighbours(index: Index | None, queries: DataFrame | None, k: int, recall: float = RECALL) -> DataFrame | None:
    """``query_id, rank, vec_id, score``: of the rows of each query's visited leaves the ``k`` with the largest
    inner product in double precision, without those of the query's own id, ties to the smaller id.

    ``queries`` has ``_key`` and ``_v`` as the index has them. Rows of one id count as one by the best of their
    vectors, and so do queries. Fewer candidates than ``k`` are all given. A product that is NaN is no candidate; one
    beyond a double is infinite. None without an index.
    """
    if index is None:
        return None
    spark = index.rows.sparkSession
    queries = written(queries.select("_key", "_v").distinct(), "queries")
    visits = calibrated(index, queries, k, recall)
    n = sum(index.counts)
    most = max(LEAST_ROWS, min(PART_ROWS, PART_BYTES // (8 * index.dims), n // 64))
    places = packed(index.counts, most)
    held = spark.sparkContext.broadcast((index.tree, places))  # bounded by the fit

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, place = held.value
        for b in batches:
            for first in range(0, b.num_rows, TOGETHER):
                few = b.slice(first, TOGETHER)
                row, part, leaves = [], [], []
                for i, outlook in enumerate(tree.outlooks(_doubles(few.column(1))).tolist()):
                    parts: dict[int, list[int]] = {}
                    for leaf in tree.visits(outlook, visits):
                        for p in range(place[leaf][0], sum(place[leaf])):
                            parts.setdefault(p, []).append(leaf)
                    row += [i] * len(parts)
                    part += parts.keys()
                    leaves += parts.values()
                at = pa.array(row, pa.int64())
                yield pa.record_batch([few.column(0).take(at), few.column(1).take(at), pa.array(part, pa.int64()), pa.array(leaves, pa.list_(pa.int32()))], ["_key", "_v", "_part", "_leaves"])

    kind = index.rows.schema["_v"].dataType.simpleString()
    spread = queries.repartition(max(1, -(-queries.count() // (2 * TOGETHER))), "_key")
    routes = written(spread.mapInArrow(route, f"_key long, _v {kind}, _part long, _leaves array<int>"), "routes")
    blocks = written(routes.groupBy("_part").agg(F.ceil(F.count("*") / (2 * most)).cast("int").alias("_blocks")), "blocks")
    asked = routes.join(blocks, "_part").withColumn("_block", F.pmod(F.xxhash64("_key", "_v"), F.col("_blocks")).cast("int")).select("_part", "_block", "_key", "_v", "_leaves")
    where = spark.createDataFrame([(i, a, m) for i, (a, m) in enumerate(places)], "_leaf int, _first long, _parts int")
    rows = index.rows.join(F.broadcast(where), "_leaf").withColumn("_part", F.col("_first") + F.pmod(F.col("_salt"), F.col("_parts")))  # one row a leaf
    rows = rows.join(blocks, "_part").select("_part", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), "_key", "_v", "_leaf")

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        q_ids, ids = asked["_key"].to_numpy(), rows["_key"].to_numpy()
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(ids) and len(q_ids):
            for i, j, score in best(q_ids, _doubles(asked["_v"]), asked["_leaves"].to_pylist(), ids, _doubles(rows["_v"]), rows["_leaf"].to_numpy(), k):
                for held, new in zip(out, (q_ids[i], ids[j], score), strict=True):
                    held.append(new)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, out), strict=True)))

    found = rows.groupBy("_part", "_block").cogroup(asked.groupBy("_part", "_block")).applyInArrow(search, "query_id long, vec_id long, score double")
    return ranked(found, k).select("query_id", "rank", "vec_id", "score")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    out = nearest_neighbours(index, index and index.rows.where(F.col("_key") % 20 == 0), 20)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out
