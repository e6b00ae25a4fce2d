"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector v by K functions floor((a.v + b) / w) with normally distributed a, which are 2-stable: along a,
two vectors at Euclidean distance r differ by a normal variable of deviation r. So the chance that a neighbour at
distance r lies in a given bucket of a query's table is a product of K normal probabilities. Of every table a query visits
its own bucket and perturbed ones, the most probable first, until the chances over all tables reach `success`. The candidates
of all tables are merged by id, ranked by their exact distances in double precision, and the first k returned.

`fitted` learns three numbers, all from bounded samples: r, the largest distance to a k-th neighbour among SAMPLE_QUERIES
queries that are compared with every row; the spread of SAMPLE_ROWS rows; and K, such that a bucket holds about
OCCUPANCY rows and a query visits PROBES buckets of a table or so. It cuts nothing off: what is visited is decided by
`success` alone, every row is indexed, and buckets have no size limit. A query whose buckets hold fewer than k rows is
compared with every row instead.

Distances grow alike as vectors lose structure. In unit vectors of independent components (the test tables) the tenth
neighbour is three quarters as far as the mean row, and no hashing tells them apart cheaply: there most rows are visited.

A vector that is null, zero, or holds a null or non-finite component takes no part, nor one of another length than most,
nor one without id. Rows that repeat an id are one candidate, as far as its nearest vector; of queries that repeat an id the
one with the smallest vector counts. Ties go to the smaller id. Other columns are ignored. Empty tables give no rows. Rows whose
squared distance is beyond the range of doubles are not found.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockline.llm.common import mixed, ship_package
from stockline.llm.vectors import best_rows, blocks, finite, in_batches, matrix, usual_size
from stockline.operators.scale import checkpointed

SUCCESS = 0.95
TABLES = 3
OCCUPANCY = 1024
PROBES = 256
SAMPLE_QUERIES, SAMPLE_ROWS = 64, 4096
QUERY_BATCH = 2048  # queries that are sent to all tasks at a time when they are compared with every row
QUERY_BLOCK = 256  # queries of a bucket in one row
HELD = 500_000  # candidates a task holds before it keeps the best only
REACH = 3  # slots visited to either side

_SEED = 90_061
_FOUND = "query_id long, vec_id long, score double"


class Fit(NamedTuple):
    """The hash functions: projections (tables, width, K), offsets (tables, K), slot width, radius, chance per table."""

    projections: np.ndarray
    offsets: np.ndarray
    slot: float
    radius: float
    chance: float


# ---- rows ----


def usable(rows: DataFrame, name: str, vector: str) -> DataFrame:
    """vec_id, vec (doubles) of the rows that take part, of whatever length."""
    cast = F.col(vector).cast("array<double>")
    plain = rows.select(F.col(name).cast("long").alias("vec_id"), cast.alias("vec"))
    return plain.filter(F.col("vec_id").isNotNull() & finite(F.col("vec")) & F.exists("vec", lambda x: x != 0))


def _distances(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact distances of pairs of rows of two matrices."""
    return np.sqrt(np.square(queries - rows).sum(axis=1))


def _nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple:
    """(query ids, ids, exact distances) of the k nearest rows of a block to each query, its own id left out."""
    squares = np.square(q).sum(axis=1)[:, None] + np.square(x).sum(axis=1)[None] - 2 * (q @ x.T)
    squares[q_ids[:, None] == ids[None]] = np.inf
    # Repeats of an id could fill the k places, and ties are decided by id: all rows as near as the k-th of different ids go on.
    if len(ids) > k:
        unique = len(np.unique(ids)) == len(ids)
        edge = np.partition(squares, k - 1, axis=1)[:, k - 1] if unique else np.full(len(q), np.inf)
        slack = 1e-9 * (1 + np.abs(edge)) * (1 + np.square(x).sum(axis=1).max())
        rows, cols = np.nonzero((squares <= (edge + slack)[:, None]) & np.isfinite(squares))
    else:
        rows, cols = np.nonzero(np.isfinite(squares))
    return q_ids[rows], ids[cols], _distances(q[rows], x[cols])


class _Best:
    """The best candidates of each query so far, in bounded memory."""

    def __init__(self, k: int) -> None:
        self.k, self.held, self.size = k, [], 0

    def add(self, part: tuple) -> Iterator[pa.RecordBatch]:
        self.held.append(part)
        self.size += len(part[0])
        if self.size > HELD:
            yield from self.kept(HELD // 2)

    def kept(self, most: int = -1) -> Iterator[pa.RecordBatch]:
        """Keep the best; if more than `most` rows are left, they are handed over."""
        if not self.held:
            return
        query, name, score = (np.concatenate(parts) for parts in zip(*self.held))
        chosen = best_rows(query, score, name, self.k)
        query, name, score = query[chosen], name[chosen], score[chosen]
        if len(query) > most:
            self.held, self.size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(name), pa.array(score)], ["query_id", "vec_id", "score"])
        else:
            self.held, self.size = [(query, name, score)], len(query)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of candidates (query_id, vec_id, score), which may repeat."""
    merged = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    top = merged.withColumn("rank", place).filter(F.col("rank") <= k)
    return top.select("query_id", "rank", "vec_id", "score")


# ---- every row ----


def compared_with_all(queries: list, rows: DataFrame, k: int, width: int) -> DataFrame:
    """Candidates (query_id, vec_id, score), the k nearest among them, for at most QUERY_BATCH queries (vec_id, vec)."""
    spark = rows.sparkSession
    q_ids = np.array([row["vec_id"] for row in queries], dtype=np.int64)
    q = np.array([row["vec"] for row in queries], dtype=np.float64).reshape(-1, width)
    shared = spark.sparkContext.broadcast((q_ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for block in blocks(batches, 4096):
            ids, x = block.column(0).to_numpy(), matrix(block.column(1), width, np.float64)
            yield from best.add(_nearest(*shared.value, ids, x, k))
        yield from best.kept()

    ship_package(spark)
    return rows.mapInArrow(run, _FOUND)


# ---- the index ----


def _normal(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(z / math.sqrt(2)))


def probes(place: np.ndarray, slot: float, radius: float, chance: float) -> np.ndarray:
    """Slots (probes, K) of the buckets to visit, in order of the chance to hold a neighbour at `radius`, until `chance` is reached.

    place: where the query lies along each projection. Best-first over the ranks of the slots of each projection: a state
    has one parent, so none comes twice.
    """
    own = np.floor(place / slot).astype(np.int64)
    steps = np.arange(-REACH, REACH + 2)
    likely = np.diff(_normal(((own[:, None] + steps) * slot - place[:, None]) / radius), axis=1)
    order = np.argsort(-likely, axis=1, kind="stable")
    with np.errstate(divide="ignore"):
        cost = -np.log(np.take_along_axis(likely, order, axis=1))
    slots = own[:, None] + steps[order]
    n, most = cost.shape
    waiting, sure, states = [(float(cost[:, 0].sum()), (0,) * n, 0)], 0.0, []
    while waiting and sure < chance:
        paid, state, last = heapq.heappop(waiting)
        sure += math.exp(-paid)
        states.append(state)
        for i in range(last, n):
            if state[i] + 1 < most and np.isfinite(dearer := paid + cost[i, state[i] + 1] - cost[i, state[i]]):
                heapq.heappush(waiting, (float(dearer), (*state[:i], state[i] + 1, *state[i + 1 :]), i))
    return slots[np.arange(n), np.array(states)]


def bucket_keys(slots: np.ndarray, table: int) -> np.ndarray:
    """(n, K) slots to n 64-bit keys; the table is part of the key. Equal keys of other slots cost trials only."""
    key = np.full(len(slots), table + 1, dtype=np.uint64)
    for i in range(slots.shape[1]):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + slots[:, i].astype(np.int64).view(np.uint64))
    return key.view(np.int64)


def fitted(rows: DataFrame, queries: DataFrame, k: int, n: int, width: int, success: float = SUCCESS, tables: int = TABLES) -> Fit:
    """The index's parameters for usable rows and queries (vec_id, vec) of one length."""
    spread_out = F.xxhash64("vec_id"), F.col("vec_id")
    few = queries.orderBy(*spread_out).limit(SAMPLE_QUERIES).collect()
    reached = ranked(compared_with_all(few, rows, k, width), k).groupBy("query_id").agg(F.max("score").alias("far"))
    radius = reached.agg(F.max("far")).first()[0] or 0.0
    some = np.array([row["vec"] for row in rows.orderBy(*spread_out).limit(SAMPLE_ROWS).collect()], dtype=np.float64)
    some = some.reshape(-1, width)
    spread = math.sqrt(some.var(axis=0).sum()) if len(some) else 0.0
    radius = max(radius, 1e-6 * spread, 1e-12)
    slot, chance = 2 * radius, 1 - (1 - success) ** (1 / tables)
    slots_per_function = max(1.3, spread * math.sqrt(2 * math.pi * math.e) / slot)
    functions = max(1, min(24, math.ceil(math.log(max(n / OCCUPANCY, 1)) / math.log(slots_per_function))))
    rng = np.random.default_rng(_SEED)
    projections, offsets = rng.normal(size=(tables, width, 24)), rng.uniform(0, slot, (tables, 24))
    places = np.array([row["vec"] for row in few], dtype=np.float64).reshape(-1, width) @ projections[0] + offsets[0]
    while functions > 1:
        if np.mean([len(probes(p[:functions], slot, radius, chance)) for p in places[:8]]) <= PROBES:
            break
        functions -= 1
    return Fit(projections[:, :, :functions], offsets[:, :functions], slot, radius, chance)


def _packed(key: np.ndarray, ids: np.ndarray, x: np.ndarray, most: int, names: list[str]) -> pa.RecordBatch:
    """Rows of (key, ids, vectors) with at most `most` vectors of a key each."""
    order = np.argsort(key, kind="stable")
    key, ids, x = key[order], ids[order], x[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    cuts = [c for a, b in zip(starts, np.r_[starts[1:], len(key)]) for c in range(a, b, most)]
    ends = [*cuts[1:], len(key)]
    columns = [
        pa.array(key[cuts]),
        pa.array([ids[a:b].tobytes() for a, b in zip(cuts, ends)], type=pa.binary()),
        pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends)], type=pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names)


def indexed(rows: DataFrame, fit: Fit, width: int) -> DataFrame:
    """bucket, ids, vecs: the rows of each bucket of each table, packed where they are read, in parts of 1024."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            ids, x = block.column(0).to_numpy(), matrix(block.column(1), width, np.float64)
            for t, (a, b) in enumerate(zip(fit.projections, fit.offsets)):
                keys = bucket_keys(np.floor((x @ a + b) / fit.slot).astype(np.int64), t)
                yield _packed(keys, ids, x, 1024, ["bucket", "ids", "vecs"])

    ship_package(rows.sparkSession)
    return rows.mapInArrow(run, "bucket long, ids binary, vecs binary")


def visits(queries: DataFrame, fit: Fit, width: int) -> DataFrame:
    """bucket, query_ids, queries: the queries that visit each bucket, in parts of QUERY_BLOCK."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1024):
            ids, q = block.column(0).to_numpy(), matrix(block.column(1), width, np.float64)
            for t, (a, b) in enumerate(zip(fit.projections, fit.offsets)):
                found = [bucket_keys(probes(p, fit.slot, fit.radius, fit.chance), t) for p in q @ a + b]
                of = np.repeat(np.arange(len(q)), list(map(len, found)))
                yield _packed(np.concatenate(found), ids[of], q[of], QUERY_BLOCK, ["bucket", "query_ids", "queries"])

    ship_package(queries.sparkSession)
    return queries.mapInArrow(run, "bucket long, query_ids binary, queries binary")


def candidates(index: DataFrame, visited: DataFrame, k: int, width: int) -> DataFrame:
    """query_id, vec_id, score: the k nearest of what each query meets, worked out where buckets and visits meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            for ids, x, q_ids, q in zip(*(batch.column(c) for c in range(4))):
                ids, q_ids = (np.frombuffer(c.as_buffer(), dtype=np.int64) for c in (ids, q_ids))
                x, q = (np.frombuffer(c.as_buffer(), dtype=np.float64).reshape(-1, width) for c in (x, q))
                yield from best.add(_nearest(q_ids, q, ids, x, k))
        yield from best.kept()

    met = index.join(visited, "bucket").select("ids", "vecs", "query_ids", "queries")
    return met.mapInArrow(run, _FOUND)


def nearest(
    rows: DataFrame, is_query: Column, k: int, name: str = "vec_id", vector: str = "embedding",
    success: float = SUCCESS, tables: int = TABLES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query row; is_query is a condition on vec_id."""
    parts = usable(rows, name, vector)
    n, width = usual_size(parts, "vec")
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = parts.filter(F.size("vec") == width)
    queries = checkpointed(parts.filter(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec")))
    fit = fitted(parts, queries, k, n, width, success, tables)
    # Few queries are packed in few tasks, so that those of a bucket come together.
    packing = queries.coalesce(1 + n // 1_000_000)
    top = checkpointed(ranked(candidates(indexed(parts, fit, width), visits(packing, fit, width), k, width), k))
    served = top.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = checkpointed(queries.join(served, "vec_id", "left_anti"))
    again = [ranked(compared_with_all(batch, parts, k, width), k) for batch in in_batches(short, QUERY_BATCH)]
    if not again:
        return top
    found = top.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
    return reduce(DataFrame.union, again, found.select(*again[0].columns))
