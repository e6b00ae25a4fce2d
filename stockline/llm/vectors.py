"""Vectors in Arrow batches: usable rows, matrices of a block of rows, bounded batches of a frame, best rows so far."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block of vectors that a task holds at a time.
BLOCK_ROWS = 16_384


def finite(vector: Column) -> Column:
    """Whether an array of doubles is there and holds neither null nor NaN nor infinity."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, sound)


def usual_size(rows: DataFrame, vector: str) -> tuple[int, int]:
    """(rows, components) of the most frequent length, of ties the longer; (0, 0) without rows."""
    sizes = rows.groupBy(F.size(vector).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    return (int(first["n"]), int(first["size"])) if first else (0, 0)


def matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """A list column without nulls, of lists of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches joined to blocks of at least `rows` rows, but for the last one."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def in_batches(df: DataFrame, rows: int) -> Iterator[list]:
    """The rows of df in lists of at most `rows`: the driver holds one partition of df and one list at a time."""
    for batch in batched(df.toLocalIterator(prefetchPartitions=False), rows):
        yield list(batch)


def best_rows(group: np.ndarray, score: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Places of the k lowest scores of different names in each group, of ties the smaller names; a name counts by its lowest."""
    order = np.lexsort((score, name, group))
    g, n = group[order], name[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (g[1:] != g[:-1]) | (n[1:] != n[:-1])
    order = order[first]
    order = order[np.lexsort((name[order], score[order], group[order]))]
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, dtype=np.int64)
    lengths = np.diff(np.r_[starts, len(g)])
    return order[np.arange(len(g)) - np.repeat(starts, lengths) < k]
