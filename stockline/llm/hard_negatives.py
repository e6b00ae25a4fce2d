"""Hard negatives by a vertical scan of columnar vectors (branch and bound on decomposed data).

A row's score for an anchor is its inner product in whole numbers. An anchor's positives are its best rows of the same label;
for each positive, its hard negatives are the best rows of other labels whose scores lie in the window from LEAST per cent of the positive's
score to that score.

Tasks hold blocks of rows as columns. For an anchor the columns are read in descending order of the anchor's components, by
size. Whatever columns are left can add between the sums of their least and greatest contributions, known from the
least and greatest value of each column of the block; so after each step every row has a lower and an upper bound of its
score. The candidate bitmap keeps the rows whose bounds meet what is still looked for: at least the k-th best lower
bound for positives, any of the windows for negatives, where a window also shrinks to what its k-th best known row leaves.
Rows that survive all columns have exact scores. The scan is exact: it returns what a comparison of all rows would.

Two passes read the rows once per batch of ANCHOR_BATCH anchors, which are sent to all tasks (ANCHOR_BATCH vectors at most, whatever the
input): the first finds positives, the second negatives. No rows are shuffled; tasks hand over the best k per anchor or window.

Rows with a null id, label or vector, with a null or non-finite component, with a component of 2^24 or more in size (whose
products may not fit), or of another length than most take no part. Rows that repeat an id count once per label, by their best score, and
never for the anchor of that id; of anchor rows that repeat an id the one with the smallest (label, vector) counts. Ties
go to the smaller id. Anchors without positives, and positives without negatives, give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockline.llm.common import ship_package
from stockline.llm.vectors import best_rows, blocks, finite, in_batches, matrix, usual_size
from stockline.operators.scale import checkpointed

POSITIVES, NEGATIVES = 5, 5
LEAST = 80  # per cent of the positive's score
ANCHOR_BATCH = 4096
STEP = 8  # columns read between two looks at the bounds
LARGEST = 1 << 24


class Columns:
    """A block of rows as columns of whole numbers, with the least and greatest value of each."""

    def __init__(self, block: pa.RecordBatch, width: int) -> None:
        self.ids, self.labels = block.column(0).to_numpy(), block.column(1).to_numpy()
        self.values = np.ascontiguousarray(matrix(block.column(2), width, np.int64).T)
        self.low, self.high = self.values.min(axis=1), self.values.max(axis=1)

    def scan(self, anchor: np.ndarray, rows: np.ndarray, look: Callable) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of those of the given rows that look(lower, upper) keeps at every step."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        weights = anchor[order]
        ends = np.stack([weights * self.low[order], weights * self.high[order]])
        least, most = (np.r_[np.cumsum(part[::-1])[::-1], 0] for part in (ends.min(axis=0), ends.max(axis=0)))
        scores = np.zeros(len(rows), dtype=np.int64)
        all_rows = len(rows) == self.values.shape[1]
        for start in range(0, len(order), STEP):
            for i in range(start, min(start + STEP, len(order))):
                column = self.values[order[i]]
                scores += weights[i] * (column if all_rows else column[rows])
            done = min(start + STEP, len(order))
            kept = look(scores + least[done], scores + most[done])
            if not kept.all():
                rows, scores, all_rows = rows[kept], scores[kept], False
            if not len(rows):
                break
        return rows, scores


class Seen:
    """The k best rows of one anchor or window in a task, by score and then id; an id counts once."""

    def __init__(self, k: int) -> None:
        self.k, self.ids, self.scores = k, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(ids):
            ids, scores = np.r_[self.ids, ids], np.r_[self.scores, scores]
            chosen = best_rows(np.zeros(len(ids), dtype=np.int64), -scores, ids, self.k)
            self.ids, self.scores = ids[chosen], scores[chosen]

    def floor(self) -> int | None:
        """The score that a row must reach to count, once there are k."""
        return int(self.scores[-1]) if len(self.ids) == self.k else None


def _kth(lower: np.ndarray, ids: np.ndarray, k: int, unique: bool) -> int | None:
    """A score that k rows of different ids reach for sure."""
    return int(np.partition(lower, len(lower) - k)[len(lower) - k]) if unique and len(lower) >= k else None


def usable(rows: DataFrame, label: Column, vector: Column, name: str = "vec_id") -> DataFrame:
    """vec_id, label, vec of the rows that take part, of whatever length; vector: an array of doubles that are whole numbers."""
    plain = rows.select(F.col(name).cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.alias("vec"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vec"))
    small = F.forall("vec", lambda x: F.abs(x) < LARGEST)
    return plain.filter(sound & small).withColumn("vec", F.col("vec").cast("array<long>"))


def positives(anchors: list, rows: DataFrame, width: int, k: int = POSITIVES) -> DataFrame:
    """anchor_id, positive_id, score: the k best rows of the anchor's label in each task."""
    shared = rows.sparkSession.sparkContext.broadcast(_sent(anchors, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors = shared.value
        best = [Seen(k) for _ in ids]
        for block in blocks(batches):
            held = Columns(block, width)
            unique = len(np.unique(held.ids)) == len(held.ids)
            of_label = {x: np.flatnonzero(held.labels == x) for x in np.unique(held.labels)}
            for name, label, vector, seen in zip(ids, labels, vectors, best):
                found = of_label.get(label, np.empty(0, dtype=np.int64))
                found = found[held.ids[found] != name]

                def look(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
                    marks = [m for m in (seen.floor(), _kth(lower, held.ids, k, unique)) if m is not None]
                    return upper >= max(marks) if marks else np.ones(len(upper), dtype=bool)

                if len(found):
                    found, scores = held.scan(vector, found, look)
                    seen.add(held.ids[found], scores)
        yield _batch(
            anchor_id=np.repeat(ids, [len(s.ids) for s in best]), positive_id=_joined(s.ids for s in best),
            score=_joined(s.scores for s in best),
        )

    ship_package(rows.sparkSession)
    return rows.mapInArrow(run, "anchor_id long, positive_id long, score long")


def negatives(anchors: list, rows: DataFrame, width: int, k: int = NEGATIVES, least: int = LEAST) -> DataFrame:
    """anchor_id, positive_id, positive_score, negative_id, score: the k best rows of each window in each task.

    anchors: rows (vec_id, label, vec, positives), the last a list of (positive_id, score).
    """
    windows = [
        [(p["positive_id"], -(-least * p["score"] // 100), p["score"]) for p in row["positives"] if p["score"] >= 0]
        for row in anchors
    ]
    shared = rows.sparkSession.sparkContext.broadcast((*_sent(anchors, width), windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, windows = shared.value
        best = [[Seen(k) for _ in of_anchor] for of_anchor in windows]
        for block in blocks(batches):
            held = Columns(block, width)
            others = {x: np.flatnonzero(held.labels != x) for x in np.unique(labels)}
            for name, label, vector, of_anchor, seen in zip(ids, labels, vectors, windows, best):
                found = others[label]
                found = found[held.ids[found] != name]
                if not of_anchor or not len(found):
                    continue
                floors = [max(low, s.floor() if s.floor() is not None else low) for (_, low, _), s in zip(of_anchor, seen)]
                tops = [high for *_, high in of_anchor]

                def look(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
                    kept = np.zeros(len(upper), dtype=bool)
                    for low, high in zip(floors, tops):
                        kept |= (upper >= low) & (lower <= high)
                    return kept

                found, scores = held.scan(vector, found, look)
                for low, high, window in zip(floors, tops, seen):
                    inside = (scores >= low) & (scores <= high)
                    window.add(held.ids[found[inside]], scores[inside])
        flat = [(a, p, s) for a, of_anchor, seen in zip(ids, windows, best) for p, s in zip(of_anchor, seen)]
        sizes = [len(s.ids) for *_, s in flat]
        yield _batch(
            anchor_id=np.repeat(np.array([a for a, *_ in flat], dtype=np.int64), sizes),
            positive_id=np.repeat(np.array([p[0] for _, p, _ in flat], dtype=np.int64), sizes),
            positive_score=np.repeat(np.array([p[2] for _, p, _ in flat], dtype=np.int64), sizes),
            negative_id=_joined(s.ids for *_, s in flat), score=_joined(s.scores for *_, s in flat),
        )

    ship_package(rows.sparkSession)
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, score long"
    return rows.mapInArrow(run, schema)


def _sent(anchors: list, width: int) -> tuple:
    columns = (np.array([row[c] for row in anchors], dtype=np.int64) for c in ("vec_id", "label"))
    return (*columns, np.array([row["vec"] for row in anchors], dtype=np.int64).reshape(-1, width))


def _joined(parts: Iterator[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype=np.int64), *parts])


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns.values()], list(columns))


def _first(found: DataFrame, group: list[str], name: str, k: int) -> DataFrame:
    """The k best distinct rows of each group: score down, then `name` up; adds rank."""
    merged = found.groupBy(*group, name).agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), name))
    return merged.withColumn("rank", place).filter(F.col("rank") <= k)


def mined(
    rows: DataFrame, is_anchor: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, least: int = LEAST
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows: as from `usable`."""
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    n, width = usual_size(rows, "vec")
    if not n:
        return rows.sparkSession.createDataFrame([], out)
    rows = rows.filter(F.size("vec") == width)
    chosen = rows.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("one"))
    anchors = checkpointed(chosen.select("vec_id", "one.label", "one.vec"))
    parts = [positives(batch, rows, width, n_positives) for batch in in_batches(anchors, ANCHOR_BATCH)]
    if not parts:
        return rows.sparkSession.createDataFrame([], out)
    best = _first(reduce(DataFrame.union, parts), ["anchor_id"], "positive_id", n_positives)
    best = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(F.struct("positive_id", "score")).alias("positives")  # n_positives at most
    )
    armed = checkpointed(anchors.join(best, "vec_id"))
    parts = [negatives(batch, rows, width, n_negatives, least) for batch in in_batches(armed, ANCHOR_BATCH)]
    if not parts:
        return rows.sparkSession.createDataFrame([], out)
    found = _first(
        reduce(DataFrame.union, parts), ["anchor_id", "positive_id", "positive_score"], "negative_id", n_negatives
    )
    return found.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score")
    )
