"""Nearest neighbours and hard negatives against comparisons of all rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockline.llm import hard_negatives, multiprobe, queries
from stockline.llm.vectors import best_rows

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def vectors(n: int, width: int, seed: int, groups: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    if groups:
        x = rng.normal(size=(groups, width))[rng.integers(0, groups, n)] + 0.15 * x
    return x.astype(np.float32)


def table(spark, x: np.ndarray, labels=None):
    labels = labels if labels is not None else [i % 10 for i in range(len(x))]
    return spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, labels))], SCHEMA)


def nearest(rows: dict[int, list[float]], query: int, k: int) -> list[tuple[int, float]]:
    far = lambda v: math.sqrt(sum((a - b) ** 2 for a, b in zip(v, rows[query])))
    return sorted(((i, far(v)) for i, v in rows.items() if i != query), key=lambda p: (p[1], p[0]))[:k]


def test_best_rows():
    chosen = best_rows(np.array([1, 1, 1, 2, 1, 2]), np.array([3.0, 1, 1, 5, 2, 5]), np.array([9, 7, 7, 4, 5, 3]), 2)
    assert chosen.tolist()[1:] == [4, 5, 3] and chosen[0] in (1, 2)
    assert len(best_rows(np.array([]), np.array([]), np.array([]), 3)) == 0


# ---- nearest neighbours ----


@pytest.mark.parametrize("groups", [0, 40])
def test_recall_against_all_rows(spark, groups):
    x = vectors(4000, 16, 1, groups)
    found = multiprobe.nearest(table(spark, x), F.col("vec_id") % 50 == 0, 10).collect()
    of_query = {q: sorted((r for r in found if r.query_id == q), key=lambda r: r.rank) for q in range(0, 4000, 50)}
    hits = 0
    for q, rows in of_query.items():
        distances = np.sqrt(np.square(x.astype(np.float64) - x[q].astype(np.float64)).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(len(x)), distances)) if i != q][:10]
        assert [r.rank for r in rows] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in rows] == sorted((distances[r.vec_id], r.vec_id) for r in rows)
        hits += len(set(want) & {r.vec_id for r in rows})
    assert hits >= 0.93 * 10 * len(of_query)


def test_clustered_rows_are_found_in_few_visits(spark):
    """Where neighbours are much nearer than other rows, few rows are looked at."""
    x = vectors(20_000, 16, 2, 400)
    rows = multiprobe.usable(table(spark, x), "vec_id", "embedding").cache()
    chosen = rows.filter("vec_id % 400 = 0").cache()
    fit = multiprobe.fitted(rows, chosen, 10, 20_000, 16)
    met = multiprobe.indexed(rows, fit, 16).join(multiprobe.visits(chosen, fit, 16), "bucket")
    tried = met.agg(F.sum(F.length("ids") / 8 * F.length("query_ids") / 8)).first()[0]
    assert tried < 0.25 * 20_000 * 50


def test_probes_come_in_order_of_their_chance_and_each_once():
    rng = np.random.default_rng(4)
    for _ in range(20):
        place, slot, radius = rng.normal(size=3), 1.3, 0.6
        own = np.floor(place / slot)

        def chance(slots):
            cdf = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
            parts = [cdf(((s + 1) * slot - p) / radius) - cdf((s * slot - p) / radius) for s, p in zip(slots, place)]
            return math.prod(parts)

        steps = range(-multiprobe.REACH, multiprobe.REACH + 1)
        every = sorted((chance(own + d) for d in np.stack(np.meshgrid(steps, steps, steps)).reshape(3, -1).T), reverse=True)
        visited = [chance(s) for s in multiprobe.probes(place, slot, radius, 0.9)]
        assert np.allclose(visited, every[: len(visited)]) and len(np.unique(visited)) == len(visited)
        assert sum(visited) >= 0.9 > sum(visited[:-1])


def test_odd_vectors_ties_repeats_and_few_rows(spark):
    rows = {0: [1.0, 0.0], 1: [0.0, 1.0], 2: [0.0, -1.0], 3: [2.0, 0.0], 4: [1.0, 0.0], 50: [3.0, 3.0]}
    odd = [(5, None), (6, []), (7, [0.0, 0.0]), (8, [NAN, 1.0]), (9, [INF, 1.0]), (10, [None, 1.0]), (11, [1.0]), (None, [1.0, 1.0])]
    listed = [*rows.items(), *odd, (3, [2.0, 0.0]), (100, None), (150, [0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, "x", "y", 1) for i, v in listed], "vec_id long, embedding array<float>, score string, rank string, bucket int")
    found = multiprobe.nearest(frame, F.col("vec_id") % 50 == 0, 10).collect()
    got = {q: [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] for q in (0, 50, 100, 150)}
    assert got == {0: nearest(rows, 0, 10), 50: nearest(rows, 50, 10), 100: [], 150: []}
    # Of a repeated id the nearest vector counts; of a repeated query the smallest vector.
    frame = spark.createDataFrame([(0, [5.0, 0.0]), (0, [1.0, 0.0]), (1, [9.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    found = multiprobe.nearest(frame, F.col("vec_id") == 0, 10).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in found] == [(0, 1, 1, 1.0)]


def test_copies_beyond_k_keep_the_smallest_ids(spark):
    x = np.tile(np.array([[0.6, 0.8]], dtype=np.float32), (3000, 1))
    found = multiprobe.nearest(table(spark, x), F.col("vec_id") == 2000, 10).collect()
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank)] == [(i, 0.0) for i in range(10)]


def test_a_query_far_from_all_buckets_is_compared_with_every_row(spark):
    x = vectors(3000, 8, 6, 30)
    x[100] = 1000.0
    found = multiprobe.nearest(table(spark, x), F.col("vec_id") % 100 == 0, 10)
    assert found.groupBy("query_id").count().filter("count = 10").count() == 30


def test_empty_tables(spark):
    for rows in ([], [(1, None, 2)], [(None, [1.0], 2)]):
        frame = spark.createDataFrame(rows, SCHEMA)
        assert multiprobe.nearest(frame, F.col("vec_id") % 100 == 0, 10).count() == 0
        assert mined(frame) == set()
    one = spark.createDataFrame([(0, [1.0, 2.0], 1)], SCHEMA)
    assert multiprobe.nearest(one, F.col("vec_id") % 100 == 0, 10).count() == 0 and mined(one) == set()


# ---- hard negatives ----


def mined(frame, every: int = 100, **options) -> set:
    vector = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    rows = hard_negatives.usable(frame, F.col("label"), vector)
    found = [tuple(r) for r in hard_negatives.mined(rows, F.col("vec_id") % every == 0, **options).collect()]
    assert len(found) == len(set(found))
    return set(found)


def mined_by_all(x: np.ndarray, labels: np.ndarray, every: int, positives: int = 5, negatives: int = 5) -> set:
    x = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    found = set()
    for i in range(0, len(x), every):
        scores = x @ x[i]
        order = [j for j in np.lexsort((np.arange(len(x)), -scores)) if j != i]
        for p in [j for j in order if labels[j] == labels[i]][:positives]:
            window = [j for j in order if labels[j] != labels[i] and 80 * scores[p] <= 100 * scores[j] <= 100 * scores[p]]
            found |= {(i, p, r, j, scores[p], scores[j]) for r, j in enumerate(window[:negatives], 1)}
    return found


@pytest.mark.parametrize(("width", "groups", "labels"), [(16, 0, 10), (5, 30, 3), (64, 8, 2)])
def test_mined_equals_all_rows(spark, width, groups, labels):
    x = vectors(1500, width, 8, groups)
    of = np.random.default_rng(9).integers(0, labels, len(x))
    assert mined(table(spark, x, of).repartition(5), every=25) == mined_by_all(x, of, 25)


def test_small_blocks_and_batches_change_nothing(spark, monkeypatch):
    x, of = vectors(600, 9, 10, 5), np.arange(600) % 4
    monkeypatch.setattr(hard_negatives, "ANCHOR_BATCH", 3)
    assert mined(table(spark, x, of).repartition(7), every=40) == mined_by_all(x, of, 40)


def test_scan_prunes_and_stays_exact():
    x = np.floor(256 * vectors(500, 24, 11, 20)).astype(np.int64)
    import pyarrow as pa

    block = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array([0] * 500), pa.array(x.tolist())], ["a", "b", "c"])
    held = hard_negatives.Columns(block, 24)
    looked = []

    def look(lower, upper):
        looked.append(len(upper))
        assert (lower <= upper).all()
        return upper >= np.partition(lower, -5)[-5]

    rows, scores = held.scan(x[0], np.arange(500), look)
    assert looked[-1] < 500 and (scores == x[rows] @ x[0]).all()
    assert set(np.argsort(-(x @ x[0]), kind="stable")[:5]) <= set(rows)


def test_ties_negative_scores_and_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0], 1), (1, [0.5, 0.0], 1), (2, [0.5, 9.0], 1), (3, [0.5, 1.0], 2), (4, [0.45, 1.0], 2), (5, [0.4, 1.0], 3),
        (6, [0.39, 1.0], 3), (7, None, 2), (8, [None, 1.0], 2), (9, [NAN, 1.0], 2), (10, [0.5, 0.0], None), (11, [0.5], 2),
        (12, [-INF, 0.5], 2), (None, [0.5, 0.0], 2), (3, [0.5, 1.0], 2), (13, [1e9, 1.0], 2),
        (100, [-1.0, 0.0], 4), (101, [0.5, 0.0], 4), (102, [0.6, 0.0], 5),  # its only positive has a score below 0
        (200, [0.0, 0.0], 6), (201, [1.0, 1.0], 6),  # scores of 0: every other row ties
        (300, [1.0, 1.0], 7),  # no positive
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", score string").withColumn("rank", F.lit(0))
    found = mined(frame)
    assert {(r[0], r[1], r[2], r[3]) for r in found if r[0] == 0} == {
        (0, p, i, n) for p in (1, 2) for i, n in enumerate((3, 101, 4), 1)
    }
    assert not [r for r in found if r[0] in (100, 300)]
    assert [r[3] for r in sorted(found, key=lambda r: r[2]) if r[0] == 200] == [0, 1, 2, 3, 4]
    assert mined(frame.limit(0)) == set()


def test_query_changes_labels_and_floors(spark, tmp_path):
    x = vectors(900, 12, 12, 25)
    labels = np.arange(900) % 10
    table(spark, x, labels).write.parquet(f"{tmp_path}/embeddings.parquet")
    changed = np.where(np.arange(900) % 7 == 0, (labels + 1) % 10, labels)
    found = {tuple(r) for r in queries.op13_hard_negatives(spark, str(tmp_path)).collect()}
    assert found == mined_by_all(x, changed, 100)
