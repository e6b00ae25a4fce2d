"""Joins and running totals that hold when one key carries a large share of the rows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockline.session import shared_folder

# A lookup side of at most this many rows and bytes is broadcast; a larger one never is.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# A key with more rows than this is heavy: no task takes more rows of one key at once.
HEAVY_ROWS = 100_000
# Slots in which the rows of keys are counted to find out which may be heavy: 65,536 longs a task, whatever the keys.
COUNTERS = 1 << 16


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there; survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table to the shared folder and go on from there, as checkpointed does.

    For large frames: compressed columns take a small part of a checkpoint's space, and a reader reads the columns that it needs. A
    returned frame may be read from the table, so it stays until the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcastable(df: DataFrame, rows: int | None = None) -> bool:
    """Whether df is small enough to broadcast, in rows and in bytes; of a larger one no task reads more rows than that."""
    limit = BROADCAST_ROWS if rows is None else rows
    if limit <= 0:
        return False
    width = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(8)) for c in df.columns])
    count, size = df.limit(limit + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return count <= limit and (size or 0) <= BROADCAST_BYTES


def heavy_keys(df: DataFrame, on: list[str], heavy_rows: int | None = None) -> DataFrame | None:
    """The key values with more than heavy_rows rows; None when there are none.

    Rows are counted in COUNTERS slots by a hash of their key, which every task sums before the shuffle. A slot has all rows of
    its keys, so a heavy key lies in a slot that is as full; only the rows of such slots, mostly none, are counted by key.
    """
    limit = HEAVY_ROWS if heavy_rows is None else heavy_rows
    keys = df.select(*on, F.pmod(F.xxhash64(*on), F.lit(COUNTERS)).alias("_slot"))
    rows, over = F.count(F.lit(1)).alias("_rows"), F.col("_rows") > limit
    full = checkpointed(keys.groupBy("_slot").agg(rows).filter(over).select("_slot"))
    if full.isEmpty():
        return None
    suspects = keys.join(F.broadcast(full), "_slot", "left_semi")  # at most COUNTERS slots
    heavy = checkpointed(suspects.groupBy(*on).agg(rows).filter(over).select(*on))
    return None if heavy.isEmpty() else heavy


def _null_safe(left: DataFrame, right: DataFrame, on: list[str], right_names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[r]) for k, r in zip(on, right_names)])


def split_heavy(df: DataFrame, on: list[str], heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a heavy key, all other rows); NULL is a key value like any other."""
    names = [f"_heavy_{i}" for i in range(len(on))]
    marks = heavy.toDF(*names)
    if broadcastable(marks):
        marks = F.broadcast(marks)
    match = _null_safe(df, marks, on, names)
    return df.join(marks, match, "left_semi"), df.join(marks, match, "left_anti")


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "left",
    broadcast_rows: int | None = None,
    heavy_rows: int | None = None,
) -> DataFrame:
    """facts joined to dim, whose key `on` is unique; how: left, inner, left_semi or left_anti.

    A small dim is broadcast. A larger one is joined by shuffle, where adaptive execution splits the partitions of
    frequent keys; the plan is one join and starts no job. With heavy_rows, for sessions without adaptive execution,
    keys with more rows than that are looked up first, and their rows are joined to their few dim rows by broadcast.
    """
    if broadcastable(dim, broadcast_rows):
        return facts.join(F.broadcast(dim), on, how)
    heavy = None if heavy_rows is None else heavy_keys(facts, on, heavy_rows)
    if heavy is None:
        return facts.join(dim, on, how)
    hot, rest = split_heavy(facts, on, heavy)
    hot_dim = dim.join(heavy, on, "left_semi")
    if broadcastable(hot_dim):
        hot_dim = F.broadcast(hot_dim)
    return hot.join(hot_dim, on, how).unionByName(rest.join(dim, on, how))


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    totals: dict[str, Column],
    heavy_rows: int | None = None,
    slices: int | None = None,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Add running sums, up to and with each row, inside each group of `keys` (the whole frame if empty).

    `order` must be a total order of a group. Groups that fit one task use a plain window. Heavy groups are
    range-partitioned by (keys, order), summed per slice, and every slice starts from the sum of those before it.
    `sized_by` is a frame with the rows of df that costs less to read, with some of the keys: groups by fewer keys are
    larger, so when none of those is heavy, none is here.
    """
    measured = df.select("*", *[value.alias(f"_add_{name}") for name, value in totals.items()])
    if keys:
        if sized_by is not None and heavy_keys(sized_by, sized_by.columns, heavy_rows) is None:
            # Spread by the fewer keys: a later grouping by them then needs no shuffle of its own.
            return _windowed(measured.repartition(*sized_by.columns), keys, order, totals)
        heavy = heavy_keys(df, keys, heavy_rows)
        if heavy is None:
            return _windowed(measured, keys, order, totals)
        hot, rest = split_heavy(measured, keys, heavy)
        cold = _windowed(rest, keys, order, totals)
        return cold.unionByName(_sliced(hot, keys, order, totals, slices))
    measured = checkpointed(measured)  # counted, then read
    if measured.count() <= (HEAVY_ROWS if heavy_rows is None else heavy_rows):
        return _windowed(measured, keys, order, totals)
    return _sliced(measured, keys, order, totals, slices)


def _windowed(df: DataFrame, keys: list[str], order: list[Column], totals: dict[str, Column]) -> DataFrame:
    up_to_here = (
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    sums = [F.sum(f"_add_{name}").over(up_to_here).alias(name) for name in totals]
    return df.select("*", *sums).drop(*[f"_add_{name}" for name in totals])


def _sliced(
    df: DataFrame, keys: list[str], order: list[Column], totals: dict[str, Column], slices: int | None
) -> DataFrame:
    by = [F.col(k) for k in keys] + order
    ranged = df.repartitionByRange(slices, *by) if slices else df.repartitionByRange(*by)
    # Both reads below must see the same slice borders, hence the checkpoint.
    ranged = checkpointed(ranged.withColumn("_slice", F.spark_partition_id()))

    names = [f"_key_{i}" for i in range(len(keys))]
    per_slice = ranged.groupBy(*keys, "_slice").agg(*[F.sum(f"_add_{n}").alias(f"_sum_{n}") for n in totals])
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_slice.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)],
        F.col("_slice").alias("_start_slice"),
        F.row_number().over(Window.partitionBy(*keys).orderBy("_slice")).alias("_nth"),
        *[F.sum(f"_sum_{n}").over(earlier).alias(f"_start_{n}") for n in totals],
    )
    # A group is contiguous in the range order, so each slice continues at most one group: at most one row per slice.
    starts = F.broadcast(starts.filter("_nth > 1").drop("_nth"))

    match = ranged["_slice"] == starts["_start_slice"]
    if keys:
        match = match & _null_safe(ranged, starts, keys, names)
    joined = ranged.join(starts, match, "left")
    in_slice = (
        Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    sums = [
        (F.coalesce(f"_start_{n}", F.lit(0)) + F.sum(f"_add_{n}").over(in_slice)).alias(n) for n in totals
    ]
    helpers = ["_slice", "_start_slice", *names, *[f"_add_{n}" for n in totals], *[f"_start_{n}" for n in totals]]
    return joined.select("*", *sums).drop(*helpers)
