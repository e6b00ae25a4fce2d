"""Reading tables with fixed schemas, widening old ones, defaults, seeding and id-giving appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockline.operators.scale import running_totals
from stockline.schemas import TABLES


def scan(spark: SparkSession, path: str, table: str, fmt: str = "parquet") -> DataFrame:
    """Full scan of one table with its declared schema; filters and columns used later reach the reader."""
    return spark.read.format(fmt).schema(TABLES[table]).load(path)


# The day column a table is laid out by on disk.
DAY_COLUMN = {
    "sales_transactions": "date", "sales_receipts": "date", "incoming_goods": "date_in", "outgoing_goods": "date_out",
}


def write_table(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """Write rows of a table in a folder per day, so a filter on the day reads only its folders.

    Rows are rebalanced by day first: small days share files, a day with very many rows is split over several tasks.
    """
    day = DAY_COLUMN.get(table)
    if day is None:
        df.write.mode(mode).parquet(path)
    else:
        df.hint("rebalance", day).write.mode(mode).partitionBy(day).parquet(path)


def align_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the columns an older table lacks as typed NULLs; keep every column it has."""
    present = set(df.columns)
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in present]
    return df.select("*", *missing)


# Columns that a table fills in when a batch does not carry them.
DEFAULTS: dict[str, list[str]] = {
    "customers": ["points"],
    "inventory_logs": ["created_at"],
    "inventory_count_items": ["created_at"],
}


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int = 64) -> DataFrame:
    """df as the table `name` below path, laid out and sorted by a hash of key; joins of tables with equal buckets need no shuffle.

    A bucket is one file, so buckets should grow with the table, to files of some 100 MB. Replaces the table if it is there.
    """
    spread = df.repartition(buckets, key)  # one task a bucket, as the writer hashes
    writer = spread.write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite")
    writer.format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def apply_defaults(batch: DataFrame, table: str, now: Column | None = None) -> DataFrame:
    """points = 0, created_at = now (UTC, whole seconds), only where the batch has no such column at all."""
    utc_now = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())
    stamp = F.date_trunc("second", utc_now if now is None else now).cast("timestamp_ntz")
    values = {"points": F.lit(0).cast("long"), "created_at": stamp}
    absent = [c for c in DEFAULTS.get(table, []) if c not in batch.columns]
    return batch.select("*", *[values[c].alias(c) for c in absent])


def append_rows(
    target: DataFrame,
    batch: DataFrame,
    order: list[Column],
    last_id: int | None = None,
    heavy_rows: int | None = None,
    slices: int | None = None,
) -> DataFrame:
    """The batch with new ids after the largest one of the target, in the given total order.

    Pass last_id, the largest id ever given, where rows may have been deleted: ids are never used again.
    """
    last = target.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if last_id is None else last_id
    numbered = running_totals(
        batch.drop("id"), [], order, {"id": F.lit(1).cast("long")}, heavy_rows=heavy_rows, slices=slices
    )
    numbered = numbered.withColumn("id", F.col("id") + F.lit(last))
    return numbered.select("id", *[c for c in numbered.columns if c != "id"])


def seed_if_empty(target: DataFrame, rows: list[tuple], table: str) -> DataFrame:
    """The target as it is, or the sample rows (without id, in column order) when it has none."""
    if not target.isEmpty():
        return target
    schema = TABLES[table]
    numbered = [(i, *row, *[None] * (len(schema) - 1 - len(row))) for i, row in enumerate(rows, start=1)]
    return target.sparkSession.createDataFrame(numbered, schema)
