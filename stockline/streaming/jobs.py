"""Streaming jobs: live daily sales, live stock, and sales decided against live stock.

Each starts with a trigger of the caller's choice, as keyword arguments of DataStreamWriter.trigger; by default a job takes all that
is there and ends, with {"processingTime": "10 seconds"} or so it keeps running. State is Spark's own, in the state store
below folder/progress; a job started again on its folder goes on where it ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stockline.functions import scalars as S
from stockline.operators.baskets import sell_decisions
from stockline.operators.stock import apply_movements
from stockline.streaming.sell_state import DECISIONS, each_once
from stockline.streaming.snapshot import Snapshot

AVAILABLE_NOW = {"availableNow": True}
_DAYS = "day date, total_gross long, total_capital long, total_net long"
_NET = "product_id long, quantity long"
_SHELF = "id long, stock long, sale_price long"
#: What sell_decisions names of a product besides, which no decision holds.
_NOT_ON_SHELF = {"code": "string", "name": "string", "unit": "string", "purchase_price": "long"}
#: Known requests are kept on the executors' disks, not in their memory. State that expires by the clock would have a micro-batch
#: follow the other, rows or not; it may as well expire in the next one that has rows.
_KEYED_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def event_time(stamp: Column) -> Column:
    """A UTC wall-clock time as an instant: a watermark needs one, whatever the session zone is."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), stamp).cast("timestamp")


def _utc_day(instant: Column) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz")).cast("date")


# ---- daily sales ----


def sales_trend_stream(sales: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Sales, cost and profit per day of a stream of sale lines with a UTC column ts; later rows are dropped."""
    timed = sales.withColumn("event_time", event_time(F.col("ts"))).withWatermark("event_time", lateness)
    by_day = timed.groupBy(F.window("event_time", "1 day")).agg(
        F.sum("total_price").alias("total_gross"),
        F.sum(S.coalesce_zero(F.col("purchase_price")) * F.col("quantity")).alias("total_capital"),
        F.sum(S.coalesce_zero(F.col("profit_per_unit")) * F.col("quantity")).alias("total_net"),
    )
    return by_day.select(_utc_day(F.col("window.start")).alias("day"), "total_gross", "total_capital", "total_net")


def _days(spark: SparkSession, folder: str) -> Snapshot:
    return Snapshot(spark, f"{folder}/days", "day", _DAYS)


def start_sales_trend(
    sales: DataFrame, folder: str, lateness: str = "1 day", trigger: dict = AVAILABLE_NOW
) -> StreamingQuery:
    """Keep the state of every day below folder/days; read it with live_sales_trend."""
    days = _days(sales.sparkSession, folder)
    return (
        sales_trend_stream(sales, lateness)
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(**trigger)
        .foreachBatch(lambda changed, batch_id: days.write(batch_id, changed))
        .start()
    )


def live_sales_trend(spark: SparkSession, folder: str) -> DataFrame:
    """The last state of every day."""
    return _days(spark, folder).rows()


# ---- stock ----


def net_movements_stream(movements: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Net quantity per product of a stream of movements (event_id, ts, product_id, quantity), each event once.

    Events later than the watermark are dropped, since it is not known any more whether they are repeats.
    """
    once = (
        movements.withColumn("event_time", event_time(F.col("ts")))
        .withWatermark("event_time", lateness)
        .dropDuplicatesWithinWatermark(["event_id"])
    )
    return once.groupBy("product_id").agg(F.sum("quantity").alias("quantity"))


def _net(spark: SparkSession, folder: str) -> Snapshot:
    return Snapshot(spark, f"{folder}/net", "product_id", _NET)


def start_movements(
    movements: DataFrame, folder: str, lateness: str = "1 day", trigger: dict = AVAILABLE_NOW
) -> StreamingQuery:
    """Keep the net movement of every product below folder/net; read the stock with live_stock."""
    net = _net(movements.sparkSession, folder)
    return (
        net_movements_stream(movements.filter("product_id IS NOT NULL"), lateness)
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(**trigger)
        .foreachBatch(lambda changed, batch_id: net.write(batch_id, changed))
        .start()
    )


def live_stock(products: DataFrame, folder: str) -> DataFrame:
    return apply_movements(products, _net(products.sparkSession, folder).rows())


# ---- sales against live stock ----


def sell_stream(requests: DataFrame, remember: int = 7 * 24 * 3600) -> DataFrame:
    """A stream of sale requests (seq, product_id, quantity, ...), each once, ready to be decided.

    A seq that comes again for a product within `remember` seconds is a repeated delivery; requests without seq are never taken for repeats.
    """
    # Requests without a product are spread over keys that are no product's.
    spread = -1 - F.pmod(F.xxhash64("seq", "quantity"), F.lit(1 << 16))
    asked = requests.select(
        F.coalesce(F.col("product_id").cast("long"), spread).alias("key"), F.col("seq").cast("long").alias("seq"),
        F.col("product_id").cast("long").alias("product_id"), "quantity",
        S.whole_number(F.col("quantity")).cast("long").alias("_whole"),
    )
    return each_once(asked, remember)


def _shelf(spark: SparkSession, folder: str) -> Snapshot:
    return Snapshot(spark, f"{folder}/shelf", "id", _SHELF)


def _opening(products: DataFrame) -> DataFrame:
    shelf = F.struct(
        S.coalesce_zero(F.col("stock")).cast("long").alias("stock"),
        S.coalesce_zero(F.col("sale_price")).cast("long").alias("sale_price"),
    )
    known = products.filter("id IS NOT NULL").groupBy(F.col("id").cast("long").alias("id")).agg(F.min(shelf).alias("_shelf"))
    return known.select("id", "_shelf.*")


def _decide(spark: SparkSession, folder: str, asked: DataFrame, batch_id: int) -> None:
    """Decide a micro-batch by the stock that is left, in seq order, and write the decisions, then the stock that they leave.

    Both are versions of this batch, worked out from the versions before it: a batch that runs again overwrites its own.
    """
    asked.write.mode("overwrite").parquet(f"{folder}/asked")  # the state of the stream is worked out once
    requests, shelf = spark.read.schema(asked.schema).parquet(f"{folder}/asked"), _shelf(spark, folder)
    left = shelf.rows(before=batch_id)
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in _NOT_ON_SHELF.items()]
    decided = sell_decisions(left.select("*", *nothing), requests.select("seq", "product_id", "quantity"))
    names = [field.split()[0] for field in DECISIONS.split(", ")]
    path = f"{folder}/decisions/{batch_id}"
    decided.select(*names).write.mode("overwrite").parquet(path)
    taken = spark.read.schema(DECISIONS).parquet(path).filter("reason IS NULL").groupBy(F.col("product_id").alias("id"))
    changed = left.join(taken.agg(F.sum("quantity").alias("_taken")), "id")
    shelf.write(batch_id, changed.select("id", (F.col("stock") - F.col("_taken")).alias("stock"), "sale_price"))


def start_sell(
    requests: DataFrame, products: DataFrame, folder: str, remember: int = 7 * 24 * 3600, trigger: dict = AVAILABLE_NOW
) -> StreamingQuery:
    """Write the decisions on a stream of sale requests below folder/decisions; read them with sell_results.

    The stock that is left starts from the products when the job is first started; no micro-batch reads products. It is a table by
    product, as are a micro-batch's requests, so a micro-batch is the batch job (sell_decisions) on what the ones before it left:
    requests of a micro-batch count in seq order, those without seq first, micro-batches in theirs.
    """
    spark = requests.sparkSession
    shelf = _shelf(spark, folder)
    if not shelf.versions():
        shelf.write(-1, _opening(products))
    before = {name: spark.conf.get(name, None) for name in _KEYED_STATE}
    try:
        for name, value in _KEYED_STATE.items():
            spark.conf.set(name, value)  # a query keeps the settings that it starts with
        return (
            sell_stream(requests, remember)
            .writeStream.outputMode("append")
            .option("checkpointLocation", f"{folder}/progress")
            .trigger(**trigger)
            .foreachBatch(lambda asked, batch_id: _decide(spark, folder, asked, batch_id))
            .start()
        )
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def sell_results(spark: SparkSession, folder: str) -> DataFrame:
    """The decisions of all micro-batches."""
    return spark.read.schema(DECISIONS).option("recursiveFileLookup", True).parquet(f"{folder}/decisions")
