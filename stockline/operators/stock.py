"""Stock lists: incoming goods, count sessions, logs, stock movements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.functions import scalars as S
from stockline.operators.scale import lookup_join


def list_incoming(incoming: DataFrame, products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Received goods with product and supplier names; sort with list_desc."""
    product_names = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    supplier_names = suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    joined = lookup_join(incoming, product_names, ["product_id"])
    joined = lookup_join(joined, supplier_names, ["supplier_id"])
    return joined.select(*incoming.columns, "product_name", "supplier_name")


def incoming_display(listed: DataFrame) -> DataFrame:
    return listed.select(
        "id", "date_in", "quantity",
        S.or_dash(F.col("product_name"), "—").alias("product"),
        S.or_dash(F.col("supplier_name"), "—").alias("supplier"),
        S.or_dash(F.col("staff_name"), "—").alias("staff"),
    )


def count_session_log(sessions: DataFrame, count_items: DataFrame, n: int | None = 20) -> DataFrame:
    """Newest count sessions with their number of items; 0 for a session without any."""
    if n is not None:
        sessions = sessions.orderBy(F.desc("id")).limit(n)  # before the join: ids are unique
        wanted = F.broadcast(sessions.select(F.col("id").alias("session_id")))  # n rows
        count_items = count_items.join(wanted, "session_id", "left_semi")
    sizes = count_items.groupBy(F.col("session_id").alias("id")).agg(F.count("id").alias("item_count"))
    joined = sessions.join(sizes, "id", "left")
    return joined.select(
        "id", "counted_at", "staff_name", "note", F.coalesce("item_count", F.lit(0)).alias("item_count")
    ).orderBy(F.desc("id"))


def recent_logs(logs: DataFrame, n: int = 8) -> DataFrame:
    """Newest log rows; rows of the same second by id."""
    return logs.orderBy(F.desc("created_at"), F.desc("id")).limit(n).select(
        "id", "type", F.col("product_id").alias("productId"), "quantity", "note", "created_at"
    )


def log_display(logs: DataFrame) -> DataFrame:
    no_product = F.when(F.col("product_id") != 0, F.col("product_id"))
    return logs.select(
        "id", "created_at", S.log_label(F.col("type")).alias("label"),
        S.or_dash(no_product, "—").alias("product"),
        S.or_dash(F.col("quantity"), "—").alias("quantity"),
    )


def count_sheet(catalog: DataFrame) -> DataFrame:
    """Draft of a stock count: counted starts as the system stock."""
    stock = S.coalesce_zero(F.col("stock"))
    return catalog.select(
        F.col("id").alias("productId"), F.col("name").alias("productName"), "code", "category_name", "supplier_name",
        stock.alias("systemStock"), stock.alias("countedStock"), F.lit(0).cast("long").alias("difference"),
    )


def count_differences(count_items: DataFrame) -> DataFrame:
    difference = F.col("difference")
    return count_items.select(
        "*", S.count_sign(difference).alias("sign"), S.signed_text(difference).alias("difference_text")
    )


def movement_deltas(movements: DataFrame) -> DataFrame:
    """Net signed quantity per product."""
    return movements.groupBy("product_id").agg(F.sum("quantity").alias("delta"))


def apply_movements(products: DataFrame, movements: DataFrame) -> DataFrame:
    """stock + the sum of signed movements (product_id, quantity); unknown stock stays unknown."""
    deltas = movement_deltas(movements).select(F.col("product_id").alias("id"), "delta")
    moved = products.join(deltas, "id", "left")
    stock = F.col("stock") + S.coalesce_zero(F.col("delta"))
    return moved.select(*[stock.alias(c) if c == "stock" else F.col(c) for c in products.columns])


def oversold(products: DataFrame) -> DataFrame:
    """Products whose stock went below zero, for review after a batch of carts."""
    return products.filter("stock < 0")
