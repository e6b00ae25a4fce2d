"""The retail tables as views over a star schema (part, supplier, customer, nation, region, orders, lineitem, events).

Every view reads its whole table. Money is in hundredths, so it is whole. Line 7 of an order stands for data from
before the cost columns existed: it has no cost or profit; some of those lines name a product that is gone or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockline.functions.scalars import padded
from stockline.operators.scale import lookup_join
from stockline.schemas import TABLES
from stockline.sources.tables import align_schema

# Fixed values of the mapping.
CATEGORY_OF_TYPE = {"ECONOMY": 1, "MEDIUM": 2, "SMALL": 3, "STANDARD": 4, "LARGE": 5}
PAYMENT_OF_PRIORITY = {"1-URGENT": "Tunai", "2-HIGH": "QRIS", "3-MEDIUM": "Transfer", "4-NOT SPECIFIED": "Debit"}
LOG_OF_EVENT = {"purchase": "sell", "view": "incoming", "click": "stock_opname", "signup": "create"}
ROLES = ["admin", "kasir", "gudang"]
LEGACY_LINE = 7
GONE_PRODUCTS_FROM = 100_000_000_000


def _mapped(x: Column, values: dict, otherwise) -> Column:
    out = F.lit(otherwise)
    for key, value in reversed(list(values.items())):
        out = F.when(x == key, value).otherwise(out)
    return out


def _text(x: Column) -> Column:
    return x.cast("string")


class StarTables:
    """Lazy retail views over the parquet files of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ---- dimensions ----

    def products(self) -> DataFrame:
        size, price = F.col("p_size"), F.col("p_retailprice")
        return self.raw("part").select(
            F.col("p_partkey").alias("id"),
            F.concat(F.lit("BRG-"), padded(F.col("p_partkey"), 6)).alias("code"),
            F.col("p_name").alias("name"),
            _mapped(F.col("p_type"), CATEGORY_OF_TYPE, None).cast("long").alias("category_id"),
            F.col("p_brand").alias("unit"),
            F.when(size != 49, F.round(price * 80).cast("long")).alias("purchase_price"),
            F.round(price * 100).cast("long").alias("sale_price"),
            F.when(size != 48, (size - 3).cast("long")).alias("stock"),
            F.date_add(F.lit("1995-01-01").cast("date"), size).alias("entry_date"),
            F.concat(F.lit("Rak "), F.col("p_brand")).alias("storage_location"),
            F.when(size != 50, F.col("p_partkey") % 10).alias("supplier_id"),
        )

    def categories(self) -> DataFrame:
        return self.raw("region").select(
            (F.col("r_regionkey") + 1).cast("long").alias("id"), F.col("r_name").alias("name"),
            F.concat(F.lit("Kategori "), F.col("r_name")).alias("description"),
        )

    def suppliers(self) -> DataFrame:
        key = _text(F.col("s_suppkey"))
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
            F.concat(F.lit("Jl. "), _text(F.col("s_nationkey"))).alias("address"),
            F.concat(F.lit("08"), padded(F.col("s_suppkey"), 8)).alias("phone"),
            F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("s"), key, F.lit("@example.com"))).alias("email"),
        )

    def customers(self) -> DataFrame:
        key = _text(F.col("c_custkey"))
        return self.raw("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
            F.concat(F.lit("08"), padded(F.col("c_custkey"), 8)).alias("phone"),
            F.concat(F.lit("c"), key, F.lit("@example.com")).alias("email"),
            F.col("c_mktsegment").alias("address"),
            F.floor("c_acctbal").cast("long").alias("points"),
        )

    def users(self) -> DataFrame:
        role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("n_nationkey") % 3 + 1)
        users = self.raw("nation").select(
            F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("username"), role.alias("role")
        )
        return align_schema(users, TABLES["users"])

    # ---- sales ----

    def _line_columns(self) -> list[Column]:
        packed = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000 + F.col("l_partkey") % 1000) * 1000
        legacy = F.col("l_linenumber") == LEGACY_LINE
        product = (
            F.when(legacy & (F.col("l_returnflag") == "N"), F.col("l_partkey") + GONE_PRODUCTS_FROM)
            .when(legacy & (F.col("l_returnflag") == "A"), None)
            .otherwise(F.col("l_partkey"))
        )
        price = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("long")
        quantity = F.col("l_quantity").cast("long")
        cost = F.when(~legacy, F.floor(price * 0.8).cast("long"))
        return [
            (packed + F.col("l_suppkey") % 1000).alias("id"),
            F.col("l_orderkey").alias("receipt_id"),
            product.alias("product_id"),
            quantity.alias("quantity"),
            price.alias("price"),
            (price * quantity).alias("total_price"),
            cost.alias("purchase_price"),
            price.alias("sale_price"),
            (price - cost).alias("profit_per_unit"),
        ]

    def _order_columns(self) -> list[Column]:
        return [
            F.col("o_orderkey").alias("receipt_id"),
            F.col("o_orderdate").cast("date").alias("date"),
            F.concat(F.lit("Kasir "), _text(F.col("o_custkey") % 5)).alias("cashier_name"),
            _mapped(F.col("o_orderpriority"), PAYMENT_OF_PRIORITY, "Kredit").alias("payment_method"),
        ]

    def sales_receipt_items(self) -> DataFrame:
        items = self.raw("lineitem").select(*self._line_columns())
        return align_schema(items, TABLES["sales_receipt_items"])

    def sales_receipts(self) -> DataFrame:
        """One header per order with lines; lines are summed before they meet their order."""
        sums = self.sales_receipt_items().groupBy("receipt_id").agg(
            F.sum("total_price").alias("subtotal"), F.sum("quantity").alias("total_items")
        )
        orders = self.raw("orders").select(*self._order_columns())
        return orders.join(sums, "receipt_id").withColumnRenamed("receipt_id", "id")

    def sales_transactions(self) -> DataFrame:
        orders = self.raw("orders").select(*self._order_columns())
        lines = self.raw("lineitem").select(*self._line_columns())
        sales = lookup_join(lines, orders, ["receipt_id"], "inner")
        return align_schema(sales.drop("receipt_id"), TABLES["sales_transactions"])

    # ---- goods, logs ----

    def incoming_goods(self) -> DataFrame:
        packed = self._line_columns()
        return self.raw("lineitem").select(
            packed[0], F.col("l_shipdate").cast("date").alias("date_in"), packed[2], packed[3],
            F.col("l_suppkey").alias("supplier_id"),
            F.concat(F.lit("Staf "), _text(F.col("l_suppkey") % 3)).alias("staff_name"),
        )

    def outgoing_goods(self) -> DataFrame:
        packed = self._line_columns()
        return self.raw("lineitem").select(
            packed[0], F.col("l_shipdate").cast("date").alias("date_out"), packed[2], packed[3],
            F.col("l_linestatus").alias("destination"), F.lit(None).cast("string").alias("staff_name"),
        )

    def inventory_logs(self) -> DataFrame:
        return self.as_logs(self.raw("events"))

    @staticmethod
    def as_logs(events: DataFrame) -> DataFrame:
        kind, value = F.col("event_type"), F.floor("value").cast("long")
        return events.select(
            F.col("event_id").alias("id"),
            _mapped(kind, LOG_OF_EVENT, "delete").alias("type"),
            F.when(kind != "signup", F.col("user_id")).alias("product_id"),
            F.when(kind == "error", F.lit(0).cast("long")).when(kind == "click", value - 20).otherwise(value).alias("quantity"),
            F.col("props").alias("note"),
            F.col("ts").alias("created_at"),
        )

    # ---- request batches ----

    def carts(self) -> DataFrame:
        """Every order is a cart; those without lines are empty."""
        orders = self.raw("orders").select(*self._order_columns())
        return orders.select(F.col("receipt_id").alias("cart_id"), "payment_method", "cashier_name")

    def cart_lines(self) -> DataFrame:
        """Quantity as raw text, not always a number."""
        columns = self._line_columns()
        whole = _text(F.col("l_quantity").cast("long"))
        text = (
            F.when((F.col("l_linenumber") == LEGACY_LINE) & (F.col("l_returnflag") == "R"), F.concat(whole, F.lit("d")))
            .when(F.col("l_linenumber") == 6, F.concat(F.lit("  "), whole, F.lit(".0 ")))
            .when(F.col("l_linenumber") == 5, F.concat(whole, F.lit("e0")))
            .otherwise(whole)
        )
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("cart_id"), columns[0].alias("line"), columns[2], text.alias("quantity"),
        )

    def sell_requests(self) -> DataFrame:
        lines = self.cart_lines().withColumnRenamed("line", "seq").drop("cart_id")
        nothing = F.lit(None).cast("string")
        return lines.select("*", nothing.alias("payment_method"), nothing.alias("cashier_name"))

    def incoming_requests(self) -> DataFrame:
        columns = self._line_columns()
        supplier = _text(F.col("l_suppkey"))
        return self.raw("lineitem").select(
            columns[0].alias("seq"), columns[2],
            F.when(F.col("l_linenumber") == LEGACY_LINE, F.lit("x")).otherwise(_text(F.col("l_quantity"))).alias("quantity"),
            F.col("l_suppkey").alias("supplier_id"),
            F.when(F.col("l_returnflag") == "A", F.concat(F.lit(" Staf "), supplier)).alias("staffName"),
            F.when(F.col("l_returnflag") == "R", F.lit("   ")).alias("staff_name"),
            F.lit(None).cast("string").alias("cashierName"),
            F.concat(F.lit("Kasir "), supplier).alias("cashier_name"),
        )

    def count_sessions(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("counted_at"),
            F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("Staf "), _text(F.col("o_custkey") % 3))).alias("staff_name"),
            F.lit(" ").alias("note"),
        )

    def count_lines(self) -> DataFrame:
        columns = self._line_columns()
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("session_id"), columns[0].alias("line"), columns[2],
            F.when(F.col("l_linenumber") == 6, F.lit("abc")).otherwise(_text(F.col("l_quantity"))).alias("counted_stock"),
            F.concat(F.lit(" "), F.col("l_returnflag")).alias("note"),
        )

    def inventory_count_sessions(self) -> DataFrame:
        return self.count_sessions().withColumnRenamed("session_id", "id")

    def product_changes(self) -> DataFrame:
        """Every sale line as an edit of its product: price and name change, the fields not sent are emptied.

        Line 6 sends a price with a fraction."""
        columns = self._line_columns()
        return self.raw("lineitem").select(
            columns[2].alias("id"), columns[0].alias("seq"),
            F.concat(F.lit(" Baru "), _text(F.col("l_linenumber"))).alias("name"),
            F.concat(_text(columns[4]), F.when(F.col("l_linenumber") == 6, ".25").otherwise("")).alias("sale_price"),
            _text(F.col("l_quantity")).alias("stock"),
            F.col("l_suppkey").alias("supplier_id"),
        )

    def new_products(self) -> DataFrame:
        """Every part offered twice as a new product: some without category, with a fractional price or a code that exists."""
        part = self.raw("part")
        fields = part.select(
            F.col("p_partkey").alias("seq"), "p_name", "p_brand", "p_size", "p_type", "p_retailprice",
            F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"),
        )
        code = F.when(F.col("p_size") < 10, F.lit("BRG-")).otherwise(F.lit("NEW-"))
        key = F.when(F.col("p_brand") == "Brand#1", F.lit(" ")).otherwise(F.lit(""))
        return fields.select(
            (F.col("seq") * 2 + F.col("copy")).alias("seq"),
            F.concat(F.lit(" "), code, padded(F.col("seq"), 6)).alias("code"),
            F.when(key == " ", key).otherwise(F.col("p_name")).alias("name"),
            _mapped(F.col("p_type"), CATEGORY_OF_TYPE, None).cast("long").alias("category_id"),
            F.col("p_brand").alias("unit"),
            F.concat(_text(F.floor("p_retailprice").cast("long")), F.when(F.col("p_size") == 7, ".5").otherwise("")).alias(
                "purchase_price"
            ),
            F.concat(_text(F.floor("p_retailprice").cast("long")), F.lit("00")).alias("sale_price"),
            F.when(F.col("copy") == 0, _text(F.col("p_size"))).alias("stock"),
            F.lit(None).cast("date").alias("entry_date"),
            F.lit(" Rak ").alias("storage_location"),
            F.lit(0).cast("long").alias("supplier_id"),
        )
