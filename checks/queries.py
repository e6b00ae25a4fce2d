"""Registered queries: a name for each operator, run over whole tables of one folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from stockline.functions import dates as D
from stockline.functions import scalars as S
from stockline.operators import baskets, catalog, maintenance, sales, stock
from stockline.plans import dashboard, period_report
from stockline.session import shared_folder
from stockline.sources import samples
from stockline.sources.sinks import period_report_export, receipt_export
from stockline.sources.star import StarTables
from stockline.sources.tables import append_rows, scan, write_bucketed, write_table
from stockline.sources.tables import apply_defaults as apply_defaults_of
from stockline.sources.tables import seed_if_empty as seed
from stockline.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}

CHECKOUT_DAY = "2001-08-01"
YEAR = ("1998-01-01", "1998-12-31")


def _query(build: Callable[[StarTables], DataFrame]) -> Callable[[StarTables], DataFrame]:
    _REGISTRY[build.__name__] = lambda spark, folder: build(StarTables(spark, folder))
    return build


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _catalog(t: StarTables) -> DataFrame:
    return catalog.with_category_and_supplier(t.products(), t.categories(), t.suppliers())


# ---- catalogue ----


@_query
def catalog_view(t):
    return catalog.catalog_view(t.products(), t.categories(), t.suppliers())


@_query
def search_products(t):
    return catalog.search_products(t.products(), " ANVIL ").select("id", "code", "name")


@_query
def filter_catalog(t):
    return catalog.filter_catalog(t.products(), 3, 4).select("id", "code", "name", "category_id", "supplier_id")


def _scans(t):
    lines = t.cart_lines()
    code = F.concat(F.lit(" brg-"), S.padded(F.col("product_id"), 6))
    code = F.when(F.col("quantity") == "13", F.lit("  ")).otherwise(code)  # some scans are blank
    return lines.select(F.col("line").alias("scan"), code.alias("code"))


@_query
def lookup_code(t):
    return catalog.lookup_code(t.products(), _scans(t))


@_query
def missed_codes(t):
    return catalog.missed_codes(t.products(), _scans(t))


@_query
def low_stock(t):
    return catalog.low_stock(_catalog(t)).withColumn("shown", S.low_stock_label(F.col("name"), F.col("stock")))


@_query
def stock_tier(t):
    return catalog.stock_levels(t.products()).select("id", "stock", "tier", "badge")


@_query
def stock_board(t):
    return catalog.stock_board(_catalog(t))


@_query
def price_list(t):
    return catalog.price_list(t.products())


@_query
def preferred_supplier(t):
    return catalog.preferred_supplier(t.products(), t.suppliers())


@_query
def product_margin(t):
    return catalog.product_margin(t.products())


@_query
def product_options(t):
    return catalog.product_options(t.products())


@_query
def list_desc(t):
    return catalog.list_desc(t.customers())


@_query
def duplicate_keys(t):
    return catalog.duplicate_keys(t.products(), "name")


# ---- figures and trends ----


@_query
def entity_counts(t):
    return sales.entity_counts(t.products(), t.users(), t.customers())


@_query
def daily_kpis(t):
    lines = t.sales_transactions()
    return sales.daily_kpis(lines, sales.latest_day(lines))


@_query
def daily_kpis_receipts(t):
    receipts = t.sales_receipts()
    return sales.daily_kpis_receipts(receipts, t.sales_receipt_items(), sales.latest_day(receipts))


@_query
def sales_trend(t):
    return sales.sales_trend(t.sales_transactions())


@_query
def sales_trend_filled(t):
    lines = t.sales_transactions()
    return sales.gap_fill(sales.sales_trend(lines), sales.latest_day(lines))


@_query
def trend_bounds(t):
    return sales.trend_bounds(sales_trend_filled(t))


@_query
def receipt_trend(t):
    return sales.receipt_trend(t.sales_receipts(), t.sales_receipt_items())


@_query
def incoming_trend(t):
    return sales.incoming_trend(t.incoming_goods())


@_query
def period_finance(t):
    return sales.period_finance(t.sales_transactions(), start="1998-01-01")  # one end alone: no filter


@_query
def period_finance_1998(t):
    return sales.period_finance(t.sales_transactions(), *YEAR)


@_query
def date_preset(t):
    days = t.sales_transactions().select(F.col("date").alias("day")).distinct()
    bounds = []
    for name in D.PRESETS:
        start, end = D.date_preset(name, F.col("day"))
        bounds += [start.alias(f"{name}_start"), end.alias(f"{name}_end")]
    return days.select("day", *bounds)


@_query
def role_dashboard(t):
    figures = dashboard.figures(t.products(), t.users(), t.customers(), t.suppliers(), daily_kpis(t))
    return dashboard.role_dashboard(figures)


# ---- per product ----


@_query
def sales_by_product(t):
    return sales.sales_by_product(t.sales_transactions(), t.products())


@_query
def top_products(t):
    return sales.top_products(sales_by_product(t), 10).select("product_id", "current_name", "total_revenue")


@_query
def report_row_number(t):
    return sales.report_row_number(sales_by_product(t)).select("no", "product_id", "total_revenue")


@_query
def printed_products(t):
    return period_report.printed_products(sales.report_row_number(sales_by_product(t)))


@_query
def product_report_with_total(t):
    return sales.product_report_with_total(t.sales_transactions(), t.products())


@_query
def product_label(t):
    named = sales.with_product_name(t.sales_receipt_items(), t.products())
    return named.select("id", S.product_label(F.col("productName"), F.col("product_id")).alias("label"))


# ---- lists ----


@_query
def recent_sales(t):
    return sales.recent_sales(t.sales_transactions(), t.products())


@_query
def recent_sales_receipts(t):
    return sales.recent_sales_receipts(t.sales_receipts(), t.sales_receipt_items())


@_query
def with_product_name(t):
    named = sales.with_product_name(t.sales_transactions(), t.products())
    return named.select("id", "product_id", "quantity", "total_price", "productName")


@_query
def recent_logs(t):
    return stock.recent_logs(t.inventory_logs())


@_query
def log_label(t):
    return stock.log_display(t.inventory_logs())


@_query
def list_incoming(t):
    return stock.list_incoming(t.incoming_goods(), t.products(), t.suppliers())


@_query
def incoming_display(t):
    return stock.incoming_display(list_incoming(t))


@_query
def list_outgoing(t):
    return catalog.list_desc(t.outgoing_goods())


def _count_items(t):
    lines = maintenance.counted_lines(t.products(), t.count_lines())
    return lines.withColumnRenamed("line", "id")


def _named_sessions(t):
    staff = S.text_or(F.col("staff_name"), S.DEFAULT_STAFF)
    return t.inventory_count_sessions().withColumns({"staff_name": staff, "note": S.text_or(F.col("note"), None)})


@_query
def count_session_log(t):
    return stock.count_session_log(_named_sessions(t), _count_items(t))


@_query
def count_session_sizes(t):
    return stock.count_session_log(_named_sessions(t), _count_items(t), n=None)


@_query
def count_sheet(t):
    return stock.count_sheet(_catalog(t))


@_query
def count_sign(t):
    differences = stock.count_differences(maintenance.counted_lines(t.products(), t.count_lines()))
    return differences.select("session_id", "line", "difference", "sign", "difference_text")


@_query
def sales_on(t):
    lines = t.sales_transactions()
    return sales.sales_on(lines, sales.latest_day(lines)).select("id", "product_id", "quantity", "total_price")


@_query
def sales_between(t):
    return sales.sales_between(t.sales_transactions(), *YEAR).select("id", "product_id", "quantity", "total_price")


# ---- receipts ----


@_query
def receipt_items(t):
    items = t.sales_receipt_items()
    newest = items.agg(F.max("receipt_id")).first()[0]
    return sales.receipt_items(items, newest).select(
        "id", "receipt_id", "product_id", "quantity", "price", "total_price"
    )


@_query
def receipt_lines(t):
    return sales.receipt_lines(t.sales_receipts(), t.sales_receipt_items()).select(
        "id", "receipt_id", "date", "cashier_name", "payment_method", "product_id", "total_price"
    )


@_query
def receipt_reconcile(t):
    return sales.receipt_reconcile(t.sales_receipts(), t.sales_receipt_items())


@_query
def receipt_document(t):
    return sales.receipt_text(sales.receipt_document(t.sales_receipts(), t.sales_receipt_items()))


# ---- baskets ----


@_query
def cumulative_cart_check(t):
    checked = baskets.cumulative_cart_check(t.cart_lines(), t.products())
    return checked.select("cart_id", "line", "product_id", "quantity", "stock_left", "reason")


@_query
def live_cart_stock(t):
    lines = t.cart_lines().withColumn("stock", S.whole_number(F.col("quantity"))).drop("quantity")
    return baskets.live_cart_stock(lines, t.products())


@_query
def basket_totals(t):
    return baskets.basket_totals(baskets.priced_lines(t.cart_lines(), t.products()))


@_query
def basket_discount_tax(t):
    totals = basket_totals(t).select("cart_id", "subtotal")
    return baskets.basket_discount_tax(totals, F.col("cart_id") % 120, F.lit(11))


@_query
def checkout_snapshot(t):
    return baskets.cart_verdicts(baskets.snapshot_check(t.cart_lines(), t.products()), t.carts())


@_query
def checkout_cumulative(t):
    return baskets.cart_verdicts(baskets.cumulative_cart_check(t.cart_lines(), t.products()), t.carts())


def _checkout(t):
    return baskets.checkout_snapshot(t.products(), t.cart_lines(), t.carts(), CHECKOUT_DAY, last_receipt_id=1000)


@_query
def checkout_receipts(t):
    return _checkout(t).receipts


@_query
def checkout_items(t):
    return _checkout(t).items


@_query
def checkout_sales(t):
    return _checkout(t).sales


@_query
def checkout_logs(t):
    return _checkout(t).logs


@_query
def checkout_stock(t):
    return stock.apply_movements(t.products(), _checkout(t).movements).select("id", "stock")


def _cumulative(t):
    return baskets.checkout_cumulative(t.products(), t.cart_lines(), t.carts(), CHECKOUT_DAY, last_receipt_id=1000)


@_query
def checkout_cumulative_receipts(t):
    return _cumulative(t).receipts


@_query
def checkout_cumulative_items(t):
    return _cumulative(t).items


@_query
def checkout_cumulative_logs(t):
    return _cumulative(t).logs


@_query
def checkout_cumulative_stock(t):
    return stock.apply_movements(t.products(), _cumulative(t).movements).select("id", "stock")


@_query
def sell(t):
    decided = baskets.sell_decisions(t.products(), t.sell_requests())
    return decided.select("seq", "product_id", "quantity", "reason")


# ---- maintenance ----


@_query
def validate_batch(t):
    judged = maintenance.with_reject_reason(t.suppliers(), "suppliers")
    return judged.select("id", "name", "address", "phone", "email", "reject_reason")


@_query
def validate_movements(t):
    return maintenance.with_reject_reason(t.incoming_requests(), "movements").select("seq", "product_id", "reject_reason")


@_query
def unknown_products(t):
    return maintenance.unknown_products(t.cart_lines(), t.products()).select("cart_id", "line", "product_id")


@_query
def apply_movements(t):
    moved = stock.apply_movements(t.products(), t.incoming_goods().select("product_id", "quantity"))
    return moved.select("id", "code", "stock")


@_query
def upsert(t):
    return maintenance.upsert(t.products(), t.product_changes(), "products")


def _delete_requests(t):
    return t.inventory_logs().filter("type = 'delete'").select(F.col("product_id").alias("id"))


@_query
def remove_ids(t):
    return maintenance.remove_ids(t.products(), _delete_requests(t)).select("id", "code", "name")


@_query
def delete_with_log(t):
    return maintenance.delete_with_log(t.products(), _delete_requests(t))[1]


@_query
def create_products(t):
    return maintenance.create_products(t.products(), t.new_products()).products


@_query
def create_products_logs(t):
    return maintenance.create_products(t.products(), t.new_products()).logs


@_query
def create_products_rejects(t):
    rejects = maintenance.create_products(t.products(), t.new_products()).rejects
    return rejects.select("seq", S.trimmed(F.col("code")).alias("code"), "reject_reason")


@_query
def append_batch(t):
    batch = t.customers().select(F.col("id").alias("seq"), "name", "address")
    return append_rows(t.suppliers(), batch, [F.col("seq")]).select("id", "name", "address")


def _received(t):
    return maintenance.receive_goods(t.products(), t.incoming_requests(), CHECKOUT_DAY)


@_query
def receive_goods(t):
    return _received(t).incoming


@_query
def receive_goods_logs(t):
    return _received(t).logs


@_query
def receive_goods_rejects(t):
    return _received(t).rejects.select("seq", "product_id", "reject_reason")


@_query
def receive_goods_stock(t):
    return stock.apply_movements(t.products(), _received(t).movements).select("id", "stock")


def _counted(t):
    return maintenance.stock_count(t.products(), t.count_sessions(), t.count_lines())


@_query
def stock_count(t):
    return _counted(t).items


@_query
def stock_count_rejects(t):
    return _counted(t).rejects


@_query
def stock_count_logs(t):
    return _counted(t).logs


@_query
def stock_count_stock(t):
    return stock.apply_movements(t.products(), _counted(t).movements).select("id", "stock")


@_query
def refused_changes(t):
    return maintenance.refused_changes(t.product_changes()).select("seq", "id")


@_query
def validate_categories(t):
    named = t.categories().withColumn("name", F.when(F.col("id") % 2 == 0, F.lit("  ")).otherwise(F.col("name")))
    judged = maintenance.with_reject_reason(named, "categories").select("id", "reject_reason")
    return t.categories().select("id", "name").join(judged, "id")


@_query
def validate_customers(t):
    email = F.when(F.col("points") < 0, F.lit("")).otherwise(F.col("email"))
    judged = maintenance.with_reject_reason(t.customers().withColumn("given", F.col("email")).withColumn("email", email), "customers")
    return judged.select("id", F.col("given").alias("email"), "reject_reason")


@_query
def upsert_suppliers(t):
    """Every supplier sends a change; those without email are refused."""
    changes = t.suppliers().select("id", F.lit(1).alias("seq"), F.lit(" Baru").alias("name"), F.col("name").alias("address"), "phone", "email")
    return maintenance.upsert(t.suppliers(), changes, "suppliers")


@_query
def apply_defaults(t):
    return apply_defaults_of(t.customers().select("id", "name"), "customers")


@_query
def seed_if_empty(t):
    """The categories stay as they are; an empty table gets the sample rows."""
    full = seed(t.categories(), samples.CATEGORIES, "categories")
    return full.union(seed(t.categories().filter("id < 0"), samples.CATEGORIES, "categories"))


# ---- scalars over whole tables ----


@_query
def ensure_number(t):
    raw = F.col("quantity")
    return t.cart_lines().select("cart_id", "line", raw.alias("raw"), S.ensure_number(raw).alias("number"))


@_query
def text_or(t):
    names = [F.col(c) for c in ("staffName", "staff_name", "cashierName", "cashier_name")]
    supplier = F.when(F.col("supplier_id") != 0, F.col("supplier_id"))
    return t.incoming_requests().select(
        "seq", S.first_text(*names, default=S.DEFAULT_STAFF).alias("staff_name"), S.or_dash(supplier).alias("supplier")
    )


@_query
def format_rp(t):
    return t.sales_receipt_items().select(
        "id", S.format_rp(F.col("total_price")).alias("rp"), S.format_idr(F.col("profit_per_unit")).alias("idr")
    )


@_query
def format_short(t):
    number = (F.col("id") / 1_000_000).cast("long") % 8
    amount = (
        F.when(number == 1, F.col("quantity")).when(number == 2, F.floor(F.col("price") / 100).cast("long"))
        .when(number == 3, -F.col("price")).when(number == 4, F.lit(0).cast("long")).otherwise(F.col("total_price"))
    )
    return t.sales_receipt_items().select("id", S.format_short(amount).alias("short"))


@_query
def day_label(t):
    return t.incoming_goods().select("id", D.day_label(F.col("date_in")).alias("label"))


@_query
def local_datetime(t):
    stamp = F.col("created_at")
    return t.inventory_logs().select(
        "id", D.utc_day(stamp).alias("day"), D.local_datetime(stamp).alias("utc_text"),
        D.local_datetime(stamp, "Asia/Jakarta").alias("jakarta_text"), S.prefix(stamp).alias("minute"),
    )


@_query
def movement_note(t):
    quantity = F.col("quantity")
    return t.sales_transactions().select(
        "id",
        S.sell_note(quantity, F.col("payment_method")).alias("sell"),
        S.incoming_note(quantity, F.col("cashier_name")).alias("incoming"),
        S.count_note(F.col("cashier_name"), quantity).alias("stock_opname"),
        S.delete_note(F.col("product_id")).alias("delete"),
    )


# ---- streams and sinks ----


def _run_folder(t) -> str:
    """A new folder for one run below the shared folder."""
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


#: The events arrive in at least so many micro-batches, each of at most about so many rows, in files of at most about so many.
EVENT_BATCHES, EVENT_BATCH_ROWS, EVENT_FILE_ROWS = 6, 4_000_000, 500_000


def _event_files(t, folder: str, repeats: bool) -> int:
    """Write the events below folder/in, in id order, and return how many files each micro-batch has.

    Every seventh event comes a micro-batch late. With repeats it comes in time, too, and the first micro-batch comes twice. The
    events are read once, dealt to a folder per micro-batch, and each of these is copied in turn, as a stream takes files by age.
    """
    events = t.raw("events")
    rows = events.count()
    n = max(EVENT_BATCHES, -(-rows // EVENT_BATCH_ROWS))
    files = max(1, -(-rows // (n * EVENT_FILE_ROWS)))
    bounds = events.approxQuantile("event_id", [i / n for i in range(1, n)], 0.1 / n)
    late, part = F.col("event_id") % 7 == 0, sum((F.when(F.col("event_id") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    if repeats:
        comes = [part, F.when(late, part + 1), F.when(part == 0, 2)]
    else:
        comes = [F.when(late, part + 1).otherwise(part)]
    dealt = events.filter("event_id IS NOT NULL").withColumn("_batch", F.explode(F.array_compact(F.array(*comes))))
    dealt.write.partitionBy("_batch").parquet(f"{folder}/dealt")
    dealt = t.spark.read.schema(StructType([*events.schema.fields, StructField("_batch", IntegerType())])).parquet(f"{folder}/dealt")
    for i in range(n + 1):
        target = f"{folder}/in/{i}"
        now = dealt.filter(F.col("_batch") == i).drop("_batch")
        now.repartition(files).write.parquet(target)
        for _ in range(len(t.spark.read.schema(events.schema).parquet(target).inputFiles()), files):  # so few rows that a file is missing
            t.spark.createDataFrame([], events.schema).coalesce(1).write.mode("append").parquet(target)
    return files


def _event_stream(t, repeats: bool) -> tuple[DataFrame, str]:
    """The events table as a stream of log rows over several micro-batches (see _event_files), and a folder for the run."""
    folder, events = _run_folder(t), t.raw("events")
    files = _event_files(t, folder, repeats)
    stream = (
        t.spark.readStream.schema(events.schema).option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    )
    return t.as_logs(stream), folder


@_query
def sales_trend_stream(t):
    amount = F.col("quantity")
    costed = F.col("product_id").isNotNull()
    events, folder = _event_stream(t, repeats=False)
    lines = events.select(
        F.col("created_at").alias("ts"), "quantity", (amount * 100).alias("total_price"),
        F.when(costed, F.lit(80).cast("long")).alias("purchase_price"),
        F.when(costed, F.lit(20).cast("long")).alias("profit_per_unit"),
    )
    jobs.start_sales_trend(lines, folder, "60 days").awaitTermination()
    return jobs.live_sales_trend(t.spark, folder)


@_query
def movement_stream(t):
    events, folder = _event_stream(t, repeats=True)
    moves = events.select(F.col("id").alias("event_id"), F.col("created_at").alias("ts"), "product_id", "quantity")
    jobs.start_movements(moves, folder, "60 days").awaitTermination()
    return jobs.live_stock(t.products(), folder).select("id", "stock")


@_query
def sell_stream(t):
    events, folder = _event_stream(t, repeats=True)
    requests = events.select(
        F.col("id").alias("seq"), "product_id", F.col("quantity").cast("string").alias("quantity")
    )
    jobs.start_sell(requests, t.products(), folder).awaitTermination()
    return jobs.sell_results(t.spark, folder)


@_query
def period_report_files(t):
    """The product section of the period report, written and read back."""
    report = period_report.period_report(t, *YEAR)
    target = period_report_export(report, _run_folder(t), *YEAR, as_of=CHECKOUT_DAY)
    return t.spark.read.parquet(f"{target}/products")


def _report_section(t, name: str) -> DataFrame:
    """One section of the period report, written with the others and read back."""
    target = period_report_export(period_report.period_report(t, *YEAR), _run_folder(t), *YEAR, as_of=CHECKOUT_DAY)
    return t.spark.read.parquet(f"{target}/{name}")


@_query
def period_report_finance(t):
    return _report_section(t, "finance")


@_query
def period_report_products_total(t):
    return _report_section(t, "products_total")


@_query
def period_report_counts(t):
    return _report_section(t, "counts")


@_query
def period_report_stock(t):
    return _report_section(t, "stock")


@_query
def period_report_totals(t):
    """One row from all sections of the period report, written and read back."""
    target = period_report_export(period_report.period_report(t, *YEAR), _run_folder(t), *YEAR, as_of=CHECKOUT_DAY)
    read = lambda name: t.spark.read.parquet(f"{target}/{name}")
    finance = read("finance").select(
        F.col("periodGross").alias("gross"), F.col("totalTransactions").alias("lines"), F.col("periodNet").alias("net")
    )
    total = read("products_total").agg(
        F.max(F.when(F.col("is_total"), F.col("total_qty"))).alias("total_qty"), F.count(F.lit(1)).alias("report_rows")
    )
    counts = read("counts").select(F.col("totalProducts").alias("products"))
    shelf = read("stock").agg(F.sum("stock").alias("stock"))
    return finance.crossJoin(total).crossJoin(counts).crossJoin(shelf)  # one row each


@_query
def receipt_lines_bucketed(t):
    """The receipts and their lines laid out by receipt, joined without a shuffle."""
    folder, run = _run_folder(t), f"r{uuid.uuid4().hex}"
    receipts = write_bucketed(t.sales_receipts(), f"{run}_receipts", f"{folder}/receipts", "id", buckets=8)
    items = write_bucketed(t.sales_receipt_items(), f"{run}_items", f"{folder}/items", "receipt_id", buckets=8)
    return sales.receipt_lines_colocated(receipts, items).select(
        "id", "receipt_id", "date", "cashier_name", "payment_method", "product_id", "total_price"
    )


@_query
def daily_tables(t):
    """The sales laid out by day, read with their schema; a filter on days reads the folders of those days."""
    path = f"{_run_folder(t)}/sales"
    write_table(t.sales_transactions(), path, "sales_transactions")
    week = sales.sales_between(scan(t.spark, path, "sales_transactions"), "1998-03-01", "1998-03-07")
    return week.select("id", "product_id", "quantity", "total_price", "date")


@_query
def receipt_export_files(t):
    path = f"{_run_folder(t)}/receipts"
    receipt_export(sales.receipt_document(t.sales_receipts(), t.sales_receipt_items()), path)
    back = t.spark.read.json(path).select("receipt_id", "number", "total_text", "page_lines")
    return back.groupBy("receipt_id", "number", "total_text").agg(F.sum("page_lines").alias("n_items"))
