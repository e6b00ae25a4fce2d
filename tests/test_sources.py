"""Reading, widening, defaults, seeding, exports."""

from __future__ import annotations

import json
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import functions as F

from stockline.operators import catalog, sales
from stockline.plans import dashboard, period_report
from stockline.schemas import TABLES
from stockline.sources import samples, sinks, star, tables


def test_scan_reads_only_what_is_used(spark, tmp_path, frame):
    frame("id long, name string, description string", (1, "a", "b"), (2, "c", None)).write.parquet(str(tmp_path / "c"))
    table = tables.scan(spark, str(tmp_path / "c"), "categories")
    assert table.schema == TABLES["categories"]
    assert table.filter("id = 2").select("name").first()[0] == "c"


def test_align_schema_adds_typed_nulls_and_keeps_the_rest(frame):
    old = frame("id long, date date, extra int", (1, date(2026, 5, 1), 5))
    wide = tables.align_schema(old, TABLES["sales_transactions"])
    assert wide.columns[:3] == ["id", "date", "extra"]
    assert set(TABLES["sales_transactions"].names) < set(wide.columns)
    assert dict(wide.dtypes)["profit_per_unit"] == "bigint" and wide.first()["profit_per_unit"] is None


def test_defaults_only_fill_columns_the_batch_lacks(frame):
    assert tables.apply_defaults(frame("id long, name string", (1, "a")), "customers").first()["points"] == 0
    assert tables.apply_defaults(frame("id long, points long", (1, None)), "customers").first()["points"] is None
    now = F.lit(datetime(2026, 5, 1, 10, 0, 0, 500)).cast("timestamp_ntz")
    assert tables.apply_defaults(frame("id long", (1,)), "inventory_logs", now).first()["created_at"] == datetime(2026, 5, 1, 10)


def test_sample_catalogue(spark, frame):
    empty = spark.createDataFrame([], TABLES["products"])
    products = tables.seed_if_empty(empty, samples.PRODUCTS, "products")
    categories = tables.seed_if_empty(spark.createDataFrame([], TABLES["categories"]), samples.CATEGORIES, "categories")
    suppliers = tables.seed_if_empty(spark.createDataFrame([], TABLES["suppliers"]), samples.SUPPLIERS, "suppliers")
    assert products.count() == 34 and [r[0] for r in products.select("id").collect()] == list(range(1, 35))
    view = catalog.catalog_view(products, categories, suppliers)
    per_category = {r["category"]: r["count"] for r in view.groupBy("category").count().collect()}
    assert per_category == {"Elektronik": 6, "Fashion": 6, "Makanan": 6, "Minuman": 5, "Rumah Tangga": 5, "Perawatan": 6}
    assert view.filter("supplier IS NULL").count() == 0
    assert catalog.low_stock(products).count() == 0
    assert catalog.lookup_code(products, frame("code string", ("mn-001",))).first()["product_name"] == "Air Mineral 1.5L"
    assert tables.seed_if_empty(products.limit(1), samples.PRODUCTS, "products").count() == 1


def test_receipt_export_writes_a_document_per_receipt(spark, tmp_path, frame):
    receipts = frame("id long, date date, cashier_name string, payment_method string, subtotal long, total_items long",
                     (1, date(2026, 5, 1), "Ani", None, 5000, 2), (2, date(2026, 5, 2), None, "QRIS", 7, 1))
    items = frame("id long, receipt_id long, product_id long, quantity long, price long, total_price long, product_name string",
                  (2, 1, 1, 1, 2000, 2000, "Teh"), (1, 1, 2, 1, 3000, 3000, "Kopi"), (3, 2, 1, 1, 7, 7, None))
    out = str(tmp_path / "receipts")
    sinks.receipt_export(sales.receipt_document(receipts, items), out)
    assert sorted(p.name for p in Path(out).glob("day=*")) == ["day=2026-05-01", "day=2026-05-02"]
    texts = [line for p in Path(out).glob("day=2026-05-01/*.json") for line in p.read_text().splitlines()]
    document = json.loads(texts[0])
    assert document["lines_text"] == "Kopi | 1 | Rp 3.000 | Rp 3.000\nTeh | 1 | Rp 2.000 | Rp 2.000"
    assert document["number"] == "#1" and document["payment_method"] == "-" and document["total_text"] == "Rp 5.000"


def test_receipt_export_writes_few_files(spark, tmp_path):
    """A file per day, not one per day and task."""
    receipts = spark.range(400).selectExpr(
        "id", "date_add(date'2026-05-01', cast(id % 3 as int)) date", "'Ani' cashier_name", "'QRIS' payment_method", "7L subtotal", "1L total_items"
    ).repartition(8)
    items = spark.range(400).selectExpr("id", "id receipt_id", "1L product_id", "1L quantity", "7L price", "7L total_price", "'Teh' product_name")
    documents = sales.receipt_document(receipts, items).repartition(8)
    sinks.receipt_export(documents, str(tmp_path / "receipts"))
    files = list((tmp_path / "receipts").glob("day=*/*.json"))
    assert len(files) == 3 and sum(len(f.read_text().splitlines()) for f in files) == 400


def test_period_report_export(spark, tmp_path):
    retail = star.StarTables(spark, "/root/testdata/sf0.001")
    report = period_report.period_report(retail, "1998-01-01", "1998-12-31")
    target = sinks.period_report_export(report, str(tmp_path), "1998-01-01", "1998-12-31", "2001-08-01", fmt="csv")
    assert target.endswith("/laporan-1998-01-01_1998-12-31")
    finance = spark.read.option("header", True).csv(f"{target}/finance").first()
    assert finance["period_label"] == "Periode: 1998-01-01 s/d 1998-12-31"
    assert sinks.report_name(None, "2001-01-01", "2001-08-01") == "laporan-rekapan-2001-08-01"
    assert sinks.period_label("", None) == "Sepanjang Waktu"


def test_overview_has_all_frames(spark):
    retail = star.StarTables(spark, "/root/testdata/sf0.001")
    frames = dashboard.overview(retail, date(2001, 8, 1))
    counts = {name: df.count() for name, df in frames.items()}
    assert counts == {
        "products": 200, "recentSales": 7, "recentLogs": 8, "lowStock": counts["lowStock"], "counts": 1, "today": 1,
        "trend": 7, "bounds": 1, "roles": 11,
    }


def test_date_filter_reaches_the_scan(spark, tmp_path, frame):
    rows = [(i, date(2026, 5, 1 + i % 9), i, 1, 1, 1, 1) for i in range(90)]
    frame("id long, date date, product_id long, quantity long, total_price long, purchase_price long, profit_per_unit long",
          *rows).write.parquet(str(tmp_path / "s"))
    table = tables.scan(spark, str(tmp_path / "s"), "sales_transactions")
    plan = sales.sales_on(table, date(2026, 5, 3)).select("total_price")._jdf.queryExecution().toString()
    assert "EqualTo(date,2026-05-03)" in plan
    assert "ReadSchema: struct<date:date,total_price:bigint>" in plan


def test_trend_of_a_table_laid_out_by_day_reads_only_its_days(spark, tmp_path, frame):
    rows = [(i, date(2026, 5, 1 + i % 20), i, 1, 1, 1, 1) for i in range(100)] + [(100, None, 1, 1, 1, 1, 1)]
    lines = frame("id long, date date, product_id long, quantity long, total_price long, purchase_price long, profit_per_unit long", *rows)
    path = str(tmp_path / "s")
    tables.write_table(lines, path, "sales_transactions", "overwrite")
    table = tables.scan(spark, path, "sales_transactions")
    assert table.count() == 101 and table.filter("date IS NULL").count() == 1
    trend = sales.sales_trend(table, 2)
    plan = trend._jdf.queryExecution().toString()
    assert "PartitionFilters: [date" in plan and "2026-05-20" in plan
    assert sorted((r["day"].day, r["total_gross"]) for r in trend.collect()) == [(19, 5), (20, 5)]


def test_ids_of_deleted_rows_are_not_used_again(frame):
    target, batch = frame("id long", (1,), (2,)), frame("seq long", (5,), (4,))
    got = tables.append_rows(target, batch, [F.col("seq")], last_id=9).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(10, 4), (11, 5)]


def test_bucketed_receipts_join_without_a_shuffle(spark, frame, tmp_path):
    receipts = frame("id long, date date, cashier_name string, payment_method string", *[(i, None, f"K{i}", "QRIS") for i in range(40)])
    items = frame("id long, receipt_id long, quantity long", *[(i, i % 50, 1) for i in range(300)], (900, None, 1))
    laid_out = [
        tables.write_bucketed(table, f"t_{key}", str(tmp_path / key), key, buckets=4)
        for table, key in ((receipts, "id"), (items, "receipt_id"))
    ]
    joined = sales.receipt_lines_colocated(*laid_out)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    columns = ["id", "receipt_id", "quantity", "cashier_name"]
    plain = sales.receipt_lines(receipts, items).select(columns).collect()
    assert sorted(joined.select(columns).collect()) == sorted(plain) and len(plain) == 240
    again = tables.write_bucketed(receipts.limit(3), "t_id", str(tmp_path / "id"), "id", buckets=4)
    assert again.count() == 3
