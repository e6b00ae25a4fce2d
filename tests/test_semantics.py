"""Behaviour that is easy to get wrong, on hand-made rows."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from stockline.operators import baskets, catalog, maintenance, sales, stock
from stockline.plans import dashboard, period_report

DAY = date(2026, 5, 10)
SALES = "id long, date date, product_id long, quantity long, total_price long, purchase_price long, profit_per_unit long"


@pytest.fixture
def products(frame):
    return frame(
        "id long, code string, name string, category_id long, unit string, purchase_price long, sale_price long, "
        "stock long, entry_date date, storage_location string, supplier_id long",
        (1, "A-1", "Kopi", 1, "pcs", 4, 10, 10, None, "R1", 1),
        (2, "a-2", "100% Jus", 9, "pcs", None, 20, 5, None, "R1", 9),
        (3, None, "Teh", None, "pcs", 3, None, None, None, None, None),
        (4, "a-1", "Gula", 1, "pcs", 1, 2, 0, None, "", 1),
        (5, "D-5", "Beras", 1, "pcs", 1, 2, 6, None, "", 1),
        (6, "D-6", "Susu", 1, "pcs", 1, 2, -1, None, "", 1),
        (7, "D-7", "Roti", 1, "pcs", 1, 2, 1, None, "", 1),
    )


@pytest.fixture
def lines(frame):
    return frame(
        SALES,
        (1, date(2026, 5, 8), 1, 2, 20, 4, 6),
        (2, date(2026, 5, 10), 1, 1, 10, 4, 6),
        (3, date(2026, 5, 10), 2, 3, 60, None, None),  # before costs were kept
        (4, date(2026, 5, 10), 99, 1, 7, 5, 2),  # product deleted since
        (5, date(2026, 5, 10), None, 1, 8, None, None),
        (6, None, 1, 1, 10, 4, 6),
    )


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


# ---- catalogue ----


def test_dangling_references_keep_the_product(products, frame):
    categories = frame("id long, name string", (1, "Minuman"))
    suppliers = frame("id long, name string", (1, "PT A"))
    rows = {r["id"]: r for r in catalog.catalog_view(products, categories, suppliers).collect()}
    assert len(rows) == 7
    assert rows[1]["category"] == "Minuman" and rows[1]["supplierId"] == 1
    assert rows[2]["category"] is None and rows[2]["categoryId"] == 9
    assert [tuple(r) for r in catalog.preferred_supplier(products, suppliers).filter("product_id < 5").orderBy("product_id").collect()] == [
        (1, 1, "PT A"), (4, 1, "PT A")
    ]


def test_search_is_literal_and_ignores_case(products):
    assert ids(catalog.search_products(products, " % ")) == [2]
    assert ids(catalog.search_products(products, "A-1")) == [1, 4]
    assert ids(catalog.search_products(products, "  ")) == list(range(1, 8))
    assert ids(catalog.filter_catalog(products, 0, None)) == list(range(1, 8))
    assert ids(catalog.filter_catalog(products, 1, 1)) == [1, 4, 5, 6, 7]


def test_lookup_code_takes_the_newest_product(products, frame):
    scans = frame("scan int, code string", (1, " a-1 "), (2, "A-2"), (3, "zzz"), (4, ""), (5, None))
    found = {r["scan"]: r["product_id"] for r in catalog.lookup_code(products, scans).collect()}
    assert found == {1: 4, 2: 2, 3: None, 4: None, 5: None}
    assert {r["scan"] for r in catalog.missed_codes(products, scans).collect()} == {3, 4, 5}


def test_low_stock_counts_out_of_stock_and_unknown_stock(products):
    assert ids(catalog.low_stock(products)) == [2, 3, 4, 6, 7]


def test_stock_board_order(products, frame):
    none = frame("id long, name string")
    board = catalog.stock_board(catalog.with_category_and_supplier(products, none, none)).collect()
    assert [(r["id"], r["tier"]) for r in board] == [
        (5, "Aman"), (1, "Aman"), (7, "Akan habis"), (2, "Akan habis"), (6, "Habis"), (4, "Habis"), (3, "Habis")
    ]
    assert board[-1]["code"] == "—" and board[-1]["category"] == "—"


def test_duplicate_keys_allow_many_nulls(frame):
    table = frame("id int, code string", (1, "A"), (2, "A"), (3, "a"), (4, None), (5, None))
    assert [tuple(r) for r in catalog.duplicate_keys(table, "code").collect()] == [("A", 2)]


# ---- sales ----


def test_unknown_cost_counts_in_gross_only(lines):
    row = sales.period_finance(lines).first()
    assert (row["periodGross"], row["periodCapital"], row["periodNet"], row["totalTransactions"]) == (115, 21, 26, 6)


def test_range_needs_both_ends_and_includes_them(lines):
    assert sales.sales_between(lines, start=DAY).count() == 6
    assert ids(sales.sales_between(lines, date(2026, 5, 8), DAY)) == [1, 2, 3, 4, 5]
    assert sales.sales_between(lines, DAY, date(2026, 5, 8)).count() == 0
    empty = sales.period_finance(lines, DAY, date(2026, 5, 8)).first()
    assert tuple(empty) == (0, 0, 0, 0)


def test_day_figures_are_zero_on_an_empty_day(lines):
    assert tuple(sales.daily_kpis(lines, date(2030, 1, 1)).first()) == (0, 0, 0, 0)
    assert tuple(sales.daily_kpis(lines, DAY).first()) == (85, 85, 9, 8)


def test_trend_keeps_days_with_sales_and_gap_fill_calendar_days(lines):
    trend = sales.sales_trend(lines, 2)
    assert [r["day"] for r in trend.orderBy("day").collect()] == [date(2026, 5, 8), DAY]
    assert [r["day"] for r in sales.sales_trend(lines, 9).orderBy("day").collect()] == [None, date(2026, 5, 8), DAY]
    filled = sales.gap_fill(sales.sales_trend(lines), DAY, 3).orderBy("day").collect()
    assert [(r["day"].day, r["total_gross"]) for r in filled] == [(8, 20), (9, 0), (10, 85)]
    later = sales.gap_fill(sales.sales_trend(lines), date(2026, 5, 12), 2)
    assert sales.trend_bounds(later).first() == (0, 1, 0.5)


def test_profit_of_a_product_without_costs_is_unknown_but_its_capital_is_zero(lines, products):
    rows = {r["product_id"]: r for r in sales.sales_by_product(lines, products).collect()}
    assert rows[2]["total_capital"] == 0 and rows[2]["total_profit"] is None
    assert rows[99]["current_name"] is None
    printed = period_report.printed_products(sales.report_row_number(sales.sales_by_product(lines, products))).orderBy("no").collect()
    assert [(r["no"], r["name"], r["profit"]) for r in printed] == [
        (1, "100% Jus", "Rp 0"), (2, "Kopi", "Rp 24"), (3, "ID:null", "Rp 0"), (4, "ID:99", "Rp 2")
    ]


def test_a_sale_without_product_is_not_the_total(lines, products):
    report = sales.product_report_with_total(lines, products)
    assert report.filter("is_total").count() == 1
    total = report.filter("is_total").first()
    finance = sales.period_finance(lines).first()
    assert (total["total_revenue"], total["total_capital"], total["total_profit"]) == (
        finance["periodGross"], finance["periodCapital"], finance["periodNet"]
    )
    assert report.filter("product_id IS NULL AND NOT is_total").first()["total_revenue"] == 8


def test_recent_sales_keep_the_order_and_lose_deleted_names(lines, products):
    rows = sales.recent_sales(lines, products, 3).orderBy(F.desc("id")).collect()
    assert [(r["id"], r["productName"]) for r in rows] == [(6, "Kopi"), (5, None), (4, None)]


def test_header_sums_do_not_fan_out(frame):
    receipts = frame("id long, date date, subtotal long, total_items long", (1, DAY, 30, 3), (2, DAY, 5, 1))
    items = frame(
        "id long, receipt_id long, quantity long, total_price long, purchase_price long, profit_per_unit long",
        (1, 1, 1, 10, 4, 6), (2, 1, 2, 20, 4, 6), (3, 2, 1, 6, None, None),
    )
    assert tuple(sales.daily_kpis_receipts(receipts, items, DAY).first()) == (35, 35, 12, 18)
    assert tuple(sales.receipt_trend(receipts, items).first()) == (DAY, 35, 12, 18)
    balanced = {r["id"]: r["balanced"] for r in sales.receipt_reconcile(receipts, items).collect()}
    assert balanced == {1: True, 2: False}


def test_role_dashboard_shows_the_rows_of_one_role(lines, products, frame):
    people = frame("id long", (1,), (2,))
    figures = dashboard.figures(products, people, people, people, sales.daily_kpis(lines, DAY))
    rows = dashboard.role_dashboard(figures, "gudang").orderBy("position").collect()
    assert [(r["label"], r["value"]) for r in rows] == [
        ("Total Produk", "7"), ("Stok Menipis", "5"), ("Supplier", "2"), ("Pelanggan", "2")
    ]
    assert dashboard.role_dashboard(figures, "admin").filter("position = 4").first()["value"] == "Rp" + chr(0xA0) + "85"


# ---- baskets ----


CARTS = "cart_id long, payment_method string, cashier_name string"
LINES = "cart_id long, line long, product_id long, quantity string"


@pytest.fixture
def carts(frame):
    return frame(CARTS, *[(i, None if i == 1 else " QRIS ", "  ") for i in range(1, 8)])


@pytest.fixture
def cart_lines(frame):
    return frame(
        LINES,
        (1, 1, 1, " 2 "), (1, 2, 5, "1e0"),
        (2, 1, 1, "6"), (2, 2, 1, "6"),  # 12 of 10: oversells unless stock falls line by line
        (3, 1, 1, "1"), (3, 2, 99, "1"),
        (4, 1, 1, "abc"), (4, 2, 99, "1"),
        (5, 1, 3, "1"),  # unknown stock counts as 0
        (6, 1, 1, "2.5"),
    )


def reasons(checkout):
    return {r["cart_id"]: r["reason"] for r in checkout.verdicts.collect()}


def test_checkout_against_opening_stock(products, carts, cart_lines):
    done = baskets.checkout_snapshot(products, cart_lines, carts, DAY, last_receipt_id=100)
    assert reasons(done) == {
        1: None, 2: None, 3: "unknown_product", 4: "bad_item", 5: "not_enough_stock", 6: "bad_item", 7: "empty_cart"
    }
    receipts = done.receipts.orderBy("id").collect()
    assert [(r["id"], r["cart_id"], r["subtotal"], r["total_items"], r["payment_method"], r["cashier_name"], r["date"]) for r in receipts] == [
        (101, 1, 22, 3, "Tunai", "Kasir", DAY), (102, 2, 120, 12, "QRIS", "Kasir", DAY)
    ]
    assert done.items.count() == done.sales.count() == done.logs.count() == 4
    for part in (done.items, done.sales, done.logs, done.movements):  # lines and headers have met before
        assert "Join" not in part._jdf.queryExecution().optimizedPlan().toString()
    assert baskets.checkout_cumulative(products, cart_lines, carts, DAY).sales is None
    assert {r["note"] for r in done.logs.collect()} == {
        "Penjualan x2 (metode: Tunai)", "Penjualan x1 (metode: Tunai)", "Penjualan x6 (metode: QRIS)"
    }
    after = stock.apply_movements(products, done.movements)
    assert {r["id"]: r["stock"] for r in after.collect()} == {1: -4, 2: 5, 3: None, 4: 0, 5: 5, 6: -1, 7: 1}
    assert ids(stock.oversold(after)) == [1, 6]
    headers = done.receipts.withColumn("id", F.col("id"))
    assert sales.receipt_reconcile(headers, done.items).filter("NOT balanced").count() == 0


def test_checkout_sells_refused_lines_without_number_of_accepted_carts(products, carts, frame):
    """A cart is judged by its numbered lines, as before; a lost number must not lose the line from the receipt."""
    lines = frame("cart_id long, line long, product_id long, quantity string", (1, None, 1, "1000000"), (1, 1, 1, "1"))
    done = baskets.checkout_snapshot(products, lines, carts, DAY)
    assert [r.accepted for r in done.verdicts.filter("cart_id = 1").collect()] == [True]
    assert sorted(r.quantity for r in done.items.collect()) == [1, 1_000_000]


def test_checkout_keeps_its_lines_as_compressed_tables(products, carts, cart_lines):
    lines = cart_lines.withColumn("note", F.lit(None))  # columns that no result needs are not kept
    for done in (baskets.checkout_snapshot(products, lines, carts, DAY), baskets.checkout_cumulative(products, lines, carts, DAY)):
        for part in (done.verdicts, done.receipts, done.items, done.logs, done.movements):
            assert part.inputFiles() and all(name.endswith(".parquet") for name in part.inputFiles())


def test_cumulative_checkout_accepts_a_subset(products, carts, cart_lines):
    done = baskets.checkout_cumulative(products, cart_lines, carts, DAY)
    assert reasons(done)[2] == "not_enough_stock"
    accepted = {c for c, r in reasons(done).items() if r is None}
    assert accepted == {1}
    left = baskets.cumulative_cart_check(cart_lines, products).filter("cart_id = 2").orderBy("line").collect()
    assert [(r["stock_left"], r["reason"]) for r in left] == [(10, None), (4, "not_enough_stock")]


def test_basket_amounts(frame, products, cart_lines):
    totals = baskets.basket_totals(baskets.priced_lines(cart_lines.filter("cart_id = 1"), products))
    row = totals.first()
    assert (row["subtotal"], row["total_items"], row["line_count"], row["cost"], row["profit"]) == (22, 3, 2, 9, 13)
    priced = baskets.basket_discount_tax(totals, F.lit(10), F.lit(11)).first()
    assert (priced["discounted"], priced["grand_total"]) == (pytest.approx(19.8), pytest.approx(21.978))
    assert baskets.basket_discount_tax(totals, F.lit(150), F.lit(11)).first()["grand_total"] == 0


def test_live_cart_stock_falls_back_to_the_copy(frame, products):
    lines = frame("cart_id long, line long, product_id long, stock long", (1, 1, 1, 3), (1, 2, 99, 4), (1, 3, 98, None), (1, 4, 3, 8))
    assert [r["stock"] for r in baskets.live_cart_stock(lines, products).orderBy("line").collect()] == [10, 4, 0, 8]


def test_a_refused_sale_uses_no_stock(products, frame):
    requests = frame(
        "seq long, product_id long, quantity string, payment_method string, cashier_name string",
        (1, 1, "7", None, "Ani"), (2, 1, "5", None, None), (3, 1, "3", " ", None), (4, 1, "1", None, None), (5, 99, "1", None, None),
    )
    sold = baskets.sell(products, requests, DAY)
    assert {r["seq"]: r["reason"] for r in sold.decisions.collect()} == {
        1: None, 2: "not_enough_stock", 3: None, 4: "not_enough_stock", 5: "unknown_product"
    }
    assert sorted((r["quantity"], r["cashier_name"], r["payment_method"]) for r in sold.sales.collect()) == [
        (3, "Kasir", "Tunai"), (7, "Ani", "Tunai")
    ]
    assert sold.movements.agg(F.sum("quantity")).first()[0] == -10


# ---- maintenance ----


def test_stock_count_uses_server_stock_and_refuses_whole_sessions(products, frame):
    sessions = frame(
        "session_id long, counted_at timestamp_ntz, staff_name string, note string",
        *[(i, datetime(2026, 5, 10, 8), " " if i == 1 else "Budi", "") for i in range(1, 5)],
    )
    lines = frame(
        "session_id long, line long, product_id long, counted_stock string, note string",
        (1, 1, 1, "7", " ok "), (1, 2, 1, "8", None), (1, 3, 2, "abc", ""), (1, 4, 3, "4", None),
        (2, 1, 1, "7", None), (2, 2, 99, "7", None), (4, 1, 1, "1.5", None),
    )
    done = maintenance.stock_count(products, sessions, lines)
    items = done.items.orderBy("line").collect()
    assert [(r["system_stock"], r["counted_stock"], r["difference"], r["note"]) for r in items] == [
        (10, 7, -3, "ok"), (10, 8, -2, None), (5, 0, -5, None), (0, 4, 4, None)
    ]
    assert {r["session_id"]: r["reject_reason"] for r in done.rejects.collect()} == {
        2: "unknown_product", 3: "empty_count", 4: "invalid_data"
    }
    assert done.sessions.first()["staff_name"] == "Gudang"
    assert "Stok opname (Gudang): 7" in {r["note"] for r in done.logs.collect()}
    after = {r["id"]: r["stock"] for r in stock.apply_movements(products, done.movements).collect()}
    assert (after[1], after[2], after[3]) == (5, 0, None)  # listed twice: both differences; unknown stock stays unknown


def test_receive_goods(products, frame):
    batch = frame(
        "seq long, product_id long, quantity string, supplier_id long, staffName string, staff_name string, "
        "cashierName string, cashier_name string",
        (1, 1, "5", 0, "", None, " Ani ", None), (2, 1, "0", 1, None, None, None, None), (3, 99, "1", 1, None, None, None, None),
        (4, 0, "1", 1, None, None, None, None), (5, 3, "2", 4, "  ", "Budi", None, None),
    )
    done = maintenance.receive_goods(products, batch, DAY)
    rows = done.incoming.orderBy("seq").collect()
    assert [(r["seq"], r["quantity"], r["supplier_id"], r["staff_name"], r["date_in"]) for r in rows] == [
        (1, 5, None, "Ani", DAY), (5, 2, 4, "Gudang", DAY)
    ]
    assert {r["seq"]: r["reject_reason"] for r in done.rejects.collect()} == {
        2: "bad_incoming", 3: "unknown_product", 4: "bad_incoming"
    }
    assert {r["note"] for r in done.logs.collect()} == {"Barang masuk x5 (staff: Ani)", "Barang masuk x2 (staff: Gudang)"}
    after = {r["id"]: r["stock"] for r in stock.apply_movements(products, done.movements).collect()}
    assert after[1] == 15 and after[3] is None


def test_replace_is_not_a_patch_and_the_last_change_counts(products, frame):
    changes = frame("seq long, id long, name string, stock string", (1, 1, "X", "1"), (2, 1, " Baru ", "x"), (3, 99, "Y", "1"))
    rows = {r["id"]: r for r in maintenance.upsert(products, changes, "products").collect()}
    assert len(rows) == 7
    assert (rows[1]["name"], rows[1]["code"], rows[1]["stock"], rows[1]["category_id"], rows[1]["sale_price"]) == ("Baru", "", 0, None, 0)
    assert rows[2]["name"] == "100% Jus"
    categories = frame("id long, name string, description string", (1, "A", "a"), (2, "B", "b"))
    edits = frame("seq long, id long, name string, description string", (1, 1, "C", None), (2, 1, " ", "no"), (3, 2, "D", " d "))
    got = {r["id"]: (r["name"], r["description"]) for r in maintenance.upsert(categories, edits, "categories").collect()}
    assert got == {1: ("C", ""), 2: ("D", "d")}  # the change without a name is refused


def test_delete_logs_every_request(products, frame):
    left, logs = maintenance.delete_with_log(products, frame("id long", (1,), (1,), (99,)))
    assert ids(left) == [2, 3, 4, 5, 6, 7]
    assert sorted((r["product_id"], r["quantity"], r["note"]) for r in logs.collect()) == [
        (1, 0, "Hapus produk #1"), (1, 0, "Hapus produk #1"), (99, 0, "Hapus produk #99")
    ]


def test_create_products(products, frame):
    batch = frame(
        "seq long, code string, name string, category_id long, unit string, purchase_price string, sale_price string, stock string",
        (1, " N-1 ", "Baru", 1, "pcs", "4", "x", " 3 "), (2, "N-1", "Lagi", 1, "pcs", "1", "1", "1"),
        (3, "A-1", "Ada", 1, "pcs", "1", "1", "1"), (4, "N-2", " ", 1, "pcs", "1", "1", "1"), (5, "N-2", "Z", 0, "pcs", "1", "1", "1"),
        (6, "N-2", "Ok", 2, "pcs", None, "1", None),
    )
    done = maintenance.create_products(products, batch)
    rows = done.products.orderBy("id").collect()
    assert [(r["id"], r["code"], r["name"], r["sale_price"], r["stock"]) for r in rows] == [(8, "N-1", "Baru", 0, 3), (9, "N-2", "Ok", 1, 0)]
    assert {r["seq"]: r["reject_reason"] for r in done.rejects.collect()} == {
        2: "duplicate_code", 3: "duplicate_code", 4: "invalid_data", 5: "invalid_data"
    }
    logs = done.logs.orderBy("note").collect()
    assert [(r["type"], r["product_id"], r["quantity"], r["note"]) for r in logs] == [
        ("create", None, 3, "Menambah produk Baru"), ("create", None, 0, "Menambah produk Ok")
    ]


def test_validate_batch_splits(frame):
    suppliers = frame("id int, name string, address string, phone string, email string", (1, "a", "b", "c", "d"), (2, "a", " ", "c", "d"))
    split = maintenance.validate_batch(suppliers, "suppliers")
    assert ids(split.valid) == [1] and ids(split.rejects) == [2]
    customers = frame("id int, name string, phone string, email string", (1, "a", "b", "c"), (2, None, "b", "c"))
    assert ids(maintenance.validate_batch(customers, "customers").valid) == [1]


# ---- stock lists ----


def test_count_log_shows_empty_sessions(frame):
    sessions = frame("id long, counted_at timestamp_ntz, staff_name string, note string", *[(i, None, None, None) for i in (1, 2, 3)])
    items = frame("id long, session_id long", (1, 1), (2, 3), (3, 3))
    assert [(r["id"], r["item_count"]) for r in stock.count_session_log(sessions, items, 2).collect()] == [(3, 2), (2, 0)]
    assert stock.count_session_log(sessions, items, None).count() == 3


def test_logs_of_one_second_come_newest_id_first(frame):
    at = datetime(2026, 5, 10, 8)
    logs = frame("id long, type string, product_id long, quantity long, note string, created_at timestamp_ntz",
                 (1, "sell", 1, 1, None, at), (3, "create", None, 1, None, at), (2, "sell", 1, 1, None, at))
    assert [r["id"] for r in stock.recent_logs(logs, 2).collect()] == [3, 2]
    assert {r["product"] for r in stock.log_display(logs).collect()} == {"1", "—"}


def test_count_sheet_starts_at_system_stock(products, frame):
    none = frame("id long, name string")
    sheet = stock.count_sheet(catalog.with_category_and_supplier(products, none, none))
    assert sheet.filter("systemStock <> countedStock OR difference <> 0").count() == 0
    assert sheet.filter("productId = 3").first()["systemStock"] == 0
