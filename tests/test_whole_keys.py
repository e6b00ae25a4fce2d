"""Keys and numbers stay whole: long codes, fractions, blank scans, ties, and one pass per report."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockline.functions import scalars as S
from stockline.operators import catalog, maintenance, sales
from stockline.operators.scale import broadcastable, lookup_join

PRODUCTS = (
    "id long, code string, name string, category_id long, unit string, purchase_price long, sale_price long, "
    "stock long, entry_date date, storage_location string, supplier_id long"
)


def product(i: int, code: str | None) -> tuple:
    return (i, code, f"name {i}", 1, "pcs", 10, 20, 5, None, "Rak", 1)


def test_long_keys_keep_all_digits(frame):
    keys = [7, 123456, 1234560, 1234567, 123456789]
    found = frame("k long", *[(k,) for k in keys], (None,)).select(S.padded(F.col("k"), 6)).collect()
    assert [r[0] for r in found] == ["000007", "123456", "1234560", "1234567", "123456789", None]


def test_long_codes_find_their_own_product(frame):
    products = frame(PRODUCTS, product(1, "BRG-1234560"), product(2, "BRG-1234567"), product(3, "BRG-123456"))
    scans = frame("code string", ("brg-1234567",), (" brg-1234560",), ("brg-123456",))
    found = {r.code.strip(): r.product_id for r in catalog.lookup_code(products, scans).collect()}
    assert found == {"brg-1234567": 2, "brg-1234560": 1, "brg-123456": 3}


def test_a_blank_scan_is_missed(frame):
    products = frame(PRODUCTS, product(1, ""), product(2, None), product(3, "A"))
    scans = frame("code string", ("  ",), ("a",), (None,))
    assert [r.product_id for r in catalog.lookup_code(products, scans).orderBy("code").collect()] == [None, None, 3]
    assert {r.code for r in catalog.missed_codes(products, scans).collect()} == {"  ", None}


def test_fractions_are_refused_with_a_reason(frame):
    products = frame(PRODUCTS, product(1, "A"))
    schema = "seq long, code string, name string, category_id long, unit string, purchase_price string, stock string"
    batch = frame(
        schema, (1, "N1", "n", 1, "pcs", "1500.5", "2"), (2, "N2", "n", 1, "pcs", "1500", "2.5"),
        (3, "N3", "n", 1, "pcs", "1500.0", "1e2"),
    )
    created = maintenance.create_products(products, batch)
    assert [(r.code, r.purchase_price, r.stock) for r in created.products.collect()] == [("N3", 1500, 100)]
    assert {(r.seq, r.reject_reason) for r in created.rejects.collect()} == {(1, "invalid_data"), (2, "invalid_data")}


def test_a_fractional_change_is_refused_and_ties_are_settled(frame):
    products = frame(PRODUCTS, product(1, "A"), product(2, "B"))
    changes = frame(
        "id long, seq long, name string, sale_price string",
        (1, 1, "first", "30"), (1, 2, "second", "30.5"), (2, 5, "b", "7"), (2, 5, "a", "7"),
    )
    found = {r.id: (r.name, r.sale_price) for r in maintenance.upsert(products, changes, "products").collect()}
    assert found == {1: ("first", 30), 2: ("b", 7)}
    assert [(r.id, r.seq) for r in maintenance.refused_changes(changes).collect()] == [(1, 2)]


def test_total_without_known_profit_is_zero(frame):
    lines = frame(
        "product_id long, quantity long, total_price long, purchase_price long, profit_per_unit long, date date",
        (1, 2, 20, None, None, None),
    )
    report = sales.product_report_with_total(lines, frame(PRODUCTS, product(1, "A"))).collect()
    assert {(r.label, r.total_profit) for r in report} == {("name 1", None), ("TOTAL", 0)}


def test_newest_lines_when_most_receipts_are_gone(frame, monkeypatch):
    monkeypatch.setattr(sales, "NEWEST_SLICE", 200)
    items = frame(
        "id long, receipt_id long, product_id long, quantity long, total_price long, product_name string",
        *[(i, i, 1, 1, 1, "x") for i in range(1000)],
    )
    for kept in ({3, 5}, set(range(990, 1000)), set(), set(range(900, 905))):
        receipts = frame("id long", *[(i,) for i in sorted(kept)]) if kept else frame("id long", (5000,))
        found = [r.id for r in sales.recent_sales_receipts(receipts, items, 4).collect()]
        assert found == sorted(kept, reverse=True)[:4]


def test_broadcasts_are_bounded_in_rows_and_bytes(frame, monkeypatch):
    from stockline.operators import scale

    dim = frame("k long, name string", (1, "x" * 100), (2, None))
    assert broadcastable(dim) and not broadcastable(dim, 1) and not broadcastable(dim, 0)
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 50)
    assert not broadcastable(dim)
    facts = frame("k long", (1,), (3,))
    assert {(r.k, r.name is None) for r in lookup_join(facts, dim, ["k"]).collect()} == {(1, False), (3, True)}
