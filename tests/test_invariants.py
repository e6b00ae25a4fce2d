"""What must hold between operators, over whole star-schema tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stockline.operators import baskets, maintenance, sales, stock
from stockline.sources.star import StarTables


@pytest.fixture(scope="module")
def retail(spark):
    return StarTables(spark, "/root/testdata/sf0.001")


def total(df, column):
    return df.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0]


def test_product_sums_add_up_to_the_period(retail):
    lines = retail.sales_transactions()
    period = ("1998-01-01", "1999-06-30")
    by_product = sales.sales_by_product(lines, retail.products(), *period)
    finance = sales.period_finance(lines, *period).first()
    assert total(by_product, "total_revenue") == finance["periodGross"]
    assert total(by_product, "total_capital") == finance["periodCapital"]
    assert total(by_product, "total_profit") == finance["periodNet"]


def test_receipt_and_line_trends_agree_on_gross(retail):
    from_lines = sales.sales_trend(retail.sales_transactions()).select("day", "total_gross")
    from_receipts = sales.receipt_trend(retail.sales_receipts(), retail.sales_receipt_items()).select("day", "total_gross")
    assert sorted(map(tuple, from_lines.collect())) == sorted(map(tuple, from_receipts.collect()))


def test_checkouts(retail):
    products, lines, carts = retail.products(), retail.cart_lines(), retail.carts()
    loose = baskets.checkout_snapshot(products, lines, carts, "2026-05-10")
    strict = baskets.checkout_cumulative(products, lines, carts, "2026-05-10")
    assert loose.verdicts.count() == strict.verdicts.count() == carts.count()
    only_strict = strict.receipts.join(loose.receipts, "cart_id", "left_anti")
    assert only_strict.count() == 0 and strict.receipts.count() > 0
    refused = loose.verdicts.filter("NOT accepted").select("cart_id")
    assert loose.receipts.join(refused, "cart_id", "left_semi").count() == 0
    headers = loose.receipts
    assert sales.receipt_reconcile(headers, loose.items).filter("NOT balanced").count() == 0
    assert total(loose.sales, "total_price") == total(headers, "subtotal")
    ids = [r[0] for r in headers.select("id").orderBy("id").collect()]
    assert ids == list(range(1, len(ids) + 1))
    known = products.filter("stock IS NOT NULL")
    after = stock.apply_movements(products, loose.movements)
    assert total(after, "stock") == total(known, "stock") + total(loose.movements, "quantity")


def test_sold_stock_never_falls_below_zero(retail):
    sold = baskets.sell(retail.products(), retail.sell_requests(), "2026-05-10")
    after = stock.apply_movements(retail.products(), sold.movements)
    opening_debts = retail.products().filter("stock < 0").count()
    assert stock.oversold(after).count() == opening_debts
    assert sold.decisions.count() == retail.sell_requests().count()
    assert sold.logs.count() == sold.sales.count() == sold.decisions.filter("reason IS NULL").count()


def test_every_count_is_against_the_opening_stock(retail):
    done = maintenance.stock_count(retail.products(), retail.count_sessions(), retail.count_lines())
    counts = done.items.groupBy("product_id").agg(F.count("*").alias("n"), F.sum("counted_stock").alias("counted"))
    known = retail.products().filter("stock IS NOT NULL")
    opening = known.select(F.col("id").alias("product_id"), F.col("stock").alias("opening"))
    after = stock.apply_movements(known, done.movements).select(F.col("id").alias("product_id"), "stock")
    checked = after.join(counts, "product_id").join(opening, "product_id")
    assert checked.count() > 0 and checked.filter("stock <> counted - (n - 1) * opening").count() == 0
    assert done.sessions.count() + done.rejects.count() == retail.count_sessions().count()
