"""The ways for heavy keys give the same rows as the plain ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stockline.operators import baskets, sales
from stockline.operators.scale import heavy_keys, lookup_join, running_totals
from stockline.sources.tables import append_rows


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture
def skewed(spark):
    """A third of the rows has key 1 and a sixth has none; key 99 is in no dimension."""
    rng = random.Random(7)
    keys = [1] * 400 + [None] * 200 + [rng.choice([2, 3, 4, 5, 6, 99]) for _ in range(600)]
    rng.shuffle(keys)
    rows = [(i, k, rng.randint(1, 9)) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "id long, k long, v long")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_has_one_result_on_all_ways(spark, skewed, how):
    dim = spark.createDataFrame([(k, f"name {k}") for k in range(1, 7)], "k long, name string")
    expected = rows_of(skewed.join(dim, "k", how))
    by_broadcast = lookup_join(skewed, dim, ["k"], how)
    by_shuffle = lookup_join(skewed, dim, ["k"], how, broadcast_rows=0)
    by_split = lookup_join(skewed, dim, ["k"], how, broadcast_rows=0, heavy_rows=150)
    assert rows_of(by_broadcast) == rows_of(by_shuffle) == rows_of(by_split) == expected


def test_heavy_keys(skewed):
    assert heavy_keys(skewed, ["k"]) is None
    assert {r[0] for r in heavy_keys(skewed, ["k"], 150).collect()} == {1, None}


def test_nearly_unique_keys_are_not_counted_one_by_one(spark, monkeypatch):
    """One key has half the rows; the others, all different, are never grouped by key."""
    frame, grouped = type(spark.range(0)), []
    plain = frame.groupBy
    monkeypatch.setattr(frame, "groupBy", lambda self, *by: grouped.append((by, self)) or plain(self, *by))
    rows = spark.range(6000).select(F.when(F.col("id") < 3000, -1).otherwise(F.col("id")).alias("k"), F.lit("x").alias("j"))
    assert [tuple(r) for r in heavy_keys(rows, ["k", "j"], 2000).collect()] == [(-1, "x")]
    assert [by for by, _ in grouped] == [("_slot",), ("k", "j")]
    assert plain(grouped[1][1]).count().first()[0] < 3200  # the heavy key's slot
    grouped.clear()
    assert heavy_keys(rows, ["k", "j"], 3000) is None and len(grouped) == 1


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("direction", [F.asc, F.desc])
def test_running_totals_in_slices_equal_brute_force(skewed, keys, direction):
    order = [direction("v"), F.asc("id")]
    totals = {"run": F.col("v"), "nth": F.lit(1).cast("long")}
    got = running_totals(skewed, keys, order, totals, heavy_rows=50, slices=7)
    sign = 1 if direction is F.asc else -1
    expected, sums = [], {}
    for i, k, v in sorted(map(tuple, skewed.collect()), key=lambda r: (sign * r[2], r[0])):
        group = k if keys else "all"
        total, count = sums.get(group, (0, 0))
        sums[group] = (total + v, count + 1)
        expected.append((i, k, v, *sums[group]))
    assert rows_of(got.select("id", "k", "v", "run", "nth")) == sorted(map(repr, expected))


def test_append_rows_in_slices_numbers_without_gaps(spark, skewed):
    target = spark.createDataFrame([(41,), (7,)], "id long")
    batch = skewed.select(F.col("id").alias("seq"), "v")
    got = append_rows(target, batch, [F.col("seq")], heavy_rows=10, slices=5).orderBy("id").collect()
    assert [(r["id"], r["seq"]) for r in got] == [(42 + i, i) for i in range(1200)]


def _requests(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice([1] * 6 + [2, 3, 4, 77, None]), str(rng.choice([1, 2, 5, 9, 30, 0, 400]))) for i in range(900)]
    frame = spark.createDataFrame(rows, "seq long, product_id long, quantity string")
    return rows, frame.withColumn("shop", F.lit("north"))  # a column the job does not know is kept


def _products(spark):
    rows = [(1, 500, 10), (2, 90, 20), (3, None, 30), (4, 31, None)]
    return rows, spark.createDataFrame(
        [(i, f"C{i}", f"P{i}", "pcs", 5, price, stock) for i, stock, price in rows],
        "id long, code string, name string, unit string, purchase_price long, sale_price long, stock long",
    )


@pytest.mark.parametrize("ways", [{}, {"heavy_rows": 40, "slices": 6}, {"heavy_rows": 0, "slices": 3}])
def test_sell_equals_one_request_after_the_other(spark, ways):
    request_rows, requests = _requests(spark)
    product_rows, products = _products(spark)
    left = {i: stock or 0 for i, stock, _ in product_rows}
    expected = {}
    for seq, product, text in request_rows:
        quantity = int(text)
        if not product or quantity <= 0:
            expected[seq] = "bad_item"
        elif product not in left:
            expected[seq] = "unknown_product"
        elif left[product] < quantity:
            expected[seq] = "not_enough_stock"
        else:
            left[product] -= quantity
            expected[seq] = None
    decided = baskets.sell_decisions(products, requests, **ways)
    assert {r["seq"]: r["reason"] for r in decided.collect()} == expected
    assert decided.filter("shop = 'north'").count() == len(request_rows)


def _one_after_the_other(stock, quantities):
    taken = []
    for quantity in quantities:
        taken.append(0 < quantity <= stock)
        stock -= quantity if taken[-1] else 0
    return taken


SLICED = {"heavy_rows": 100, "slices": 5}


@pytest.mark.parametrize(
    ("stock", "ways"), [*((n, {}) for n in (0, 1, 2, 3, 8, 1000, 2_000_003)), (7, SLICED), (1000, SLICED)]
)
def test_sell_by_halving_on_random_requests(spark, stock, ways):
    rng = random.Random(stock)
    quantities = [max(1, int(stock * rng.random() ** rng.choice([1, 4, 12]))) for _ in range(400)] + [stock + 1, 1, 1]
    rows = [(1, i, str(q)) for i, q in enumerate(quantities)] + [(2, 0, "1")]
    requests = spark.createDataFrame(rows, "product_id long, seq long, quantity string")
    products = spark.createDataFrame(
        [(1, "C", "P", "pcs", 5, 9, stock), (2, "D", "Q", "pcs", 5, 9, -4)],
        "id long, code string, name string, unit string, purchase_price long, sale_price long, stock long",
    )
    decided = baskets.sell_decisions(products, requests, **ways).collect()
    got = [r["reason"] is None for r in sorted(decided, key=lambda r: (r["product_id"], r["seq"]))]
    assert got == [*_one_after_the_other(stock, quantities), False]


def test_sell_takes_as_many_rounds_as_the_stock_has_digits(spark, monkeypatch):
    """10,000 different quantities of one product, which used to take a round each."""
    quantities = list(range(10_000, 0, -1))
    random.Random(5).shuffle(quantities)
    stock, rounds = 3_000_000, []
    requests = spark.createDataFrame(
        [(1, i, str(q)) for i, q in enumerate(quantities)], "product_id long, seq long, quantity string"
    )
    products = spark.createDataFrame(
        [(1, "C", "P", "pcs", 5, 9, stock)],
        "id long, code string, name string, unit string, purchase_price long, sale_price long, stock long",
    )
    plain = baskets.running_totals
    monkeypatch.setattr(baskets, "running_totals", lambda *args: rounds.append(1) or plain(*args))
    decided = baskets.sell_decisions(products, requests, heavy_rows=1000, slices=4).collect()
    assert [r["reason"] is None for r in sorted(decided, key=lambda r: r["seq"])] == _one_after_the_other(stock, quantities)
    assert len(rounds) <= stock.bit_length() + 1


def test_cumulative_check_of_a_cart_with_very_many_lines(spark):
    _, products = _products(spark)
    rows = [(1, i, 1, "1") for i in range(600)] + [(2, 1, 1, "1")]
    lines = spark.createDataFrame(rows, "cart_id long, line long, product_id long, quantity string")
    plain = baskets.cumulative_cart_check(lines, products)
    sliced = baskets.cumulative_cart_check(lines, products, heavy_rows=100, slices=6)
    assert rows_of(plain) == rows_of(sliced)
    assert sliced.filter("cart_id = 1 AND reason IS NULL").count() == 500


def test_a_long_receipt_continues_on_further_pages(spark):
    receipts = spark.createDataFrame(
        [(1, None, "Ani", "Tunai", 250, 250), (2, None, None, "QRIS", 3, 3), (3, None, "B", "QRIS", 0, 0)],
        "id long, date date, cashier_name string, payment_method string, subtotal long, total_items long",
    )
    items = spark.createDataFrame(
        [(i, 1, 9, 1, 1, 1, "x") for i in range(250)] + [(900 + i, 2, 9, 1, 1, 1, "y") for i in range(3)],
        "id long, receipt_id long, product_id long, quantity long, price long, total_price long, product_name string",
    )
    for ways in ({}, {"heavy_rows": 20, "slices": 4}):
        pages = sales.receipt_document(receipts, items, page_size=100, **ways).orderBy("receipt_id", "page").collect()
        sizes = [(p["receipt_id"], p["page"], p["page_lines"]) for p in pages]
        assert sizes == [(1, 0, 100), (1, 1, 100), (1, 2, 50), (2, 0, 3), (3, 0, 0)]
        assert [x["id"] for p in pages if p["receipt_id"] == 1 for x in p["items"]] == list(range(250))
        assert pages[3]["cashier_name"] == "-" and pages[4]["items"] == []
