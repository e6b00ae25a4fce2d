"""Scalar functions on exact values."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from stockline.functions import dates as D
from stockline.functions import scalars as S


def values(spark, kind, inputs, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


def test_ensure_number(spark):
    text = ["12", " 12 ", "1e3", "2.5", ".5", "5.", "-3", "1d", "Infinity", "NaN", "abc", "", None, "1e999", "-1e999", chr(0xA0) + "7\t"]
    expected = [12.0, 12.0, 1000.0, 2.5, 0.5, 5.0, -3.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 7.0]
    assert values(spark, "string", text, S.ensure_number) == expected


def test_whole_number(spark):
    text = ["12", " 12 ", "1e3", "2.5", "17.0", "-3", "1d", "", None, "1e999", "1e30", "123456789012345678"]
    expected = [12, 12, 1000, None, 17, -3, 0, 0, 0, 0, None, 123456789012345680]
    got = values(spark, "string", text, S.whole_number)
    assert got[:-1] == expected[:-1] and abs(got[-1] - expected[-1]) < 100
    assert values(spark, "long", [5, None, -2], S.whole_number) == [5, 0, -2]


def test_text_defaults(spark):
    assert values(spark, "string", [" a ", "  ", None, "\t"], lambda x: S.text_or(x, "Tunai")) == ["a", "Tunai", "Tunai", "Tunai"]
    assert values(spark, "string", ["", None, "x"], S.or_dash) == ["-", "-", "x"]
    assert values(spark, "string", ["2026-05-10 11:22:33"], S.prefix) == ["2026-05-10 11:22"]


def test_first_text_takes_the_first_non_empty_field_and_then_trims(frame):
    rows = frame("a string, b string, c string, d string", ("", None, " Ani ", "x"), ("  ", "Budi", None, None), (None,) * 4)
    got = rows.select(S.first_text(*[F.col(c) for c in "abcd"], default="Gudang")).collect()
    assert [r[0] for r in got] == ["Ani", "Gudang", "Gudang"]


def test_money_text(spark):
    amounts = [0, 5, 1234567, -1234, None]
    assert values(spark, "long", amounts, S.format_rp) == ["Rp 0", "Rp 5", "Rp 1.234.567", "Rp -1.234", "Rp 0"]
    nbsp = chr(0xA0)
    assert values(spark, "long", amounts, S.format_idr) == [
        f"Rp{nbsp}0", f"Rp{nbsp}5", f"Rp{nbsp}1.234.567", f"-Rp{nbsp}1.234", f"Rp{nbsp}0"
    ]
    short = [0, 999, 1000, 1500, 2499, 999_999, 1_000_000, 1_250_000, 10_040_000, -5_000_000, None]
    assert values(spark, "long", short, S.format_short) == [
        "0", "Rp999", "Rp1K", "Rp2K", "Rp2K", "Rp1000K", "Rp1M", "Rp1.3M", "Rp10M", "Rp-5000000", "0"
    ]


def test_labels(spark, frame):
    assert values(spark, "long", [3, -2, 0, None], S.signed_text) == ["+3", "-2", "0", None]
    assert values(spark, "long", [3, -2, 0], S.count_sign) == ["over", "short", "equal"]
    stock = [-1, 0, 1, 5, 6, None]
    assert values(spark, "long", stock, S.stock_tier) == ["Habis", "Habis", "Akan habis", "Akan habis", "Aman", "Habis"]
    assert values(spark, "long", stock, S.stock_badge) == ["Stok rendah"] * 4 + ["Stok aman", "Stok rendah"]
    kinds = ["sell", "incoming", "delete", "create", "stock_opname", None]
    assert values(spark, "string", kinds, S.log_label) == ["Penjualan", "Barang masuk", "Hapus produk"] + ["Aktivitas"] * 3
    rows = frame("code string, name string, id long, stock long", ("A", "Kopi", 1, 4), (None, "", 7, None), ("", None, None, 2))
    label = rows.select(S.product_label(F.col("name"), F.col("id")), S.product_option_label(F.col("code"), F.col("name"), F.col("stock")))
    assert [tuple(r) for r in label.collect()] == [
        ("Kopi", "A — Kopi (Stok: 4)"), ("ID:7", "— — Produk (Stok: 0)"), ("ID:null", "— — Produk (Stok: 2)")
    ]


@pytest.mark.parametrize("preset, as_of, start, end", [
    ("today", date(2026, 5, 10), date(2026, 5, 10), date(2026, 5, 10)),
    ("thisWeek", date(2026, 5, 10), date(2026, 5, 4), date(2026, 5, 10)),  # a Sunday ends its week
    ("thisWeek", date(2026, 5, 11), date(2026, 5, 11), date(2026, 5, 17)),
    ("thisMonth", date(2028, 2, 29), date(2028, 2, 1), date(2028, 2, 29)),
    ("lastMonth", date(2026, 3, 31), date(2026, 2, 1), date(2026, 2, 28)),
    ("lastMonth", date(2026, 1, 15), date(2025, 12, 1), date(2025, 12, 31)),
    ("allTime", date(2026, 1, 15), None, None),
])
def test_date_presets(spark, preset, as_of, start, end):
    first, last = D.date_preset(preset, as_of)
    assert tuple(spark.range(1).select(first, last).first()) == (start, end)


def test_day_label_and_times(spark):
    assert values(spark, "date", [date(2026, 5, 8), date(2026, 8, 2)], D.day_label) == ["Jum, 08 Mei", "Min, 02 Agu"]
    stamp = [datetime(2026, 5, 8, 20, 30, 5)]
    assert values(spark, "timestamp_ntz", stamp, D.utc_day) == [date(2026, 5, 8)]
    assert values(spark, "timestamp_ntz", stamp, D.local_datetime) == ["2026-05-08 20:30:05"]
    assert values(spark, "timestamp_ntz", stamp, lambda x: D.local_datetime(x, "Asia/Jakarta")) == ["2026-05-09 03:30:05"]
