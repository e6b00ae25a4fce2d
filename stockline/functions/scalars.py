"""Scalar functions as Column expressions (no UDFs): cleaning, labels, money text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text of a number; the common case of it; code points that count as white space around it.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DIGITS_PATTERN = r"^\d{1,15}$"
SPACES = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
)
NO_BREAK_SPACE = chr(0xA0)

# Defaults for blank text.
DEFAULT_PAYMENT = "Tunai"
DEFAULT_CASHIER = "Kasir"
DEFAULT_STAFF = "Gudang"

# Stock levels and the texts shown for them.
LOW_STOCK = 5
TIER_OUT, TIER_LOW, TIER_SAFE = "Habis", "Akan habis", "Aman"
BADGE_LOW, BADGE_SAFE = "Stok rendah", "Stok aman"

# Log types and the labels shown for them; other types are shown as LOG_OTHER.
LOG_LABELS = {"sell": "Penjualan", "incoming": "Barang masuk", "delete": "Hapus produk"}
LOG_OTHER = "Aktivitas"


def trimmed(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def ensure_number(x: Column) -> Column:
    """Text as a finite double; anything else, NULL and blank included, is 0."""
    text = trimmed(x.cast("string"))
    value = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value).otherwise(0.0)


def whole_number(x: Column) -> Column:
    """ensure_number as a long; NULL when it has a fraction or does not fit.

    The patterns come first because a failing cast costs far more than a match.
    """
    text = trimmed(x.cast("string"))
    value = text.try_cast("double")
    whole = F.when(value == F.floor(value), value.try_cast("long"))
    finite = text.rlike(NUMBER_PATTERN) & (F.abs(value) < float("inf"))
    return F.when(text.rlike(DIGITS_PATTERN), text.try_cast("long")).when(finite, whole).otherwise(0)


def padded(key: Column, width: int) -> Column:
    """A whole number as text with leading zeros up to the width; longer numbers stay whole."""
    text = key.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def coalesce_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def text_or(x: Column, default: str | None) -> Column:
    """Trimmed text, or the default when nothing is left."""
    return F.coalesce(F.nullif(trimmed(x), F.lit("")), F.lit(default).cast("string"))


def first_text(*fields: Column, default: str) -> Column:
    """The first non-empty field decides, then it is trimmed: a field of spaces alone gives the default."""
    return text_or(F.coalesce(*[F.nullif(f, F.lit("")) for f in fields]), default)


def or_dash(x: Column, dash: str = "-") -> Column:
    return F.coalesce(F.nullif(x.cast("string"), F.lit("")), F.lit(dash))


def prefix(x: Column, n: int = 16) -> Column:
    return F.substring(x.cast("string"), 1, n)


def product_label(name: Column, product_id: Column) -> Column:
    shown_id = F.coalesce(product_id.cast("string"), F.lit("null"))
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("ID:"), shown_id))


def product_option_label(code: Column, name: Column, stock: Column) -> Column:
    return F.concat(
        or_dash(code, "—"), F.lit(" — "), or_dash(name, "Produk"),
        F.lit(" (Stok: "), coalesce_zero(stock).cast("string"), F.lit(")"),
    )


def low_stock_label(name: Column, stock: Column) -> Column:
    return F.concat(name, F.lit(" — "), coalesce_zero(stock).cast("string"), F.lit(" tersisa"))


def _grouped(x: Column) -> Column:
    return F.translate(F.format_number(x, 0), ",", ".")


def format_rp(x: Column) -> Column:
    """Rp 1.234.567"""
    return F.concat(F.lit("Rp "), _grouped(coalesce_zero(x)))


def format_idr(x: Column) -> Column:
    """Currency text: sign first, then Rp, a no-break space and the grouped digits."""
    value = coalesce_zero(x)
    return F.concat(F.when(value < 0, "-").otherwise(""), F.lit("Rp" + NO_BREAK_SPACE), _grouped(F.abs(value)))


def format_short(x: Column) -> Column:
    """0 / RpN / RpNK / RpN.NM; negative amounts are never shortened."""
    value = coalesce_zero(x)
    exact = value.cast("decimal(20,0)")
    millions = F.round(exact / F.lit(1_000_000).cast("decimal(10,0)"), 1).cast("string")
    thousands = F.round(exact / F.lit(1_000).cast("decimal(10,0)"), 0).cast("decimal(20,0)").cast("string")
    return (
        F.when(value == 0, "0")
        .when(value >= 1_000_000, F.concat(F.lit("Rp"), F.regexp_replace(millions, r"\.0$", ""), F.lit("M")))
        .when(value >= 1_000, F.concat(F.lit("Rp"), thousands, F.lit("K")))
        .otherwise(F.concat(F.lit("Rp"), value.cast("string")))
    )


def signed_text(x: Column) -> Column:
    return F.when(x > 0, F.concat(F.lit("+"), x.cast("string"))).otherwise(x.cast("string"))


def count_sign(x: Column) -> Column:
    return F.when(x == 0, "equal").when(x > 0, "over").when(x < 0, "short")


def stock_tier(stock: Column) -> Column:
    n = coalesce_zero(stock)
    return F.when(n <= 0, TIER_OUT).when(n <= LOW_STOCK, TIER_LOW).otherwise(TIER_SAFE)


def stock_badge(stock: Column) -> Column:
    return F.when(coalesce_zero(stock) <= LOW_STOCK, BADGE_LOW).otherwise(BADGE_SAFE)


def tier_rank(stock: Column) -> Column:
    """0 safe, 1 low, 2 out: the order of the stock board."""
    n = coalesce_zero(stock)
    return F.when(n > LOW_STOCK, 0).when(n > 0, 1).otherwise(2)


def log_label(log_type: Column) -> Column:
    label = F.lit(LOG_OTHER)
    for kind, text in LOG_LABELS.items():
        label = F.when(log_type == kind, text).otherwise(label)
    return label


def product_margin(sale_price: Column, purchase_price: Column) -> Column:
    return coalesce_zero(sale_price) - coalesce_zero(purchase_price)


def sell_note(quantity: Column, method: Column) -> Column:
    return F.concat(F.lit("Penjualan x"), quantity.cast("string"), F.lit(" (metode: "), method, F.lit(")"))


def incoming_note(quantity: Column, staff: Column) -> Column:
    return F.concat(F.lit("Barang masuk x"), quantity.cast("string"), F.lit(" (staff: "), staff, F.lit(")"))


def count_note(staff: Column, counted: Column) -> Column:
    return F.concat(F.lit("Stok opname ("), staff, F.lit("): "), counted.cast("string"))


def create_note(name: Column) -> Column:
    return F.concat(F.lit("Menambah produk "), name)


def delete_note(product_id: Column) -> Column:
    return F.concat(F.lit("Hapus produk #"), product_id.cast("string"))
