"""Baskets: pricing, stock checks, checkout, and sales accepted in arrival order."""

from __future__ import annotations

from datetime import date
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockline.functions import scalars as S
from stockline.functions.dates import as_day
from stockline.operators.scale import checkpointed, heavy_keys, lookup_join, running_totals, split_heavy, written

# Why a line, request or cart is refused.
BAD_ITEM = "bad_item"
UNKNOWN_PRODUCT = "unknown_product"
NOT_ENOUGH_STOCK = "not_enough_stock"
EMPTY_CART = "empty_cart"
LINE_REASONS = [BAD_ITEM, NOT_ENOUGH_STOCK, UNKNOWN_PRODUCT]

# What a checkout keeps of a checked line.
CHECKED = [
    "cart_id", "line", "product_id", "quantity", "price", "purchase_price", "product_code", "product_name", "unit", "reason",
]

# Phases of a sale (see sell_decisions) that one stage of windows works out before its rows are written.
PHASES_AT_ONCE = 10


class Checkout(NamedTuple):
    """Frames to write after a batch of carts. Ids of items, sales and logs are given on append.

    The cumulative form writes no sale rows (sales is None): its sales are the items of its receipts.
    """

    verdicts: DataFrame
    receipts: DataFrame
    items: DataFrame
    sales: DataFrame | None
    logs: DataFrame
    movements: DataFrame


class Sold(NamedTuple):
    decisions: DataFrame
    sales: DataFrame
    logs: DataFrame
    movements: DataFrame


# ---- pricing ----


def priced_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines with the product snapshot, whole quantity, amounts, and the refusals that need no stock."""
    catalog = products.select(
        F.col("id").alias("product_id"),
        F.col("code").alias("product_code"),
        F.col("name").alias("product_name"),
        "unit",
        S.coalesce_zero(F.col("stock")).alias("stock"),
        S.coalesce_zero(F.col("sale_price")).alias("price"),
        S.coalesce_zero(F.col("purchase_price")).alias("purchase_price"),
        F.lit(True).alias("found"),
    )
    counted = lines.withColumn("quantity", S.whole_number(F.col("quantity")))
    joined = lookup_join(counted, catalog, ["product_id"])
    usable = (S.coalesce_zero(F.col("product_id")) != 0) & (S.coalesce_zero(F.col("quantity")) > 0)
    reason = F.when(~usable, BAD_ITEM).when(F.col("found").isNull(), UNKNOWN_PRODUCT)
    return _with_amounts(joined.withColumn("reason", reason).drop("found"))


def _with_amounts(lines: DataFrame) -> DataFrame:
    """Amounts of a line from its price, cost and quantity."""
    profit = F.col("price") - F.col("purchase_price")
    return lines.select(
        "*",
        F.col("price").alias("sale_price"),
        profit.alias("profit_per_unit"),
        (F.col("price") * F.col("quantity")).alias("total_price"),
        (profit * F.col("quantity")).alias("profit"),
    )


def _short(left: Column) -> Column:
    return F.coalesce("reason", F.when(left < F.col("quantity"), NOT_ENOUGH_STOCK)).alias("reason")


def snapshot_check(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Every line against the opening stock: one product on two lines of a cart can oversell."""
    priced = priced_lines(lines, products)
    return priced.select(*[c for c in priced.columns if c != "reason"], _short(F.col("stock")))


def cumulative_cart_check(
    lines: DataFrame, products: DataFrame, heavy_rows: int | None = None, slices: int | None = None
) -> DataFrame:
    """Every line against what earlier lines of its cart left: adds stock_left, before the line."""
    priced = priced_lines(lines, products)
    taken = F.greatest(S.coalesce_zero(F.col("quantity")), F.lit(0))
    order = [F.col("line"), F.col("quantity")]
    running = running_totals(
        priced, ["cart_id", "product_id"], order, {"taken": taken}, heavy_rows, slices, sized_by=lines.select("cart_id")
    )
    left = F.col("stock") - (F.col("taken") - taken)
    return running.select(
        *[c for c in priced.columns if c != "reason"], left.alias("stock_left"), _short(left)
    )


def live_cart_stock(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Cart lines with the stock of today, else the copy the line carries, else 0."""
    live = products.select(F.col("id").alias("product_id"), F.col("stock").alias("_live"))
    joined = lookup_join(lines, live, ["product_id"])
    shown = F.coalesce("_live", "stock", F.lit(0))
    return joined.select(*[shown.alias(c) if c == "stock" else F.col(c) for c in lines.columns])


# ---- totals ----


def _basket_sums() -> list[Column]:
    return [
        F.coalesce(F.sum("total_price"), F.lit(0)).alias("subtotal"),
        F.coalesce(F.sum("quantity"), F.lit(0)).alias("total_items"),
        F.count(F.lit(1)).alias("line_count"),
        F.coalesce(F.sum(F.col("purchase_price") * F.col("quantity")), F.lit(0)).alias("cost"),
        F.coalesce(F.sum("profit"), F.lit(0)).alias("profit"),
    ]


def basket_totals(priced: DataFrame) -> DataFrame:
    """Per cart: money, pieces (for the receipt), lines (for the screen), cost and profit."""
    return priced.groupBy("cart_id").agg(*_basket_sums())


def basket_discount_tax(totals: DataFrame, discount: Column, tax: Column) -> DataFrame:
    """Percent discount, then percent tax on the rest; neither result falls below 0."""
    subtotal = F.col("subtotal").cast("decimal(20,0)")
    zero = F.lit(0).cast("decimal(38,8)")
    rate_off, rate_tax = discount.cast("decimal(9,2)"), tax.cast("decimal(9,2)")
    hundred = F.lit(100).cast("decimal(3,0)")
    rest = F.greatest(zero, (subtotal * (hundred - rate_off) / hundred).cast("decimal(38,8)"))
    total = F.greatest(zero, (rest.cast("decimal(24,4)") * (hundred + rate_tax) / hundred).cast("decimal(38,8)"))
    return totals.select(
        "*", rest.cast("double").alias("discounted"), total.cast("double").alias("grand_total")
    )


# ---- checkout ----


def cart_verdicts(checked: DataFrame, carts: DataFrame) -> DataFrame:
    """One row per cart: accepted or not, the reason of its first refused line, and its totals."""
    first_lines = [F.min(F.when(F.col("reason") == r, F.col("line"))).alias(f"_{r}") for r in LINE_REASONS]
    judged = checked.groupBy("cart_id").agg(*first_lines, *_basket_sums())
    first_line = F.least(*[F.col(f"_{r}") for r in LINE_REASONS])
    first_reason = F.coalesce(*[F.when(F.col(f"_{r}") == first_line, r) for r in LINE_REASONS])
    joined = carts.select(
        "cart_id",
        S.text_or(F.col("payment_method"), S.DEFAULT_PAYMENT).alias("payment_method"),
        S.text_or(F.col("cashier_name"), S.DEFAULT_CASHIER).alias("cashier_name"),
    ).join(judged, "cart_id", "left")
    reason = F.when(F.col("line_count").isNull(), EMPTY_CART).otherwise(first_reason)
    accepted = reason.isNull()
    return joined.select(
        "cart_id", "payment_method", "cashier_name", accepted.alias("accepted"), reason.alias("reason"),
        *[F.when(accepted, F.col(c)).alias(c) for c in ("subtotal", "total_items", "cost", "profit")],
    )


def accepted_receipts(
    verdicts: DataFrame, day: str | date | Column, last_receipt_id: int = 0,
    heavy_rows: int | None = None, slices: int | None = None,
) -> DataFrame:
    """Receipt headers of the accepted carts, numbered in cart order after last_receipt_id."""
    accepted = verdicts.filter("accepted").drop("accepted", "reason", "cost", "profit")
    numbered = running_totals(accepted, [], [F.col("cart_id")], {"nth": F.lit(1).cast("long")}, heavy_rows, slices)
    return numbered.select(
        (F.col("nth") + F.lit(last_receipt_id)).alias("id"), as_day(day).alias("date"),
        "cashier_name", "payment_method", "subtotal", "total_items", "cart_id",
    )


def _checkout(
    checked: DataFrame, carts: DataFrame, day: str | date | Column, last_receipt_id: int, with_sales: bool
) -> Checkout:
    # Six frames are read from the checked lines, so they are worked out once; their lines meet the headers once. What follows from
    # other columns is not written, and of refused lines only those meet the headers that an accepted cart may have: without a number.
    checked = _with_amounts(written(checked.select(*CHECKED)))
    verdicts = written(cart_verdicts(checked, carts))
    receipts = written(accepted_receipts(verdicts, day, last_receipt_id))
    headers = receipts.select("cart_id", F.col("id").alias("receipt_id"), "date", "cashier_name", "payment_method")
    sold = written(lookup_join(checked.filter("reason IS NULL OR line IS NULL"), headers, ["cart_id"], "inner"))
    items = sold.select(
        "receipt_id", "line", "product_id", "quantity", "price", "total_price",
        "product_code", "product_name", "unit", "purchase_price", "sale_price", "profit_per_unit",
    )
    sales = _sale_rows(sold) if with_sales else None
    return Checkout(verdicts, receipts, items, sales, _sell_logs(sold), _sell_movements(sold))


def checkout_snapshot(
    products: DataFrame, lines: DataFrame, carts: DataFrame, day: str | date | Column, last_receipt_id: int = 0
) -> Checkout:
    """All carts against the opening stock, line by line; one bad line refuses its cart."""
    return _checkout(snapshot_check(lines, products), carts, day, last_receipt_id, with_sales=True)


def checkout_cumulative(
    products: DataFrame, lines: DataFrame, carts: DataFrame, day: str | date | Column, last_receipt_id: int = 0
) -> Checkout:
    """As checkout_snapshot, but stock falls line by line inside a cart, and no sale rows are written."""
    return _checkout(cumulative_cart_check(lines, products), carts, day, last_receipt_id, with_sales=False)


def _sale_rows(sold: DataFrame) -> DataFrame:
    return sold.select(
        "date", "cashier_name", "product_id", "quantity", "price", "total_price", "payment_method",
        "product_code", "product_name", "unit", "purchase_price", "sale_price", "profit_per_unit",
    )


def _sell_logs(sold: DataFrame) -> DataFrame:
    note = S.sell_note(F.col("quantity"), F.col("payment_method"))
    return sold.select(F.lit("sell").alias("type"), "product_id", "quantity", note.alias("note"))


def _sell_movements(sold: DataFrame) -> DataFrame:
    return sold.select("product_id", (-F.col("quantity")).alias("quantity"))


# ---- single sales in arrival order ----


def sell_decisions(
    products: DataFrame, requests: DataFrame, heavy_rows: int | None = None, slices: int | None = None
) -> DataFrame:
    """Requests (seq, product_id, quantity, ...) with a reason where refused.

    A request is taken if the stock left by the requests taken before it is enough; a refused one uses none. This goes by
    phases that halve the stock. While at least half of a phase's stock is left, every request of up to half of it is
    taken, so what is left is its running sum away. The phase ends at the first request that brings the rest under half:
    by that sum, or by being larger than half and still fitting. Larger ones before it do not fit and are refused. So a
    product takes as many phases as its stock has binary digits, whatever its requests are, and gathers them nowhere.

    Products are settled in one shuffle, phase after phase over the same sorted rows. Those with more than heavy_rows
    requests are settled in rounds, one phase each, in which running sums are split into slices.
    """
    priced = priced_lines(requests, products)
    named = requests.filter(S.coalesce_zero(F.col("product_id")) != 0).select("product_id")
    heavy = heavy_keys(named, ["product_id"], heavy_rows)
    phases = int(products.agg(F.max("stock")).first()[0] or 0).bit_length()
    if heavy is None:
        return _settled_in_groups(priced, phases)
    hot, rest = split_heavy(priced, ["product_id"], heavy)
    return _settled_in_groups(rest, phases).unionByName(_settled_in_rounds(hot, heavy_rows, slices))


def _half() -> Column:
    return F.shiftright("_left", 1)


def _small() -> Column:
    return F.col("quantity") <= _half()


def _ends_phase() -> Column:
    """Whether a request brings what is left under half, given _run, the sum of the small ones up to and with it."""
    return F.when(_small(), F.col("_run") > _half()).otherwise(F.col("quantity") <= F.col("_left") - F.col("_run"))


def _used() -> Column:
    """What a phase that ends at this request has used."""
    return F.col("_run") + F.when(_small(), 0).otherwise(F.col("quantity"))


def _settled_in_groups(priced: DataFrame, phases: int) -> DataFrame:
    """All phases over one layout by product; rows that are refused already are spread, as they may be of one product."""
    refused = F.col("reason").isNotNull()
    group = Window.partitionBy("product_id", "_spread")
    in_order = group.orderBy("seq", "quantity")
    up_to_here = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    frame = priced.withColumns({
        "_spread": F.when(refused, F.pmod(F.xxhash64("seq", "quantity"), F.lit(1 << 16))).otherwise(-1),
        "_left": F.greatest("stock", F.lit(0)), "_open": ~refused, "_taken": F.lit(False),
    })
    frame = frame.withColumn("_at", F.row_number().over(in_order))
    opened, at_cut = F.col("_open"), F.col("_at") == F.col("_cut._at")
    over = F.col("_cut").isNull() | (F.col("_at") <= F.col("_cut._at"))
    for phase in range(phases):
        if phase and phase % PHASES_AT_ONCE == 0:
            frame = checkpointed(frame)
        frame = frame.withColumn("_run", F.sum(F.when(opened & _small(), F.col("quantity")).otherwise(0)).over(up_to_here))
        end = F.when(opened & _ends_phase(), F.struct("_at", _used().alias("used")))
        frame = frame.withColumn("_cut", F.min(end).over(group))
        frame = frame.withColumns({
            "_taken": F.col("_taken") | (opened & over & (_small() | F.coalesce(at_cut, F.lit(False)))),
            "_open": opened & ~over, "_left": F.col("_left") - F.coalesce("_cut.used", F.lit(0)),
        }).drop("_run", "_cut")
    reason = F.coalesce("reason", F.when(~F.col("_taken"), NOT_ENOUGH_STOCK))
    return frame.withColumn("reason", reason).select(*priced.columns)


def _settled_in_rounds(priced: DataFrame, heavy_rows: int | None, slices: int | None) -> DataFrame:
    """A phase per round, for products whose requests are too many for one task."""
    columns = priced.columns
    done = [priced.filter("reason IS NOT NULL")]
    open_rows = priced.filter("reason IS NULL").withColumn("_left", F.greatest("stock", F.lit(0)))
    pending = checkpointed(open_rows.withColumn("_id", F.monotonically_increasing_id()))
    order = [F.col("seq"), F.col("quantity"), F.col("_id")]
    while True:
        fits = pending.filter(F.col("quantity") <= F.col("_left"))
        done.append(pending.filter(F.col("quantity") > F.col("_left")).withColumn("reason", F.lit(NOT_ENOUGH_STOCK)))
        taken = F.when(_small(), F.col("quantity")).otherwise(0)
        running = checkpointed(running_totals(fits, ["product_id"], order, {"_run": taken}, heavy_rows, slices))
        if running.isEmpty():
            break
        cuts = running.filter(_ends_phase()).groupBy("product_id").agg(
            F.min(F.struct(*order, _used().alias("used"))).alias("_cut")
        )
        judged = lookup_join(running, cuts, ["product_id"])
        here, cut = F.struct(*order), F.struct(*[F.col(f"_cut.{c}") for c in ("seq", "quantity", "_id")])
        over = F.col("_cut").isNull() | (here <= cut)
        taken = _small() | (F.col("_cut").isNotNull() & (here == cut))
        done.append(judged.filter(over).withColumn("reason", F.when(~taken, NOT_ENOUGH_STOCK)))
        left = F.col("_left") - F.col("_cut.used")
        pending = checkpointed(judged.filter(~over).withColumn("_left", left).select(*columns, "_left", "_id"))
    return reduce(DataFrame.unionByName, [part.select(*columns) for part in done])


def sell(products: DataFrame, requests: DataFrame, day: str | date | Column) -> Sold:
    """Single-product sales, first come first served per product."""
    decisions = checkpointed(sell_decisions(products, requests))
    sold = decisions.filter("reason IS NULL").withColumns({
        "date": as_day(day),
        "payment_method": S.text_or(F.col("payment_method"), S.DEFAULT_PAYMENT),
        "cashier_name": S.text_or(F.col("cashier_name"), S.DEFAULT_CASHIER),
    })
    return Sold(decisions, _sale_rows(sold), _sell_logs(sold), _sell_movements(sold))
