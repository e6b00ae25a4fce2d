"""Sales analytics: day filters, daily figures, trends, product rankings, receipts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockline.functions import scalars as S
from stockline.functions.dates import as_day, day_label
from stockline.operators.scale import checkpointed, lookup_join, running_totals

Day = str | date | Column

# Lines collected at most while the newest ones with a receipt are looked for.
NEWEST_SLICE = 30_000


def _sum0(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0))


def _times_quantity(name: str) -> Column:
    return F.col(name) * F.col("quantity")


def sales_on(sales: DataFrame, day: Day) -> DataFrame:
    return sales.filter(F.col("date") == as_day(day))


def sales_between(sales: DataFrame, start: Day | None = None, end: Day | None = None) -> DataFrame:
    """Inclusive at both ends; one end alone is no filter."""
    if start is None or end is None:
        return sales
    return sales.filter(F.col("date").between(as_day(start), as_day(end)))


def latest_day(sales: DataFrame) -> date | None:
    return sales.agg(F.max("date")).first()[0]


# ---- one-row figures ----


def entity_counts(products: DataFrame, users: DataFrame, customers: DataFrame) -> DataFrame:
    """totalProducts, totalUsers, totalCustomers in one row."""
    named = {"totalProducts": products, "totalUsers": users, "totalCustomers": customers}
    tall = None
    for name, table in named.items():
        one = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        tall = one if tall is None else tall.unionByName(one)
    return tall.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in named])


def daily_kpis(sales: DataFrame, as_of: Day) -> DataFrame:
    """Figures of one day from sale lines; zeros on a day without sales."""
    return sales_on(sales, as_of).agg(
        _sum0(F.col("total_price")).alias("todaySales"),
        _sum0(F.col("total_price")).alias("todayGrossRevenue"),
        _sum0(_times_quantity("purchase_price")).alias("todayCapitalCost"),
        _sum0(_times_quantity("profit_per_unit")).alias("todayNetProfit"),
    )


def item_sums_by_receipt(items: DataFrame) -> DataFrame:
    """Money and pieces per receipt: lines meet their header one to one, however many a receipt has."""
    return items.groupBy("receipt_id").agg(
        F.sum("total_price").alias("items_subtotal"), F.sum("quantity").alias("items_quantity")
    )


def _dated_lines(receipts: DataFrame, items: DataFrame) -> DataFrame:
    """Cost and profit of the lines of these receipts; a few receipts are broadcast, so other lines fall away early."""
    headers = receipts.select(F.col("id").alias("receipt_id"), "date")
    lines = items.select(
        "receipt_id", _times_quantity("purchase_price").alias("capital"), _times_quantity("profit_per_unit").alias("net")
    )
    return lookup_join(lines, headers, ["receipt_id"], "inner")


def daily_kpis_receipts(receipts: DataFrame, items: DataFrame, as_of: Day) -> DataFrame:
    """Figures of one day from receipts: gross from headers, cost and profit from their lines."""
    today = sales_on(receipts, as_of)
    nothing = F.lit(None).cast("long")
    gross = today.select("subtotal", nothing.alias("capital"), nothing.alias("net"))
    costs = _dated_lines(today, items).select(nothing.alias("subtotal"), "capital", "net")
    return gross.unionByName(costs).agg(
        _sum0(F.col("subtotal")).alias("todaySales"),
        _sum0(F.col("subtotal")).alias("todayGrossRevenue"),
        _sum0(F.col("capital")).alias("todayCapitalCost"),
        _sum0(F.col("net")).alias("todayNetProfit"),
    )


def period_finance(sales: DataFrame, start: Day | None = None, end: Day | None = None) -> DataFrame:
    """Totals of a period. totalTransactions counts lines; net is not gross minus capital where cost is unknown."""
    return sales_between(sales, start, end).agg(
        _sum0(F.col("total_price")).alias("periodGross"),
        _sum0(_times_quantity("profit_per_unit")).alias("periodNet"),
        _sum0(S.coalesce_zero(F.col("purchase_price")) * F.col("quantity")).alias("periodCapital"),
        F.count(F.lit(1)).alias("totalTransactions"),
    )


# ---- trends ----


def latest_days(df: DataFrame, day: str, n: int) -> DataFrame:
    """The rows of the latest n days that occur (rows without a day count as the oldest).

    Finds the n days first, reading that column alone, so the filter on them reaches the scan: with a table laid
    out by day only those days are read.
    """
    found = [r[0] for r in df.select(day).distinct().orderBy(F.desc(day)).limit(n).collect()]  # at most n values
    wanted = F.col(day).isin([d for d in found if d is not None])
    return df.filter(wanted | F.col(day).isNull() if None in found else wanted)


def sales_trend(sales: DataFrame, n: int = 7) -> DataFrame:
    """The latest n days that have sales, from sale lines."""
    return latest_days(sales, "date", n).groupBy(F.col("date").alias("day")).agg(
        F.sum("total_price").alias("total_gross"),
        F.sum(S.coalesce_zero(F.col("purchase_price")) * F.col("quantity")).alias("total_capital"),
        F.sum(S.coalesce_zero(F.col("profit_per_unit")) * F.col("quantity")).alias("total_net"),
    )


def receipt_trend(receipts: DataFrame, items: DataFrame, n: int = 7) -> DataFrame:
    """The latest n days with receipts: gross from headers, capital and net from their lines."""
    recent = latest_days(receipts, "date", n)
    gross = recent.groupBy("date").agg(F.sum("subtotal").alias("total_gross"))
    costs = _dated_lines(recent, items).groupBy(F.col("date").alias("_day")).agg(
        F.sum("capital").alias("total_capital"), F.sum("net").alias("total_net")
    )
    joined = gross.join(F.broadcast(costs), F.col("date").eqNullSafe(F.col("_day")), "left")  # at most n rows each
    return joined.select(F.col("date").alias("day"), "total_gross", "total_capital", "total_net")


def incoming_trend(incoming: DataFrame, n: int = 7) -> DataFrame:
    """Received pieces on the latest n days with deliveries."""
    recent = latest_days(incoming, "date_in", n)
    return recent.groupBy(F.col("date_in").alias("day")).agg(F.sum("quantity").alias("total"))


def gap_fill(trend: DataFrame, as_of: Day, n: int = 7) -> DataFrame:
    """The last n calendar days up to as_of; a day the trend lacks is zero, days outside drop out."""
    days = trend.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_sub(as_day(as_of), n - 1), as_day(as_of))).alias("day")
    )
    values = [c for c in trend.columns if c != "day"]
    filled = days.join(trend, "day", "left")
    return filled.select("day", day_label(F.col("day")).alias("label"), *[S.coalesce_zero(F.col(v)).alias(v) for v in values])


def trend_bounds(filled: DataFrame, series: tuple[str, ...] = ("total_gross", "total_capital", "total_net")) -> DataFrame:
    """Chart bounds over all series: min with 0, max with 1, and the midpoint."""
    lowest = F.least(*[F.min(s) for s in series], F.lit(0))
    highest = F.greatest(*[F.max(s) for s in series], F.lit(1))
    bounds = filled.agg(
        F.coalesce(lowest, F.lit(0)).alias("min_value"), F.coalesce(highest, F.lit(1)).alias("max_value")
    )
    middle = F.col("min_value") + (F.col("max_value") - F.col("min_value")) / F.lit(2)
    return bounds.select("min_value", "max_value", middle.cast("double").alias("mid_value"))


# ---- per product ----


def product_sums(sales: DataFrame) -> DataFrame:
    """One row per product (NULL is one): the only pass over the sales that the product reports need."""
    return sales.groupBy("product_id").agg(
        F.sum("quantity").alias("total_qty"),
        F.sum("total_price").alias("total_revenue"),
        F.sum(S.coalesce_zero(F.col("purchase_price")) * F.col("quantity")).alias("total_capital"),
        F.sum(_times_quantity("profit_per_unit")).alias("total_profit"),
        F.count(F.lit(1)).alias("lines"),
    )


def _current_names(products: DataFrame) -> DataFrame:
    return products.select(
        F.col("id").alias("product_id"),
        F.col("code").alias("current_code"),
        F.col("name").alias("current_name"),
        F.col("unit").alias("current_unit"),
    )


def sales_by_product(
    sales: DataFrame, products: DataFrame, start: Day | None = None, end: Day | None = None
) -> DataFrame:
    """Sums per product with its current code, name and unit: summed first, so the join is one row per product."""
    return named_sums(product_sums(sales_between(sales, start, end)), products)


def named_sums(sums: DataFrame, products: DataFrame) -> DataFrame:
    joined = lookup_join(sums, _current_names(products), ["product_id"])
    return joined.select(
        "product_id", "current_code", "current_name", "current_unit",
        "total_qty", "total_revenue", "total_capital", "total_profit",
    )


def top_products(by_product: DataFrame, n: int | None = None) -> DataFrame:
    """Best revenue first; equal revenue by product id."""
    ranked = by_product.orderBy(F.desc("total_revenue"), "product_id")
    return ranked if n is None else ranked.limit(n)


def report_row_number(by_product: DataFrame, heavy_rows: int | None = None, slices: int | None = None) -> DataFrame:
    """The 1-based row number of the report order."""
    order = [F.desc("total_revenue"), F.asc("product_id")]
    return running_totals(by_product, [], order, {"no": F.lit(1).cast("long")}, heavy_rows, slices)


def product_report_with_total(
    sales: DataFrame, products: DataFrame, start: Day | None = None, end: Day | None = None
) -> DataFrame:
    """One row per product and a TOTAL row; a sale without product is a product row, not the total."""
    return report_of_sums(product_sums(sales_between(sales, start, end)), products)


def report_of_sums(sums: DataFrame, products: DataFrame) -> DataFrame:
    measures = ["total_qty", "total_revenue", "total_capital", "total_profit"]
    both = sums.rollup("product_id").agg(
        F.grouping_id().alias("level"), *[F.sum(m).alias(m) for m in measures]
    )
    named = lookup_join(both, _current_names(products), ["product_id"])
    label = F.when(F.col("level") == 1, "TOTAL").otherwise(S.product_label(F.col("current_name"), F.col("product_id")))
    is_total = F.col("level") == 1
    profit = F.when(is_total, S.coalesce_zero(F.col("total_profit"))).otherwise(F.col("total_profit"))
    return named.select(
        "product_id", label.alias("label"), is_total.alias("is_total"), *measures[:-1], profit.alias("total_profit")
    )


def finance_of_sums(sums: DataFrame) -> DataFrame:
    """period_finance from the sums per product."""
    return sums.agg(
        _sum0(F.col("total_revenue")).alias("periodGross"), _sum0(F.col("total_profit")).alias("periodNet"),
        _sum0(F.col("total_capital")).alias("periodCapital"), _sum0(F.col("lines")).alias("totalTransactions"),
    )


# ---- lists ----


def with_product_name(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Sale lines with the current product name; NULL when the product is gone."""
    names = products.select(F.col("id").alias("product_id"), F.col("name").alias("productName"))
    return lookup_join(sales, names, ["product_id"]).select(*sales.columns, "productName")


def _newest_lines(lines: DataFrame, n: int) -> DataFrame:
    return lines.orderBy(F.desc("id"), F.desc("product_id"), F.desc("quantity"), F.desc("total_price")).limit(n)


def recent_sales(sales: DataFrame, products: DataFrame, n: int = 7) -> DataFrame:
    """The newest n sale lines with the current product name; cut to n before the join."""
    newest = _newest_lines(sales.select("id", "product_id", "quantity", "total_price"), n)
    names = products.select(F.col("id").alias("product_id"), F.col("name").alias("productName"))
    wanted = F.broadcast(newest.select("product_id").distinct())  # at most n ids
    few = names.join(wanted, "product_id", "left_semi")
    joined = newest.join(F.broadcast(few), "product_id", "left")  # product ids are unique: at most n rows
    return recent_sale_projection(joined)


def recent_sales_receipts(receipts: DataFrame, items: DataFrame, n: int = 7) -> DataFrame:
    """The newest n receipt lines whose receipt exists, with the name kept at sale time."""
    lines = items.select("id", "receipt_id", "product_id", "quantity", "total_price", F.col("product_name").alias("productName"))
    headers = receipts.select(F.col("id").alias("receipt_id"))
    size = 8 * n
    while size <= max(NEWEST_SLICE, 8 * n):
        # The newest lines meet the receipts of those lines alone; lines without a receipt make the slice grow.
        newest = checkpointed(_newest_lines(lines, size))
        wanted = F.broadcast(newest.select("receipt_id").distinct())  # at most size ids
        known = F.broadcast(headers.join(wanted, "receipt_id", "left_semi"))
        kept = checkpointed(newest.join(known, "receipt_id", "left_semi").select(*lines.columns))
        if kept.count() >= n or newest.count() < size:
            return recent_sale_projection(_newest_lines(kept, n))
        size *= 8
    lines = lookup_join(lines, headers, ["receipt_id"], "left_semi")  # most lines have lost their receipt
    return recent_sale_projection(_newest_lines(lines, n))


def recent_sale_projection(lines: DataFrame) -> DataFrame:
    return lines.select(
        "id", F.col("product_id").alias("productId"), "productName", "quantity",
        F.col("total_price").alias("totalPrice"),
    )


# ---- receipts ----


def receipt_lines(receipts: DataFrame, items: DataFrame) -> DataFrame:
    """Receipt lines with the day, cashier and payment method of their receipt."""
    headers = receipts.select(F.col("id").alias("receipt_id"), "date", "cashier_name", "payment_method")
    return lookup_join(items, headers, ["receipt_id"], "inner")


def receipt_lines_colocated(receipts: DataFrame, items: DataFrame) -> DataFrame:
    """receipt_lines of tables that tables.write_bucketed has laid out, receipts by id and items by receipt_id: a merge in place."""
    headers = receipts.select(F.col("id").alias("receipt_id"), "date", "cashier_name", "payment_method")
    return items.join(headers.hint("merge"), "receipt_id")


def receipt_items(items: DataFrame, receipt_id: int) -> DataFrame:
    return items.filter(F.col("receipt_id") == receipt_id).orderBy("id")


def receipt_reconcile(receipts: DataFrame, items: DataFrame) -> DataFrame:
    """Header sums beside the sums of the lines; `balanced` is false where they differ."""
    sums = item_sums_by_receipt(items).withColumnRenamed("receipt_id", "id")
    joined = receipts.select("id", "subtotal", "total_items").join(sums, "id", "left")
    joined = joined.na.fill(0, ["items_subtotal", "items_quantity"])
    same = F.col("subtotal").eqNullSafe(F.col("items_subtotal")) & F.col("total_items").eqNullSafe(F.col("items_quantity"))
    return joined.withColumn("balanced", same)


def receipt_document(
    receipts: DataFrame, items: DataFrame, page_size: int = 1_000,
    heavy_rows: int | None = None, slices: int | None = None,
) -> DataFrame:
    """Each receipt with its item lines in id order as a nested array.

    A receipt of more than page_size lines continues on further pages, so no array grows without bound.
    """
    order = [F.col("id"), F.col("product_id"), F.col("quantity"), F.col("total_price")]
    numbered = running_totals(items, ["receipt_id"], order, {"nth": F.lit(1).cast("long")}, heavy_rows, slices)
    line = F.struct("nth", "id", "product_id", "product_name", "quantity", "price", "total_price")
    page = F.floor((F.col("nth") - 1) / page_size).cast("long")
    pages = numbered.groupBy("receipt_id", page.alias("page")).agg(
        F.sort_array(F.collect_list(line)).alias("items"), F.count(F.lit(1)).alias("page_lines")
    )
    headers = receipts.select(
        F.col("id").alias("receipt_id"), "date", "cashier_name", "payment_method", "subtotal", "total_items"
    )
    # Pages are few per receipt, so this join has no heavy key the lines did not already lose.
    joined = headers.join(pages, "receipt_id", "left")
    return joined.select(
        "receipt_id", F.coalesce("page", F.lit(0)).alias("page"), "date",
        S.or_dash(F.col("cashier_name")).alias("cashier_name"),
        S.or_dash(F.col("payment_method")).alias("payment_method"),
        "subtotal", "total_items",
        F.coalesce("page_lines", F.lit(0)).alias("page_lines"),
        F.coalesce("items", F.array().cast(pages.schema["items"].dataType)).alias("items"),
    )


def receipt_text(documents: DataFrame, *more: str) -> DataFrame:
    """The printed lines of each receipt page: name, quantity, price, total; `more` columns are kept as they are."""
    def as_text(x: Column) -> Column:
        return F.concat_ws(
            " | ",
            F.coalesce(x["product_name"], F.lit("null")),
            S.coalesce_zero(x["quantity"]).cast("string"),
            S.format_rp(x["price"]),
            S.format_rp(x["total_price"]),
        )

    return documents.select(
        *([c for c in more if c not in ("cashier_name", "payment_method")] or ["receipt_id", "page"]),
        F.concat(F.lit("#"), F.col("receipt_id").cast("string")).alias("number"),
        S.or_dash(S.prefix(F.col("date"))).alias("day_text"),
        "cashier_name", "payment_method",
        F.array_join(F.transform("items", as_text), "\n").alias("lines_text"),
        S.format_rp(F.col("subtotal")).alias("total_text"),
    )
