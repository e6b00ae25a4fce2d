"""The period report: finance, sales per product with a total, counts, stock list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.functions import scalars as S
from stockline.operators import catalog, sales
from stockline.operators.scale import checkpointed


def printed_products(numbered: DataFrame) -> DataFrame:
    return numbered.select(
        "no",
        S.product_label(F.col("current_name"), F.col("product_id")).alias("name"),
        S.coalesce_zero(F.col("total_qty")).alias("qty"),
        *[S.format_rp(F.col(f"total_{m}")).alias(m) for m in ("revenue", "capital", "profit")],
    )


def period_report(tables, start=None, end=None) -> dict[str, DataFrame]:
    """The sections. The sales are read once: finance, products and total come from the written sums per product."""
    products = tables.products()
    sums = checkpointed(sales.product_sums(sales.sales_between(tables.sales_transactions(), start, end)))
    return {
        "finance": sales.finance_of_sums(sums),
        "products": printed_products(sales.report_row_number(sales.named_sums(sums, products))),
        "products_total": sales.report_of_sums(sums, products),
        "counts": sales.entity_counts(products, tables.users(), tables.customers()),
        "stock": catalog.price_list(products),
    }
