"""The dashboard: its frames are independent, so each can be read alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.functions import scalars as S
from stockline.operators import catalog, sales, stock

# Figures each role sees, in order: label, figure, shown as money.
ROLE_FIGURES = {
    "admin": [
        ("Total Produk", "totalProducts", False),
        ("Total Pengguna", "totalUsers", False),
        ("Total Pelanggan", "totalCustomers", False),
        ("Penjualan Hari Ini", "todaySales", True),
    ],
    "kasir": [
        ("Transaksi Hari Ini", "todaySales", True),
        ("Pendapatan Hari Ini", "todayGrossRevenue", True),
        ("Produk Tersedia", "totalProducts", False),
    ],
    "gudang": [
        ("Total Produk", "totalProducts", False),
        ("Stok Menipis", "lowStock", False),
        ("Supplier", "totalSuppliers", False),
        ("Pelanggan", "totalCustomers", False),
    ],
}


def figures(
    products: DataFrame, users: DataFrame, customers: DataFrame, suppliers: DataFrame, day_figures: DataFrame
) -> DataFrame:
    """All dashboard figures as rows (figure, amount); day_figures is a one-row frame of daily_kpis."""
    tall = sales.entity_counts(products, users, customers).unpivot(
        [], ["totalProducts", "totalUsers", "totalCustomers"], "figure", "amount"
    )
    low = catalog.low_stock(products).agg(F.count(F.lit(1)).alias("lowStock"))
    supplier_count = suppliers.agg(F.count(F.lit(1)).alias("totalSuppliers"))
    return (
        tall.unionByName(low.unpivot([], ["lowStock"], "figure", "amount"))
        .unionByName(supplier_count.unpivot([], ["totalSuppliers"], "figure", "amount"))
        .unionByName(day_figures.unpivot([], day_figures.columns, "figure", "amount"))
    )


def role_dashboard(all_figures: DataFrame, role: str | None = None) -> DataFrame:
    """The labelled figures of one role, or of every role."""
    wanted = [
        (r, i, label, figure, money)
        for r, rows in ROLE_FIGURES.items()
        for i, (label, figure, money) in enumerate(rows, start=1)
        if role in (None, r)
    ]
    layout = all_figures.sparkSession.createDataFrame(
        wanted, "role string, position int, label string, figure string, money boolean"
    )
    amount = S.coalesce_zero(F.col("amount"))
    value = F.when(F.col("money"), S.format_idr(amount)).otherwise(amount.cast("string"))
    return layout.join(all_figures, "figure", "left").select("role", "position", "label", value.alias("value"))


def overview(tables, as_of, days: int = 7) -> dict[str, DataFrame]:
    """All dashboard frames. `tables` has a method per table (see sources.star)."""
    products, suppliers = tables.products(), tables.suppliers()
    lines = tables.sales_transactions()
    catalog_rows = catalog.catalog_view(products, tables.categories(), suppliers)
    day_figures = sales.daily_kpis(lines, as_of)
    trend = sales.gap_fill(sales.sales_trend(lines, days), as_of, days)
    return {
        "products": catalog_rows,
        "recentSales": sales.recent_sales(lines, products),
        "recentLogs": stock.recent_logs(tables.inventory_logs()),
        "lowStock": catalog.low_stock(catalog_rows),
        "counts": sales.entity_counts(products, tables.users(), tables.customers()),
        "today": day_figures,
        "trend": trend,
        "bounds": sales.trend_bounds(trend),
        "roles": role_dashboard(figures(products, tables.users(), tables.customers(), suppliers, day_figures)),
    }
