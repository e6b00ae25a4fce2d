"""Product catalogue: enrichment, search, stock levels, price list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.functions import scalars as S
from stockline.operators.scale import lookup_join


def with_category_and_supplier(products: DataFrame, categories: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Products with category_name and supplier_name; NULL when the reference is missing or dangling."""
    category_names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    supplier_names = suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    joined = lookup_join(products, category_names, ["category_id"])
    joined = lookup_join(joined, supplier_names, ["supplier_id"])
    return joined.select(*products.columns, "category_name", "supplier_name")


def catalog_view(products: DataFrame, categories: DataFrame, suppliers: DataFrame) -> DataFrame:
    return with_category_and_supplier(products, categories, suppliers).select(
        "*",
        F.col("category_id").alias("categoryId"),
        F.col("category_name").alias("category"),
        F.col("supplier_id").alias("supplierId"),
        F.col("supplier_name").alias("supplier"),
    )


def search_products(products: DataFrame, term: str) -> DataFrame:
    """Case-insensitive substring of name or code; the term is literal text."""
    needle = F.lower(S.trimmed(F.lit(term)))
    in_name = F.contains(F.lower(F.coalesce("name", F.lit(""))), needle)
    in_code = F.contains(F.lower(F.coalesce("code", F.lit(""))), needle)
    return products.filter(in_name | in_code)


def filter_catalog(products: DataFrame, category_id: int | None = None, supplier_id: int | None = None) -> DataFrame:
    """Optional equality filters; 0 or None means all."""
    if category_id:
        products = products.filter(F.col("category_id") == category_id)
    if supplier_id:
        products = products.filter(F.col("supplier_id") == supplier_id)
    return products


def lookup_code(products: DataFrame, scans: DataFrame) -> DataFrame:
    """Each scanned code (column `code`) with the newest product of that code, whatever its case; misses get NULLs."""
    newest = (
        products.filter(F.coalesce("code", F.lit("")) != "")
        .groupBy(F.lower("code").alias("_code"))
        .agg(F.max("id").alias("product_id"), F.max_by("name", "id").alias("product_name"))
    )
    keyed = scans.withColumn("_code", F.lower(S.trimmed(F.col("code"))))
    return lookup_join(keyed, newest, ["_code"]).drop("_code")


def missed_codes(products: DataFrame, scans: DataFrame) -> DataFrame:
    """Scans that no product answers; a blank scan is one, also where a product has no code."""
    known = products.filter(F.coalesce("code", F.lit("")) != "").select(F.lower("code").alias("_code")).distinct()
    keyed = scans.withColumn("_code", F.lower(S.trimmed(F.col("code"))))
    return lookup_join(keyed, known, ["_code"], "left_anti").drop("_code")


def low_stock(catalog: DataFrame, threshold: int = S.LOW_STOCK) -> DataFrame:
    """Products at or below the threshold; out of stock and unknown stock included."""
    return catalog.filter(S.coalesce_zero(F.col("stock")) <= threshold)


def stock_levels(products: DataFrame) -> DataFrame:
    return products.select(
        "*", S.stock_tier(F.col("stock")).alias("tier"), S.stock_badge(F.col("stock")).alias("badge")
    )


def stock_board(catalog: DataFrame) -> DataFrame:
    """Safe products first, then low, then out; newest first inside a tier."""
    stock = F.col("stock")
    board = catalog.select(
        "id",
        S.or_dash(F.col("code"), "—").alias("code"),
        "name",
        S.or_dash(F.col("category_name"), "—").alias("category"),
        S.or_dash(F.col("supplier_name"), "—").alias("supplier"),
        S.coalesce_zero(F.col("sale_price")).alias("sale_price"),
        S.coalesce_zero(stock).alias("stock"),
        S.stock_tier(stock).alias("tier"),
        S.tier_rank(stock).alias("tier_rank"),
    )
    return board.orderBy("tier_rank", F.desc("id"))


def price_list(products: DataFrame) -> DataFrame:
    return products.select("code", "name", "stock", "purchase_price", "sale_price").orderBy("name", "code")


def product_margin(products: DataFrame) -> DataFrame:
    margin = S.product_margin(F.col("sale_price"), F.col("purchase_price"))
    return products.select("id", "code", "name", "purchase_price", "sale_price", margin.alias("margin"))


def preferred_supplier(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """The supplier of each product; no row where it has none."""
    named = suppliers.select(
        F.col("id").alias("supplier_id"), S.or_dash(F.col("name"), "Supplier").alias("supplier_name")
    )
    pairs = products.select(F.col("id").alias("product_id"), "supplier_id")
    return lookup_join(pairs, named, ["supplier_id"], "inner").select("product_id", "supplier_id", "supplier_name")


def product_options(products: DataFrame) -> DataFrame:
    label = S.product_option_label(F.col("code"), F.col("name"), F.col("stock"))
    return products.select("id", label.alias("label"))


def list_desc(table: DataFrame) -> DataFrame:
    """Newest rows first. A distributed sort; take(n) or limit(n) on it becomes a top-n."""
    return table.orderBy(F.desc("id"))


def duplicate_keys(table: DataFrame, key: str) -> DataFrame:
    """Values that break uniqueness of a key; NULL may repeat."""
    return (
        table.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )
