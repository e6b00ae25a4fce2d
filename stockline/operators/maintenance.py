"""Table maintenance as batches: each job takes snapshots and a batch and returns new frames for the caller to write."""

from __future__ import annotations

from datetime import date
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockline.functions import scalars as S
from stockline.functions.dates import as_day
from stockline.operators.baskets import UNKNOWN_PRODUCT
from stockline.operators.scale import checkpointed, lookup_join
from stockline.sources.tables import append_rows

# Why a row is refused.
INVALID = "invalid_data"
BAD_INCOMING = "bad_incoming"
DUPLICATE_CODE = "duplicate_code"
EMPTY_COUNT = "empty_count"

# Text fields that must not be blank.
REQUIRED_TEXT = {
    "products": ["code", "name", "unit"],
    "categories": ["name"],
    "suppliers": ["name", "address", "phone", "email"],
    "customers": ["name", "phone", "email"],
}
# Ids that must be given and not 0.
REQUIRED_ID = {"products": ["category_id"], "movements": ["product_id"]}

# How a full replace writes each field of a table.
_TEXT, _ID, _NUMBER, _RAW = "text", "id", "number", "raw"
EDITABLE = {
    "products": {
        "code": _TEXT, "name": _TEXT, "category_id": _RAW, "unit": _TEXT, "purchase_price": _NUMBER,
        "sale_price": _NUMBER, "stock": _NUMBER, "entry_date": _RAW, "storage_location": _TEXT, "supplier_id": _ID,
    },
    "categories": {"name": _TEXT, "description": _TEXT},
    "suppliers": {"name": _TEXT, "address": _TEXT, "phone": _TEXT, "email": _TEXT},
    "customers": {"name": _TEXT, "phone": _TEXT, "email": _TEXT, "address": _TEXT},
}


class Split(NamedTuple):
    valid: DataFrame
    rejects: DataFrame


class Created(NamedTuple):
    products: DataFrame
    logs: DataFrame
    rejects: DataFrame


class Received(NamedTuple):
    incoming: DataFrame
    logs: DataFrame
    movements: DataFrame
    rejects: DataFrame


class Counted(NamedTuple):
    sessions: DataFrame
    items: DataFrame
    logs: DataFrame
    movements: DataFrame
    rejects: DataFrame


# ---- validation ----


def with_reject_reason(batch: DataFrame, kind: str) -> DataFrame:
    """Adds reject_reason, NULL for a valid row. kind: a table of REQUIRED_TEXT, or 'movements'."""
    valid = F.lit(True)
    for name in REQUIRED_TEXT.get(kind, []):
        valid = valid & S.text_or(F.col(name), None).isNotNull()
    for name in REQUIRED_ID.get(kind, []):
        valid = valid & (S.coalesce_zero(F.col(name)) != 0)
    valid = valid & ~fractional(batch, kind)
    if kind == "movements":
        valid = valid & (S.coalesce_zero(S.whole_number(F.col("quantity"))) > 0)
    return batch.withColumn("reject_reason", F.when(~valid, INVALID))


def fractional(batch: DataFrame, kind: str) -> Column:
    """Whether a row sends a number with a fraction, or too large, where the table keeps whole numbers."""
    numbers = [c for c, how in EDITABLE.get(kind, {}).items() if how == _NUMBER and c in batch.columns]
    return reduce(lambda a, b: a | b, [S.whole_number(F.col(c)).isNull() for c in numbers], F.lit(False))


def _split(judged: DataFrame) -> Split:
    return Split(
        judged.filter("reject_reason IS NULL").drop("reject_reason"), judged.filter("reject_reason IS NOT NULL")
    )


def validate_batch(batch: DataFrame, kind: str) -> Split:
    return _split(with_reject_reason(batch, kind))


def unknown_products(batch: DataFrame, products: DataFrame) -> DataFrame:
    """Rows whose product does not exist, rows without a product included."""
    return lookup_join(batch, products.select(F.col("id").alias("product_id")), ["product_id"], "left_anti")


# ---- create, replace, delete ----


def _written(rows: DataFrame, table: str) -> list[Column]:
    """The fields as a write stores them: a field the batch lacks is blank text, 0 or NULL."""
    how_to = {
        _TEXT: lambda c: F.coalesce(S.trimmed(c.cast("string")), F.lit("")),
        _NUMBER: S.whole_number,
        _ID: lambda c: F.when(c != 0, c),
        _RAW: lambda c: c,
    }
    types = {"category_id": "long", "supplier_id": "long", "entry_date": "date"}
    out = []
    for name, how in EDITABLE[table].items():
        given = F.col(name) if name in rows.columns else F.lit(None).cast(types.get(name, "string"))
        out.append(how_to[how](given).alias(name))
    return out


def upsert(target: DataFrame, changes: DataFrame, table: str) -> DataFrame:
    """Full-row replace by id: of several changes (column seq) to one id the last valid one counts.

    Not a patch: a field the change lacks is emptied. An unknown id changes nothing. Of product changes only
    the numbers are checked: see refused_changes. Of changes with equal seq the largest row counts.
    """
    if table == "products":
        changes = changes.filter(~fractional(changes, table))
    else:
        changes = validate_batch(changes, table).valid
    written = _written(changes, table)
    fields = list(EDITABLE[table])
    last = changes.select("id", "seq", F.struct(*written).alias("row")).groupBy("id").agg(
        F.max(F.struct("seq", "row")).alias("_last")
    ).select("id", F.col("_last.row").alias("_new"))
    joined = target.join(last, "id", "left")
    changed = F.col("_new").isNotNull()
    return joined.select(
        *[
            F.when(changed, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
            for c in target.columns
        ]
    )


def refused_changes(changes: DataFrame) -> DataFrame:
    """Product changes that upsert refuses, with the reason."""
    return changes.filter(fractional(changes, "products")).withColumn("reject_reason", F.lit(INVALID))


def remove_ids(target: DataFrame, ids: DataFrame) -> DataFrame:
    """The target without a set of ids (column id)."""
    return target.join(ids.select("id").distinct(), "id", "left_anti")


def delete_logs(ids: DataFrame) -> DataFrame:
    """One log row per delete request, whether or not the product existed."""
    return ids.select(
        F.lit("delete").alias("type"), F.col("id").alias("product_id"), F.lit(0).cast("long").alias("quantity"),
        S.delete_note(F.col("id")).alias("note"),
    )


def delete_with_log(products: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return remove_ids(products, ids), delete_logs(ids)


def create_products(products: DataFrame, batch: DataFrame) -> Created:
    """New products (batch column seq gives the order) with ids, their log rows, and the refused rows.

    A code that exists, or that an earlier row of the batch takes, is refused.
    """
    judged = with_reject_reason(batch, "products").withColumn("code", F.coalesce(S.trimmed(F.col("code")), F.lit("")))
    taken = products.filter("code IS NOT NULL").select("code", F.lit(True).alias("_exists")).distinct()
    judged = lookup_join(judged, taken, ["code"])
    usable = F.col("reject_reason").isNull() & F.col("_exists").isNull()
    first = judged.filter(usable).groupBy("code").agg(F.min("seq").alias("_first"))
    judged = lookup_join(judged, first, ["code"])
    again = F.col("_exists").isNotNull() | (F.col("seq") > F.col("_first"))
    judged = judged.withColumn("reject_reason", F.coalesce("reject_reason", F.when(again, DUPLICATE_CODE)))
    valid, rejects = _split(judged.select(*batch.columns, "reject_reason"))
    rows = append_rows(products, valid.select("seq", *_written(valid, "products")), [F.col("seq")])
    logs = rows.select(
        F.lit("create").alias("type"), F.lit(None).cast("long").alias("product_id"),
        F.col("stock").alias("quantity"), S.create_note(F.col("name")).alias("note"),
    )
    return Created(rows.select(*products.columns), logs, rejects)


# ---- goods received ----


def receive_goods(products: DataFrame, batch: DataFrame, day: str | date | Column) -> Received:
    """Incoming rows, logs and stock movements of the valid requests; the others with a reason."""
    known = products.select(F.col("id").alias("product_id"), F.lit(True).alias("_found"))
    staff = S.first_text(
        F.col("staffName"), F.col("staff_name"), F.col("cashierName"), F.col("cashier_name"), default=S.DEFAULT_STAFF
    )
    joined = lookup_join(batch, known, ["product_id"])
    judged = with_reject_reason(joined, "movements")
    reason = F.when(F.col("reject_reason").isNotNull(), BAD_INCOMING).when(F.col("_found").isNull(), UNKNOWN_PRODUCT)
    valid, rejects = _split(judged.withColumn("reject_reason", reason).drop("_found"))
    rows = valid.select(
        "seq", as_day(day).alias("date_in"), "product_id", S.whole_number(F.col("quantity")).alias("quantity"),
        F.when(F.col("supplier_id") != 0, F.col("supplier_id")).alias("supplier_id"), staff.alias("staff_name"),
    )
    logs = rows.select(
        F.lit("incoming").alias("type"), "product_id", "quantity",
        S.incoming_note(F.col("quantity"), F.col("staff_name")).alias("note"),
    )
    return Received(rows, logs, rows.select("product_id", "quantity"), rejects)


# ---- stock counts ----


def counted_lines(products: DataFrame, lines: DataFrame) -> DataFrame:
    """Count lines against the opening system stock; a count that is no number is 0."""
    system = products.select(
        F.col("id").alias("product_id"), S.coalesce_zero(F.col("stock")).alias("system_stock"),
        F.lit(True).alias("found"),
    )
    joined = lookup_join(lines, system, ["product_id"])
    counted = S.whole_number(F.col("counted_stock"))
    return joined.select(
        "session_id", "line", "product_id", "system_stock", counted.alias("counted_stock"),
        (counted - F.col("system_stock")).alias("difference"),
        S.text_or(F.col("note"), None).alias("note"),
        F.coalesce("found", F.lit(False)).alias("found"),
        counted.isNull().alias("fractional"),
    )


def stock_count(products: DataFrame, sessions: DataFrame, lines: DataFrame) -> Counted:
    """Reconcile counted with system stock: a session with an unknown product is refused whole."""
    checked = checkpointed(counted_lines(products, lines))
    judged = checked.groupBy("session_id").agg(
        F.bool_and("found").alias("all_found"), F.bool_or("fractional").alias("any_fractional")
    )
    headers = sessions.select(
        "session_id", "counted_at", S.text_or(F.col("staff_name"), S.DEFAULT_STAFF).alias("staff_name"),
        S.text_or(F.col("note"), None).alias("note"),
    ).join(judged, "session_id", "left")
    reason = (
        F.when(F.col("all_found").isNull(), EMPTY_COUNT)
        .when(~F.col("all_found"), UNKNOWN_PRODUCT)
        .when(F.col("any_fractional"), INVALID)
    )
    accepted, rejects = _split(
        headers.withColumn("reject_reason", reason).drop("all_found", "any_fractional")
    )
    staff = accepted.select("session_id", F.col("staff_name").alias("_staff"))
    kept = checkpointed(lookup_join(checked, staff, ["session_id"], "inner"))  # items, logs and movements read it
    items = kept.select(
        "session_id", "line", "product_id", "system_stock", "counted_stock", "difference", "note"
    )
    logs = kept.select(
        F.lit("stock_opname").alias("type"), "product_id", F.col("difference").alias("quantity"),
        S.count_note(F.col("_staff"), F.col("counted_stock")).alias("note"),
    )
    movements = kept.select("product_id", F.col("difference").alias("quantity"))
    return Counted(accepted, items, logs, movements, rejects)
