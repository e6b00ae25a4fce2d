"""Fixed table schemas. Money and quantities are whole numbers, so sums are exact in any order."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "time": T.TimestampNTZType(),
}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in columns.items()])


_SNAPSHOT = dict(
    product_code="string", product_name="string", unit="string",
    purchase_price="long", sale_price="long", profit_per_unit="long",
)

TABLES: dict[str, T.StructType] = {
    "users": _schema(id="long", username="string", fullname="string", role="string", phone="string"),
    "categories": _schema(id="long", name="string", description="string"),
    "suppliers": _schema(id="long", name="string", address="string", phone="string", email="string"),
    "customers": _schema(id="long", name="string", phone="string", email="string", address="string", points="long"),
    "products": _schema(
        id="long", code="string", name="string", category_id="long", unit="string",
        purchase_price="long", sale_price="long", stock="long", entry_date="date",
        storage_location="string", supplier_id="long",
    ),
    "incoming_goods": _schema(
        id="long", date_in="date", product_id="long", quantity="long", supplier_id="long", staff_name="string",
    ),
    "outgoing_goods": _schema(
        id="long", date_out="date", product_id="long", quantity="long", destination="string", staff_name="string",
    ),
    "sales_transactions": _schema(
        id="long", date="date", cashier_name="string", product_id="long", quantity="long",
        price="long", total_price="long", payment_method="string", **_SNAPSHOT,
    ),
    "sales_receipts": _schema(
        id="long", date="date", cashier_name="string", payment_method="string", subtotal="long", total_items="long",
    ),
    "sales_receipt_items": _schema(
        id="long", receipt_id="long", product_id="long", quantity="long", price="long", total_price="long",
        **_SNAPSHOT,
    ),
    "inventory_logs": _schema(
        id="long", type="string", product_id="long", quantity="long", note="string", created_at="time",
    ),
    "inventory_count_sessions": _schema(id="long", counted_at="time", staff_name="string", note="string"),
    "inventory_count_items": _schema(
        id="long", session_id="long", product_id="long", system_stock="long", counted_stock="long",
        difference="long", note="string", created_at="time",
    ),
    "cash_drawer": _schema(
        id="long", date="date", cashier_name="string", opening_balance="long", closing_balance="long",
        difference="long", notes="string",
    ),
}

# Request batches: quantities arrive as raw text.
REQUESTS: dict[str, T.StructType] = {
    "cart_lines": _schema(cart_id="long", line="long", product_id="long", quantity="string"),
    "carts": _schema(cart_id="long", payment_method="string", cashier_name="string"),
    "count_sessions": _schema(session_id="long", counted_at="time", staff_name="string", note="string"),
    "count_lines": _schema(session_id="long", line="long", product_id="long", counted_stock="string", note="string"),
    "incoming": _schema(
        seq="long", product_id="long", quantity="string", supplier_id="long",
        staffName="string", staff_name="string", cashierName="string", cashier_name="string",
    ),
    "sell": _schema(
        seq="long", product_id="long", quantity="string", payment_method="string", cashier_name="string",
    ),
}
