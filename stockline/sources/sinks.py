"""Writing receipts and reports as data sets."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.operators.sales import receipt_text


def receipt_export(documents: DataFrame, path: str) -> None:
    """One JSON document per receipt page with header, item lines and printed text, in a folder per day.

    Documents are rebalanced by day first, else every task writes a file for every day: small days get one file, those with very many
    documents several. The text is made after that, so it is not shuffled.
    """
    documents = documents.hint("rebalance", "date")
    printed = receipt_text(documents, *documents.columns).select(*documents.columns, "number", "lines_text", "total_text")
    printed.withColumn("day", F.col("date")).write.mode("overwrite").partitionBy("day").json(path)


def period_label(start: str | date | None, end: str | date | None) -> str:
    return f"Periode: {start} s/d {end}" if start and end else "Sepanjang Waktu"


def report_name(start: str | date | None, end: str | date | None, as_of: str | date) -> str:
    return f"laporan-{start}_{end}" if start and end else f"laporan-rekapan-{as_of}"


def period_report_export(
    sections: dict[str, DataFrame], folder: str, start: str | date | None, end: str | date | None,
    as_of: str | date, fmt: str = "parquet",
) -> str:
    """Each report section as a data set below a folder named for the period; returns that folder."""
    target = f"{folder}/{report_name(start, end, as_of)}"
    for name, section in sections.items():
        labelled = section.withColumn("period_label", F.lit(period_label(start, end)))
        writer = labelled.write.mode("overwrite")
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(f"{target}/{name}")
    return target
