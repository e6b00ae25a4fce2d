"""The deliveries that the sale stream decides on: each request once, the repeats of a micro-batch and of earlier ones left out."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the stream returns for each request.
DECISIONS = "seq long, product_id long, quantity long, price long, total_price long, reason string"
#: Groups over which the deliveries of a micro-batch are dealt; the source's limit bounds the rows of a micro-batch.
GROUPS = 256


def _first_deliveries(sort_keys: list[tuple[str, str]], same: list[str]):
    """A function of an Arrow table that keeps the first row, in order, of those that agree in the columns `same`.

    Rows with a null there are all kept. Defined here so that it travels to the executors by value.
    """

    def first(rows: Any) -> Any:
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = rows.take(pc.sort_indices(rows, sort_keys=sort_keys, null_placement="at_start"))
        if rows.num_rows < 2:
            return rows
        repeated = None
        for name in same:
            equal = pc.fill_null(pc.equal(rows[name].slice(1), rows[name].slice(0, rows.num_rows - 1)), False)
            repeated = equal if repeated is None else pc.and_(repeated, equal)
        return rows.filter(pa.chunked_array([pa.array([True]), *pc.invert(repeated).chunks]))

    return first


def each_once(asked: DataFrame, remember: int) -> DataFrame:
    """A stream of requests (key, seq, _whole, ...) without repeated deliveries, those of a (key, seq) of the last `remember` seconds.

    Of those that come in one micro-batch the smallest _whole counts. Requests without seq are never taken for repeats.
    """
    group = F.pmod(F.xxhash64("key", "seq"), F.lit(GROUPS))
    first = _first_deliveries([(name, "ascending") for name in ("key", "seq", "_whole")], ["key", "seq"])
    once = asked.groupBy(group.alias("_group")).applyInArrow(first, asked.schema)
    # What is kept by the state goes when the watermark, which is one delay behind, has passed it by another one.
    timed = once.withColumns({
        "_taken_at": F.current_timestamp(), "_unnumbered": F.when(F.col("seq").isNull(), F.expr("uuid()")),
    }).withWatermark("_taken_at", f"{remember * 500} milliseconds")
    return timed.dropDuplicatesWithinWatermark(["key", "seq", "_unnumbered"]).select(*asked.columns)
