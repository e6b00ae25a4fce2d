"""Streams over several files give the batch result; late and repeated rows do no harm."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from stockline.operators import baskets
from stockline.sources.star import StarTables
from stockline.streaming import jobs
from stockline.streaming.snapshot import Snapshot

START = datetime(2026, 5, 1)


def write_files(spark, path, schema, *files):
    for i, rows in enumerate(files):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.parquet(f"{path}/{i:02d}")
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
        .parquet(str(path))
    )


SALE = "ts timestamp_ntz, quantity long, total_price long, purchase_price long, profit_per_unit long"


def test_sales_trend_drops_late_rows(spark, tmp_path):
    def day(n, *amounts):
        return [(START + timedelta(days=n, hours=i), 1, a, 1, a - 1) for i, a in enumerate(amounts)]

    # A watermark holds from the batch after next, hence the file between the newest day and the late row.
    files = [day(0, 5, 6), day(1, 7) + day(0, 1), day(9, 2), day(9, 3), day(0, 1000) + day(9, 4)]
    stream = write_files(spark, tmp_path / "in", SALE, *files)
    jobs.start_sales_trend(stream, str(tmp_path / "out"), "2 days").awaitTermination()
    live = jobs.live_sales_trend(spark, str(tmp_path / "out")).collect()
    rows = {r["day"].day: (r["total_gross"], r["total_capital"], r["total_net"]) for r in live}
    assert rows == {1: (12, 3, 9), 2: (7, 1, 6), 10: (9, 3, 6)}


@pytest.mark.parametrize("zone", ["UTC", "Asia/Jakarta"])
def test_days_are_utc_in_any_session_zone(spark, tmp_path, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        stream = write_files(spark, tmp_path / "in", SALE, [(START + timedelta(hours=h), 1, 1, 1, 0) for h in (0, 1, 23)])
        jobs.start_sales_trend(stream, str(tmp_path / "out")).awaitTermination()
        assert [tuple(r)[:2] for r in jobs.live_sales_trend(spark, str(tmp_path / "out")).collect()] == [(START.date(), 3)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


PRODUCT = "id long, code string, name string, unit string, purchase_price long, sale_price long, stock long"
PRODUCTS = [(1, "A", "Kopi", "pcs", 1, 2, 10), (2, "B", "Teh", "pcs", 1, 2, None), (3, "C", "Gula", "pcs", 1, 2, 4)]


def test_movements_count_once(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, product_id long, quantity long"
    first = [(1, START, 1, 5), (2, START, 2, 5), (3, START, 3, -1)]
    stream = write_files(spark, tmp_path / "in", schema, first, first, [(4, START + timedelta(hours=1), 1, -2), (1, START, 1, 5)])
    products = spark.createDataFrame(PRODUCTS, PRODUCT)
    jobs.start_movements(stream, str(tmp_path / "out")).awaitTermination()
    stock = {r["id"]: r["stock"] for r in jobs.live_stock(products, str(tmp_path / "out")).collect()}
    assert stock == {1: 13, 2: None, 3: 3}


SELL = "seq long, product_id long, quantity string"


def test_sell_stream_equals_the_batch_job(spark, tmp_path):
    """Six micro-batches, of which one is a file delivered twice and one holds a request of an earlier one."""
    rows = [(i, i % 4 if i % 9 else None, ["1", "2", "x", "3", "0", "1.5"][i * 7 % 6]) for i in range(60)]
    again = [(rows[3][0], 3, "4"), *rows[40:45]]
    files = [rows[:20], rows[20:25], rows[20:25], again[:1] + rows[25:50], again, rows[50:]]
    stream = write_files(spark, tmp_path / "in", SELL, *files)
    products = spark.createDataFrame(PRODUCTS, PRODUCT)
    query = jobs.start_sell(stream, products, str(tmp_path / "out"))
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == len(files)
    names = ["seq", "product_id", "quantity", "price", "total_price", "reason"]
    live = jobs.sell_results(spark, str(tmp_path / "out")).select(names).collect()
    batch = baskets.sell_decisions(products, spark.createDataFrame(rows, SELL)).select(names).collect()
    assert sorted(map(repr, live)) == sorted(map(repr, batch))
    assert {None, "not_enough_stock", "bad_item"} == {r["reason"] for r in live}


def test_sell_stream_goes_on_without_reading_products(spark, tmp_path):
    products = spark.createDataFrame(PRODUCTS, PRODUCT)
    out, reasons = str(tmp_path / "out"), lambda: {r.seq: r.reason for r in jobs.sell_results(spark, out).collect()}
    write = lambda name, *rows: spark.createDataFrame(list(rows), SELL).write.parquet(f"{tmp_path}/in/{name}")
    stream = lambda: spark.readStream.schema(SELL).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    write("a", (1, 3, "3"), (2, 9, "1"), (None, 1, "1"), (None, 1, "1"))
    jobs.start_sell(stream(), products, out).awaitTermination()
    assert reasons() == {1: None, 2: "unknown_product", None: None}
    write("b", (1, 3, "3"), (3, 3, "2"), (4, 3, "1"))
    # Started again, with products that must not matter any more, as a job that keeps running.
    query = jobs.start_sell(stream(), products.filter("id = 1"), out, trigger={"processingTime": "1 second"})
    query.processAllAvailable()
    assert query.isActive
    query.stop()
    assert reasons() == {1: None, 2: "unknown_product", None: None, 3: "not_enough_stock", 4: None}


def test_streams_keep_running_and_hold_two_versions(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, product_id long, quantity long"
    files = [[(i, START + timedelta(hours=i), 1 + i % 3, 1), (max(i - 1, 0), START + timedelta(hours=i - 1), 1, 1)] for i in range(7)]
    stream = write_files(spark, tmp_path / "in", schema, *files)
    query = jobs.start_movements(stream, str(tmp_path / "out"), "2 days", trigger={"processingTime": "0 seconds"})
    query.processAllAvailable()
    assert query.isActive
    query.stop()
    once = {}
    for event, _, product, _ in (row for rows in files for row in rows):
        once.setdefault(event, product)
    moved = {p: sum(1 for x in once.values() if x == p) for p in (1, 2, 3)}
    stock = {r["id"]: r["stock"] for r in jobs.live_stock(spark.createDataFrame(PRODUCTS, PRODUCT), str(tmp_path / "out")).collect()}
    assert stock == {1: 10 + moved[1], 2: None, 3: 4 + moved[3]}
    assert len([f for f in (tmp_path / "out" / "net").iterdir()]) == 2


def test_snapshot_replays(spark, tmp_path):
    snapshot = Snapshot(spark, str(tmp_path / "s"), "k", "k long, v long")
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "k long, v long")
    now = lambda: {r.k: r.v for r in snapshot.rows().collect()}
    assert now() == {} and snapshot.versions() == []
    snapshot.write(0, rows((1, 1), (2, 2)))
    snapshot.write(1, rows((2, 99), (3, 3)))
    snapshot.write(1, rows((2, 5)))  # the batch runs again: only its last run counts
    assert now() == {1: 1, 2: 5}
    for batch_id in (2, 3, 7):
        snapshot.write(batch_id, rows((1, batch_id)))
    assert now() == {1: 7, 2: 5} and snapshot.versions() == [3, 7]
    (tmp_path / "s" / "v7" / "_SUCCESS").unlink()  # a version that is not whole does not count
    assert now() == {1: 3, 2: 5}


def test_snapshot_reads_a_changed_row_once(spark, tmp_path):
    """A second reading would work out the state of the stream again."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    snapshot = Snapshot(spark, str(tmp_path / "s"), "k", "k long, v long")
    snapshot.write(0, spark.createDataFrame([(1, 1), (2, 2), (None, 3)], "k long, v long"))
    changed = spark.createDataFrame([(2, 5), (None, 6), (4, 7)], "k long, v long").mapInArrow(counted, "k long, v long")
    snapshot.write(1, changed)
    assert read.value == 3
    assert {r.k: r.v for r in snapshot.rows().collect()} == {1: 1, 2: 5, None: 6, 4: 7} and snapshot.rows().count() == 4
    assert {r.k: r.v for r in snapshot.rows(before=1).collect()} == {1: 1, 2: 2, None: 3}


def test_sell_stream_of_many_products_keeps_one_table_of_stock(spark, tmp_path):
    """What is left is a table by product; of repeats in a micro-batch the smallest counts, requests without seq all count."""
    products = spark.range(3000).selectExpr("id", "'A' code", "'x' name", "'pcs' unit", "1L purchase_price", "2L sale_price", "5L stock")
    first = [(None, 7, "1"), (None, 7, "1"), (1, 8, "5"), (1, 8, "4"), (1, 8, "1.5"), (2, 9, "x"), (3, 9, "6")]
    files = [first, [(1, 8, "1"), (4, 8, "2"), (5, 8, "1"), (6, 7, "4"), (7, 7, "3")]]
    out = str(tmp_path / "out")
    jobs.start_sell(write_files(spark, tmp_path / "in", SELL, *files), products, out).awaitTermination()
    rows = [(r.seq, r.product_id, r.quantity, r.total_price, r.reason) for r in jobs.sell_results(spark, out).collect()]
    assert sorted(rows, key=repr) == sorted([
        (None, 7, 1, 2, None), (None, 7, 1, 2, None), (1, 8, None, None, "bad_item"), (2, 9, 0, 0, "bad_item"),
        (3, 9, 6, 12, "not_enough_stock"), (4, 8, 2, 4, None), (5, 8, 1, 2, None), (6, 7, 4, 8, "not_enough_stock"), (7, 7, 3, 6, None),
    ], key=repr)
    left = {r.id: r.stock for r in Snapshot(spark, f"{out}/shelf", "id", "id long, stock long, sale_price long").rows().collect()}
    assert len(left) == 3000 and {k: v for k, v in left.items() if v != 5} == {7: 0, 8: 2}


@pytest.mark.parametrize("repeats", [True, False])
def test_events_are_dealt_to_micro_batches_of_equal_files(spark, tmp_path, monkeypatch, repeats):
    from checks import queries

    monkeypatch.setattr(queries, "EVENT_FILE_ROWS", 3)
    monkeypatch.setattr(queries, "EVENT_BATCH_ROWS", 10)
    spark.range(3, 80).selectExpr("id AS event_id", "id AS value").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    files = queries._event_files(StarTables(spark, str(tmp_path)), str(tmp_path / "run"), repeats)
    batches = [spark.read.schema("event_id long, value long").parquet(f"{tmp_path}/run/in/{i}") for i in range(9)]
    assert files > 1 and {len(b.inputFiles()) for b in batches} == {files}  # 77 rows: eight micro-batches and one of late rows
    ids = [sorted(r.event_id for r in b.collect()) for b in batches]
    part = lambda i: {x for x in range(3, 80) if sum(x > b for b in bounds) == i}
    bounds = spark.read.parquet(f"{tmp_path}/events.parquet").approxQuantile("event_id", [i / 8 for i in range(1, 8)], 0.1 / 8)
    for i, now in enumerate(ids):
        late = [x for x in part(i - 1) if x % 7 == 0]
        in_time = [x for x in part(i) if repeats or x % 7]
        assert now == sorted(in_time + late + (list(part(0)) if repeats and i == 2 else []))
    assert not (tmp_path / "run" / "in" / "9").exists()
