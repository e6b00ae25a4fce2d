"""Small helpers of the text operators: Arrow batches in slices, a guarded broadcast, numpy hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockline.session import shared_folder

#: Rows of an Arrow batch that are worked on at a time, so that a task holds few texts as Python objects.
SLICE_ROWS = 256
#: A list of ids is broadcast only if it counts at most this many rows (8 bytes each); else it is joined by shuffle.
BROADCAST_IDS = 1_000_000

_SHIPPED: set[str] = set()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, in case it is not installed there."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        root = Path(__file__).resolve().parents[2]
        archive = Path(tempfile.mkdtemp(prefix="stockline-")) / "stockline.zip"  # the driver's copy, which it serves
        with zipfile.ZipFile(archive, "w") as packed:
            for path in sorted((root / "stockline").rglob("*.py")):
                packed.write(path, path.relative_to(root))
        sc.addPyFile(str(archive))


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """df through `work`, a function from a slice of rows to columns by name (or None for no rows)."""
    names = [field.split()[0] for field in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
             "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[field.split()[1]] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            columns = work(part)
            if columns is not None:
                arrays = [
                    c if isinstance(c := columns[n], pa.Array) else pa.array(c, type=t) for n, t in zip(names, types)
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns named by place, which cannot clash with others, and the place's name of each column."""
    names = {name: f"_{i}" for i, name in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def row_key(doc_id: Column, text: Column) -> Column:
    """A 64-bit hash of a document's row by id and text, never null: rows of a null or repeated id differ by their texts."""
    return F.xxhash64(doc_id.cast("long"), text)


def only_ids(df: DataFrame, ids: DataFrame, on: str, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The rows of df whose `on` is among ids (one column of that name); a short list is broadcast, after a count."""
    if ids.count() <= broadcast_ids:
        ids = F.broadcast(ids)
    return df.join(ids, on, "left_semi")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n pairs (odd factor, summand) of 32-bit multiply-add permutations."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1)
    return factors, rng.integers(0, 2**32, n, dtype=np.uint32)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """(n, bands * rows) of 32-bit minima to (n, bands) of 64-bit bucket keys; the band is part of the key."""
    n, width = signatures.shape
    parts = signatures.reshape(n, width // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, width // rows + 1, dtype=np.uint64), (n, width // rows))
    for r in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def long_lists(values: np.ndarray) -> pa.ListArray:
    """A two-dimensional array of longs as a list column."""
    n, width = values.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).reshape(-1))
    )


class Scratch:
    """Tables of one job in a folder of its own in the shared folder: Parquet, which takes a third of a checkpoint's space."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        """df, written and read again; survives the loss of executors."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads, and let go of the shuffle files behind them."""
        for table in tables:
            for file in {name.rpartition("/")[0] for name in table.inputFiles()}:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(file)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        let_go(self.spark)


def let_go(spark: SparkSession) -> None:
    """Collect garbage on the driver, upon which Spark deletes shuffle files, broadcasts and checkpoints that nothing refers to.

    A job of many rounds else holds those of all rounds until the driver's heap is full.
    """
    gc.collect()
    spark._jvm.System.gc()
