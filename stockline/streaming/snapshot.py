"""The current rows of a stream's result by key: each micro-batch overlays the rows it changed.

A version per micro-batch is one table; a batch that runs again overwrites its own version from the one before it, so nothing is
counted twice. Only the last two versions are kept, so what is listed and read does not grow with the batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Snapshot:
    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str) -> None:
        self.spark, self.folder, self.key, self.schema = spark, folder, key, schema

    def _place(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """The batches whose versions are whole, in order."""
        fs, root = self._place("")
        if not fs.exists(root):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(root)]
        numbers = sorted(int(name.removeprefix("v")) for name in names if name.startswith("v"))
        return [n for n in numbers if fs.exists(self._place(f"v{n}/_SUCCESS")[1])]

    def _read(self, version: int | None) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v{version}")

    def write(self, batch_id: int, changed: DataFrame) -> None:
        """Overlay the rows (one per key) that a micro-batch changed. They are read once: a stream's state is worked out by that."""
        before = [n for n in self.versions() if n < batch_id]
        both = self._read(before[-1] if before else None).select(*changed.columns, F.lit(0).alias("_new"))
        both = both.unionByName(changed.withColumn("_new", F.lit(1)))
        last = both.groupBy(self.key).agg(F.max(F.struct("_new", *[c for c in changed.columns if c != self.key])).alias("_last"))
        last.select(self.key, "_last.*").drop("_new").write.mode("overwrite").parquet(f"{self.folder}/v{batch_id}")
        for old in before[:-1]:
            fs, path = self._place(f"v{old}")
            fs.delete(path, True)

    def rows(self, before: int | None = None) -> DataFrame:
        """The current rows, or those before a batch."""
        versions = [n for n in self.versions() if before is None or n < before]
        return self._read(versions[-1] if versions else None)
