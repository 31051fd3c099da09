"""Helpers shared by the operators: tables in the shared scratch folder, word caches, Arrow output.

`Scratch` writes a result once to the folder that all executors share and reads it back, so later steps neither repeat
the work nor depend on one executor's disk. Tables that are no longer needed are dropped as soon as what reads them has
been written itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tagweave.session import scratch_path

WORDS = r"[^\x20\x09-\x0D]+"
_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Parquet tables of one job in the shared folder."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.root, self.paths = spark, scratch_path(spark, job), {}

    def write(self, df: DataFrame, name: str, compression: str = "snappy", partition_by: tuple = ()) -> DataFrame:
        """Write `df` and return the written table. Its shuffle files go when the write has ended."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(_CLEAN_SHUFFLES, "false")
        self.spark.conf.set(_CLEAN_SHUFFLES, "true")
        try:
            df.write.option("compression", compression).partitionBy(*partition_by).parquet(path)
        finally:
            self.spark.conf.set(_CLEAN_SHUFFLES, before)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables by name. Only for tables that nothing lazy still reads."""
        for name in names:
            remove_path(self.spark, self.paths.pop(name))


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


class Cache(dict):
    """A dict that computes missing values and is emptied before it grows over `limit` entries."""

    def __init__(self, make: Callable, limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


def arrow_rows(schema: pa.Schema, rows: Iterator[tuple], limit: int = 2048, limit_bytes: int = 8 << 20,
               weigh: Callable[[tuple], int] | None = None) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of at most `limit` rows and about `limit_bytes` bytes by `weigh`."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row) if weigh else 0
        if len(held) >= limit or size >= limit_bytes:
            yield _batch(schema, held)
            held, size = [], 0
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
