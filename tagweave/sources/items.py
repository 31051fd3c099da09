"""Vectors, item scans and sharded copies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.hashing import hash_uniform
from tagweave.functions.vectors import as_double, l2_normalize
from tagweave.operators.ranking import hash_index
from tagweave.schema import ID


def unit_vectors(df: DataFrame, dim: int | None = None, id_col: str = ID, vec: str = "embedding") -> DataFrame:
    """Normalised vectors. With `dim` a long flat array is cut into pieces of that size, numbered by `cell`."""
    if dim is None:
        return df.withColumn(vec, l2_normalize(vec))
    v = as_double(vec)
    starts = F.sequence(F.lit(0), (F.size(v) / dim).cast("int") - 1)
    pieces = F.transform(starts, lambda i: F.slice(v, i * dim + 1, dim))
    others = [c for c in df.columns if c != vec]
    return df.select(*others, F.posexplode(pieces).alias("cell", "_p")).select(
        *others, "cell", l2_normalize("_p").alias(vec))


def read_embeddings(spark: SparkSession, path: str, dim: int | None = None, id_col: str = ID,
                    vec: str = "embedding") -> DataFrame:
    return unit_vectors(spark.read.parquet(path), dim, id_col, vec)


def scan_items(spark: SparkSession, source, ys: DataFrame | None = None, id_col: str = ID, path: str = "filepath",
               fmt: str = "parquet") -> DataFrame:
    """Items from a ready table, a folder of saved shards, or a folder of files (fmt `binaryFile` or `image`); optionally
    with labels joined by key or path."""
    if isinstance(source, DataFrame):
        items = source
    elif fmt == "binaryFile":
        items = spark.read.format(fmt).option("recursiveFileLookup", "true").load(source).withColumnRenamed("path", path)
    elif fmt == "image":
        items = spark.read.format(fmt).load(source).withColumn(path, F.col("image.origin"))
    else:
        items = spark.read.parquet(source)
    return items if ys is None else items.join(ys, id_col if id_col in items.columns else path)


def shuffled_batches(items: DataFrame, batch: int, seed=0, id_col: str = ID) -> DataFrame:
    """Seeded shuffle of the keys, before any wide column is joined: adds `position` and `batch_no`."""
    rows = hash_index(items.select(id_col), id_col, seed=seed, out="position")
    return rows.withColumn("batch_no", F.floor(F.col("position") / batch).cast("long"))


def batch_count(items: DataFrame, batch: int) -> DataFrame:
    return items.agg(F.ceil(F.count(F.lit(1)) / F.lit(batch)).cast("long").alias("num_batches"))


def assign_shards(df: DataFrame, num_shards: int, seed=0, id_col: str = ID) -> DataFrame:
    return df.withColumn("shard", F.floor(hash_uniform(f"{seed}:shard", id_col) * num_shards).cast("int"))


def save_sharded(df: DataFrame, path: str, num_shards: int = 10, compress: bool = True, seed=0, id_col: str = ID,
                 files_per_shard: int = 1) -> None:
    """Write every row to a random shard folder; a shard larger than one task should hold is spread over several files."""
    part = F.pmod(F.xxhash64(id_col), F.lit(files_per_shard))
    sharded = assign_shards(df, num_shards, seed, id_col).repartition(num_shards * files_per_shard, "shard", part)
    (sharded.write.mode("overwrite").partitionBy("shard").option("compression", "gzip" if compress else "none")
            .parquet(path))


def load_sharded(spark: SparkSession, path: str, map_fn: Callable[[DataFrame], DataFrame] | None = None,
                 shuffle: bool = False, seed=0, id_col: str = ID) -> DataFrame:
    """Read shards back, optionally in seeded random order and through a user function."""
    df = spark.read.parquet(path)
    if shuffle:
        df = df.orderBy(hash_uniform(seed, id_col), id_col)
    return df if map_fn is None else df.transform(map_fn)


def save_prompt_features(prompts: DataFrame, vectors: DataFrame, path: str, num_shards: int = 10, seed=0,
                         id_col: str = ID, vec: str = "embedding") -> None:
    save_sharded(prompts.select(id_col, "prompt").join(vectors.select(id_col, vec), id_col), path, num_shards, True, seed,
                 id_col)


def load_prompt_features(spark: SparkSession, path: str, map_fn=None) -> DataFrame:
    return load_sharded(spark, path, map_fn).drop("shard")
