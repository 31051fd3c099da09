"""Random views of vectors for pair building, reproducible from (seed, item, view)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.hashing import hash_normal, hash_uniform
from tagweave.functions.vectors import as_double
from tagweave.schema import ID


def gaussian_noise(scale: float = 0.1):
    def view(vec: Column, key: Column, tag: str) -> Column:
        return F.transform(vec, lambda x, j: x + F.lit(scale) * hash_normal(tag, key, j))
    return view


def coordinate_mask(rate: float = 0.1):
    def view(vec: Column, key: Column, tag: str) -> Column:
        return F.transform(vec, lambda x, j: F.when(hash_uniform(tag, key, j) < rate, 0.0).otherwise(x))
    return view


def build_view_pairs(df: DataFrame, first_view, second_view=None, batch: int = 64, seed=0, id_col: str = ID,
                     vec: str = "embedding") -> DataFrame:
    """(batch_id, pair_id, z1, z2): two independent versions of each item, in shuffled batches.

    A view function maps (vector Column, key Column, seed text) to a Column. With one function both versions use it.
    """
    from tagweave.operators.ranking import hash_index

    rows = hash_index(df.select(id_col, as_double(vec).alias("_v")), id_col, seed=seed)
    key = F.col(id_col)
    return rows.select(F.floor(F.col("row_no") / batch).cast("long").alias("batch_id"), key.alias("pair_id"),
                       first_view(F.col("_v"), key, f"{seed}:1").alias("z1"),
                       (second_view or first_view)(F.col("_v"), key, f"{seed}:2").alias("z2"))
