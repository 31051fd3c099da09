"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import Scratch


def _minimum(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))


def components(links: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """(node, root) for every node of `links` (u, v) but the roots; root is the smallest node of the component.

    Every step writes its pairs, at most two for each of the last, so no node's neighbours are ever collected. The number
    of steps grows with the logarithm of the longest chain.
    """
    pairs = scratch.write(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                          f"{name}0")
    before, step = None, 0
    while True:
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(state)
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_minimum(both), "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        low = _minimum(large)
        small = (large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .unionByName(low.select("u", F.col("low").alias("v")))).where("u <> v").distinct()
        step += 1
        pairs = scratch.write(small, f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")
