"""Row numbers and running totals over whole tables or hot groups, without one task seeing a group.

`hash_index` numbers the rows of each group in hash order: a group is spread over fixed hash buckets, rows are
numbered inside a bucket, and bucket totals (at most `buckets` rows per group) give the offsets.
`running_total` does the same over range partitions for an arbitrary order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.functions.hashing import hash_uniform
from tagweave.session import cut_lineage

TOP_ROWS = 100_000
DRAWN_SHARE = 64
_BEFORE = (Window.unboundedPreceding, -1)


def hash_index(df: DataFrame, key: str, group=(), seed="row", buckets: int | None = None, out: str = "row_no") -> DataFrame:
    """0-based dense row number in the order of (hash_uniform(seed, key), key) within `group`.

    The order is that of a seeded shuffle, so the number doubles as a shuffled position. The number of buckets changes
    the plan but not the result.
    """
    group = list(group)
    if buckets is None:
        buckets = max(1024, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    u = hash_uniform(seed, key)
    bucket = F.coalesce(F.floor(F.col("_u") * buckets).cast("int"), F.lit(0))
    marked = df.withColumn("_u", u).withColumn("_b", bucket)
    per_bucket = Window.partitionBy(*group, "_b").orderBy("_u", key)
    numbered = marked.withColumn("_r", F.row_number().over(per_bucket) - 1)
    offsets = bucket_offsets(marked, group)
    return (numbered.join(offsets, group + ["_b"])
                    .withColumn(out, (F.col("_off") + F.col("_r")).cast("long"))
                    .drop("_u", "_b", "_r", "_off"))


def bucket_offsets(marked: DataFrame, group) -> DataFrame:
    counts = marked.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_b").rowsBetween(*_BEFORE)
    return counts.select(*group, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))


def find_rows(draws: DataFrame, rows: DataFrame, key: str, n_draws: int, group=(), n_rows: int | None = None,
              seed="row") -> DataFrame:
    """`draws` with the `key` of the row that has their `row_no` in `hash_index(rows, key, group, seed)`, without numbering all rows.

    The hash order is cut into far more buckets than there are draws. One aggregate counts the rows per group and bucket; a draw
    finds its bucket in two steps of about sqrt(buckets) counts each, and only rows of buckets that were drawn are sorted
    and numbered. What remains per row is its hash, a count and a look at the list of drawn buckets. Where `n_rows` says that the
    table has fewer than DRAWN_SHARE rows per draw, most of it would be drawn, and all of it is numbered.
    """
    group = list(group)
    if n_rows is not None and n_rows < DRAWN_SHARE * n_draws:
        return draws.join(hash_index(rows, key, group, seed), [*group, "row_no"])
    side = max(32, min(1024, math.isqrt(DRAWN_SHARE * max(1, n_draws)) + 1))
    buckets = side * side
    marked = rows.withColumn("_u", hash_uniform(seed, key)).withColumn(
        "_b", F.coalesce(F.floor(F.col("_u") * buckets).cast("int"), F.lit(0))).withColumn("_all", F.lit(0))
    of = ["_all", *group]
    counts = marked.groupBy(*of, "_b").agg(F.count(F.lit(1)).alias("n")).withColumn("_c", F.floor(F.col("_b") / side).cast("int"))
    fine = counts.groupBy(*of, "_c").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.col("_b").alias("at"), "n"))).alias("_fine"))
    coarse = fine.groupBy(*of).agg(F.sort_array(F.collect_list(F.struct(F.col("_c").alias("at"), "n"))).alias("_coarse"))

    def place(steps: str, number: str) -> Column:
        """(at, off): the entry that holds a number, and how many rows stand before it."""
        def walk(seen, step):
            gone = seen["off"] + step["n"]
            advance = F.struct(gone.alias("off"), seen["at"].alias("at"))
            stop = F.struct(seen["off"].alias("off"), step["at"].alias("at"))
            return F.when(seen["at"] >= 0, seen).when(gone <= F.col(number), advance).otherwise(stop)
        return F.aggregate(steps, F.struct(F.lit(0).cast("long").alias("off"), F.lit(-1).alias("at")), walk)

    near = (draws.withColumn("_all", F.lit(0)).join(coarse, of).withColumn("_f", place("_coarse", "row_no"))
            .withColumn("_c", F.col("_f.at")).withColumn("_rest", F.col("row_no") - F.col("_f.off")).drop("_coarse", "_f"))
    target = (near.join(fine.drop("n"), [*of, "_c"]).withColumn("_f", place("_fine", "_rest"))
              .withColumn("_b", F.col("_f.at")).withColumn("_r", F.col("_rest") - F.col("_f.off")).drop("_fine", "_f", "_c", "_rest"))
    per_bucket = Window.partitionBy(*of, "_b").orderBy("_u", key)
    drawn = (marked.select(*of, "_b", "_u", key).join(target.select(*of, "_b").distinct(), [*of, "_b"], "left_semi")
             .withColumn("_r", (F.row_number().over(per_bucket) - 1).cast("long")))
    return target.join(drawn.drop("_u"), [*of, "_b", "_r"]).drop("_all", "_b", "_r")


def running_total(df: DataFrame, order_by, totals: dict[str, str], group=()) -> DataFrame:
    """Exact sum over all earlier rows of the group, for each {source column: output column}.

    `order_by` must be unique within `group`. Rows are range partitioned on what they actually hold, so no partition
    depends on the size of a group; the partitioned copy is checkpointed because partition numbers are used as keys.
    """
    group, order_by = list(group), list(order_by)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(parts, *group, *order_by).withColumn("_p", F.spark_partition_id()))
    inside = Window.partitionBy(*group, "_p").orderBy(*order_by).rowsBetween(*_BEFORE)
    local = ranged.withColumns({o: F.coalesce(F.sum(c).over(inside), F.lit(0)) for c, o in totals.items()})
    sums = ranged.groupBy(*group, "_p").agg(*[F.sum(c).alias(f"_s_{o}") for c, o in totals.items()])
    earlier = Window.partitionBy(*group).orderBy("_p").rowsBetween(*_BEFORE)
    offsets = sums.select(*group, "_p", *[F.coalesce(F.sum(f"_s_{o}").over(earlier), F.lit(0)).alias(f"_o_{o}")
                                          for o in totals.values()])
    joined = local.join(offsets, group + ["_p"])
    return (joined.withColumns({o: F.col(o) + F.col(f"_o_{o}") for o in totals.values()})
                  .drop("_p", *[f"_o_{o}" for o in totals.values()]))


def first_rows(df: DataFrame, order_by, key: str, m: int | None) -> DataFrame:
    """The m first rows by (`order_by` expression, key); None orders the whole table.

    Few rows are one top-k; many are numbered over range partitions and filtered, so that no task holds them all.
    """
    if m is None:
        return df.orderBy(order_by, key)
    if m <= TOP_ROWS:
        return df.orderBy(order_by, key).limit(m)
    ranked = ordered_index(df.withColumn("_order", order_by), ["_order", key], out="_rank")
    return ranked.where(F.col("_rank") < m).drop("_order", "_rank")


def ordered_index(df: DataFrame, order_by, group=(), out: str = "row_no") -> DataFrame:
    """0-based dense row number in an arbitrary unique order."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running_total(one, order_by, {"_one": out}, group).drop("_one")
