"""Category strings to integer codes per task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.operators.ranking import ordered_index


def task_values(train: DataFrame, val: DataFrame, tasks) -> DataFrame:
    """Distinct known values per task with their presence in train and in validation."""
    def side(df, flag):
        return df.unpivot([], [F.col(t).cast("string").alias(t) for t in tasks], "task", "category").select(
            "task", "category", F.lit(flag == "train").alias("in_train"), F.lit(flag == "val").alias("in_val"))

    both = side(train, "train").unionByName(side(val, "val")).where(F.col("category").isNotNull())
    return both.groupBy("task", "category").agg(F.max("in_train").alias("in_train"), F.max("in_val").alias("in_val"))


def class_codes(train: DataFrame, val: DataFrame, tasks) -> DataFrame:
    """task, category, code (0-based in sorted order), in_train, in_val."""
    values = task_values(train, val, tasks)
    return ordered_index(values, ["category"], ["task"], out="code")


def missing_classes(codes: DataFrame) -> DataFrame:
    """Values that one of the two sides lacks."""
    side = F.when(~F.col("in_train"), "train").otherwise("validation")
    return codes.where(~F.col("in_train") | ~F.col("in_val")).select("task", "category", side.alias("missing_from"))


def encode_classes(df: DataFrame, codes: DataFrame, tasks) -> DataFrame:
    """Replace each task column by its code, -1 where missing. The code table is one row per category, so the planner
    broadcasts it when small and splits hot categories otherwise."""
    def add(acc, task):
        side = codes.where(F.col("task") == task).select(F.col("category").alias(task),
                                                         F.col("code").alias(f"{task}_code"))
        return acc.join(side, task, "left").withColumn(f"{task}_code", F.coalesce(f"{task}_code", F.lit(-1)))

    return reduce(add, tasks, df)
