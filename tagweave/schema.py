"""The label table: which columns are bookkeeping and which are classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID = "item_id"
# Column names that never hold a class.
PROTECTED = ("filepath", "exclude", "viewpath", "validation", "subset")


def class_columns(df: DataFrame, classes=None, id_col: str = ID) -> list[str]:
    """Every column that is neither protected nor the key, or the explicit list."""
    if classes is not None:
        missing = [c for c in classes if c not in df.columns]
        if missing:
            raise ValueError(f"not in the label table: {missing}")
        return list(classes)
    return [c for c in df.columns if c not in PROTECTED and c != id_col]


def is_true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def melt_classes(df: DataFrame, classes, keep, value="value", prefix="") -> DataFrame:
    """Long form `keep…, class, value`: one row per kept row and class, no shuffle."""
    return df.unpivot(list(keep), [F.col(f"{prefix}{c}").cast("double").alias(c) for c in classes], "class", value)
