"""Predicates and projections over the label table. Every function is a narrow transformation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.scoring import row_error
from tagweave.schema import ID, class_columns, is_true


def is_unlabeled(classes) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNull() for c in classes])


def is_fully_labeled(classes) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in classes])


def is_partially_labeled(classes) -> Column:
    return ~is_unlabeled(classes) & ~is_fully_labeled(classes)


def labeled_ids(df: DataFrame, classes=None, id_col: str = ID) -> DataFrame:
    return df.where(is_fully_labeled(class_columns(df, classes, id_col))).select(id_col)


def excluded_ids(df: DataFrame, id_col: str = ID) -> DataFrame:
    return df.where(is_true("exclude")).select(id_col)


def unavailable_ids(df: DataFrame, classes=None, id_col: str = ID) -> DataFrame:
    """Labelled or excluded. Both conditions read the same table, so their union is one filter."""
    return df.where(is_fully_labeled(class_columns(df, classes, id_col)) | is_true("exclude")).select(id_col)


def label_status_condition(status: str, classes) -> Column:
    if status == "unlabeled":
        return is_unlabeled(classes)
    if status == "partial":
        return is_partially_labeled(classes)
    if status == "labeled":
        return is_fully_labeled(classes)
    raise ValueError(f"unknown label status {status!r}")


def exclude_status_condition(status: str) -> Column:
    if status == "not excluded":
        return ~is_true("exclude")
    if status == "excluded":
        return is_true("exclude")
    if status == "validation":
        return is_true("validation")
    raise ValueError(f"unknown exclude status {status!r}")


def subset_condition(which: str, classes) -> Column:
    """`all`, `contains: X`, `doesn't contain: X`, `unlabeled: X` or `subset: Y`."""
    if which == "all":
        return F.lit(True)
    kind, _, arg = which.partition(": ")
    if kind == "subset":
        return F.coalesce(F.col("subset").cast("string") == F.lit(arg), F.lit(False))
    if kind in ("contains", "doesn't contain", "unlabeled"):
        if arg not in classes:
            raise ValueError(f"{arg!r} is not a class")
        if kind == "unlabeled":
            return F.col(arg).isNull()
        return F.coalesce(F.col(arg) == F.lit(1.0 if kind == "contains" else 0.0), F.lit(False))
    raise ValueError(f"unknown subset {which!r}")


def subset_filter(df: DataFrame, label_status: str, exclude_status: str, which: str, classes=None,
                  id_col: str = ID) -> Column:
    classes = class_columns(df, classes, id_col)
    return (label_status_condition(label_status, classes) & exclude_status_condition(exclude_status)
            & subset_condition(which, classes))


def find_subset(df: DataFrame, label_status: str, exclude_status: str, which: str = "all", classes=None,
                id_col: str = ID) -> DataFrame:
    return df.where(subset_filter(df, label_status, exclude_status, which, classes, id_col))


def in_predicted_class(preds: DataFrame, cls: str, threshold: float = 0.5, id_col: str = ID) -> DataFrame:
    return preds.where(F.col(cls) >= F.lit(float(threshold))).select(id_col)


def training_rows(df: DataFrame) -> DataFrame:
    return df.where(~is_true("exclude") & ~is_true("validation"))


def validation_rows(df: DataFrame) -> DataFrame:
    return df.where(is_true("validation"))


def null_to_minus_one(df: DataFrame, classes=None, id_col: str = ID) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0))
                           for c in class_columns(df, classes, id_col)})


def deterministic_split(df: DataFrame, k: int = 3, id_col: str = ID) -> DataFrame:
    """Every k-th row is a test row. `id_col` must be a dense row number (see ranking.ordered_index)."""
    return df.withColumn("is_test", F.pmod(F.col(id_col), F.lit(k)) == 0)


def pseudo_label(preds: DataFrame, tau: float, classes, id_col: str = ID) -> DataFrame:
    """Per class: the rounded score (y_…) and whether the score is confident (mask_…)."""
    cols = [F.col(id_col)]
    for c in classes:
        p = F.col(c)
        cols += [F.when(p > 0.5, 1.0).otherwise(0.0).alias(f"y_{c}"),
                 F.when((p >= tau) | (p <= 1.0 - tau), 1.0).otherwise(0.0).alias(f"mask_{c}")]
    return preds.select(*cols)


def row_error_score(labels: DataFrame, preds: DataFrame, classes=None, id_col: str = ID) -> DataFrame:
    """Long table item, class, label, score, error in bits, predicted class, wrong flag (known labels only)."""
    classes = class_columns(labels, classes, id_col)
    scored = align(labels.select(id_col, *classes), preds, classes, id_col)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).cast("double").alias("label"),
                                        F.col(f"pred_{c}").alias("score")) for c in classes]))
    long = scored.select(id_col, each.alias("e")).select(id_col, "e.*").where(F.col("label").isNotNull())
    predicted = F.when(F.col("score") >= 0.5, 1.0).otherwise(0.0)
    return long.select(id_col, "class", "label", "score", row_error("label", "score").alias("error"),
                       predicted.alias("predicted"), (predicted != F.col("label")).alias("wrong"))


def align(labels: DataFrame, preds: DataFrame, classes, id_col: str = ID, features: DataFrame | None = None,
          how: str = "inner") -> DataFrame:
    """Join labels, scores (renamed pred_<class>) and optionally vectors on the key."""
    renamed = preds.select(id_col, *[F.col(c).cast("double").alias(f"pred_{c}") for c in classes])
    out = labels.join(renamed, id_col, how)
    return out if features is None else out.join(features, id_col, how)


def drop_labeled(candidates: DataFrame, labels: DataFrame, classes=None, id_col: str = ID) -> DataFrame:
    """Candidates that are not fully labelled (anti join)."""
    return candidates.join(labeled_ids(labels, classes, id_col), id_col, "left_anti")


def predict_join(preds: DataFrame, fresh: DataFrame, classes, id_col: str = ID) -> DataFrame:
    """Overwrite scores where `fresh` has a row."""
    new = fresh.select(id_col, *[F.col(c).cast("double").alias(f"_new_{c}") for c in classes])
    merged = preds.join(new, id_col, "left")
    kept = [F.col(c) for c in preds.columns if c not in classes]
    return merged.select(*kept, *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) for c in classes])
