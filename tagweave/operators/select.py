"""What to label next: top-k queries over labels joined with scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions.hashing import hash_uniform, race_key
from tagweave.functions.scoring import binary_entropy, shannon_entropy
from tagweave.operators.filters import drop_labeled, find_subset, is_fully_labeled
from tagweave.operators.ranking import first_rows
from tagweave.schema import ID, class_columns


def pick(labels: DataFrame, preds: DataFrame | None, m: int, label_status: str = "unlabeled",
         exclude_status: str = "not excluded", sort_by: str = "random", subset_by: str = "all", classes=None,
         id_col: str = ID, seed=0, vectors: DataFrame | None = None) -> DataFrame:
    """The m rows of a subset that come first under `sort_by`, as (id, sort value `key`).

    sort_by: `random`, `max entropy`, `maxent: C`, `highest: C`, `lowest: C`, `high: C`, `low: C`, `diversity`, `BADGE`.
    Filters run before the join and only the key and the needed scores travel; wide columns are joined afterwards
    by the caller.
    """
    classes = class_columns(labels, classes, id_col)
    chosen = find_subset(labels, label_status, exclude_status, subset_by, classes, id_col).select(id_col)
    kind, _, cls = sort_by.partition(": ")
    if kind in ("diversity", "BADGE"):
        from tagweave.operators.diversity import kpp_sample
        from tagweave.operators.filters import unavailable_ids

        if vectors is None:
            raise ValueError(f"{kind} needs a vector table")
        return kpp_sample(vectors, m, unavailable=unavailable_ids(labels, classes, id_col), include=chosen,
                          seed=seed, id_col=id_col)
    if kind == "random":
        return first_rows(chosen.withColumn("key", hash_uniform(seed, id_col)), F.col("key"), id_col, m)
    if cls and cls not in classes:
        raise ValueError(f"{cls!r} is not a class")
    scored = chosen.join(preds.select(id_col, *([cls] if cls else classes)), id_col)
    if kind == "max entropy":
        key, order = shannon_entropy(classes), -F.col("key")
    elif kind == "maxent":
        key, order = binary_entropy(cls), -F.col("key")
    elif kind == "highest":
        key, order = F.col(cls), -F.col("key")
    elif kind == "lowest":
        key, order = F.col(cls), F.col("key")
    elif kind in ("high", "low"):
        p = F.col(cls) if kind == "high" else F.lit(1.0) - F.col(cls)
        key, order = race_key(seed, F.pow(p, 4), id_col), F.col("key")
    else:
        raise ValueError(f"unknown sort {sort_by!r}")
    return first_rows(scored.select(id_col, key.alias("key")).where(F.col("key").isNotNull()), order, id_col, m)


def sample_random(labels: DataFrame, n: int | None = None, classes=None, id_col: str = ID, seed=0) -> DataFrame:
    """Uniform draw without replacement among rows that are not fully labelled."""
    classes = class_columns(labels, classes, id_col)
    open_rows = labels.where(~is_fully_labeled(classes)).select(id_col)
    return first_rows(open_rows.withColumn("key", hash_uniform(seed, id_col)), F.col("key"), id_col, n)


def sample_uncertainty(labels: DataFrame, preds: DataFrame, n: int | None = None, classes=None,
                       id_col: str = ID) -> DataFrame:
    """Rows that are not fully labelled by decreasing entropy."""
    classes = class_columns(labels, classes, id_col)
    scored = drop_labeled(preds.select(id_col, shannon_entropy(classes).alias("entropy")), labels, classes, id_col)
    return first_rows(scored, -F.col("entropy"), id_col, n)


def latest_k(vectors: DataFrame, k: int, seq: str) -> DataFrame:
    """The queue after all batches were pushed: the newest k rows."""
    return first_rows(vectors, -F.col(seq), seq, k)


def first_per_class(df: DataFrame, label: str = "label", id_col: str = ID) -> DataFrame:
    """The first row of each class by key; one map-side combined minimum, not a sort per class."""
    return df.groupBy(label).agg(F.min(id_col).alias(id_col))
