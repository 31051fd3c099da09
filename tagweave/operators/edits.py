"""Label edits as an event log: the last write per item and column wins, and writing NULL counts as a write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.schema import ID, class_columns

BOOLEAN_FIELDS = ("exclude", "validation")


def latest_edits(events: DataFrame, fields, id_col: str = ID, order=("ts", "event_id")) -> DataFrame:
    """One row per item; per field a struct (order…, value) of the last write, NULL where never written.

    A plain map-side combined aggregate: an item with very many events is reduced before the shuffle.
    """
    def last(field):
        write = F.struct(*[F.col(o) for o in order], F.col("value").cast("double").alias("value"))
        return F.max(F.when(F.col("field") == field, write)).alias(field)

    return events.groupBy(id_col).agg(*[last(f) for f in fields])


def merge_latest(a: DataFrame, fields, id_col: str = ID) -> DataFrame:
    """Combine several `latest_edits` tables (unioned) into one."""
    return a.groupBy(id_col).agg(*[F.max(f).alias(f) for f in fields])


def apply_latest(labels: DataFrame, latest: DataFrame, fields, id_col: str = ID) -> DataFrame:
    renamed = latest.select(id_col, *[F.col(f).alias(f"_e_{f}") for f in fields])
    joined = labels.join(renamed, id_col, "left")
    cols = []
    for c in labels.columns:
        if c not in fields:
            cols.append(F.col(c))
            continue
        written = F.col(f"_e_{c}").isNotNull()
        value = F.col(f"_e_{c}.value")
        if c in BOOLEAN_FIELDS:
            value = F.coalesce(value == 1.0, F.lit(False))
        cols.append(F.when(written, value).otherwise(F.col(c)).alias(c))
    return joined.select(*cols)


def apply_label_events(labels: DataFrame, events: DataFrame, classes=None, id_col: str = ID,
                       order=("ts", "event_id")) -> DataFrame:
    """Apply (item, field, value, ts, event_id) edits. NULL in a boolean field means false."""
    fields = [f for f in (*BOOLEAN_FIELDS, *class_columns(labels, classes, id_col)) if f in labels.columns]
    return apply_latest(labels, latest_edits(events, fields, id_col, order), fields, id_col)


def set_all_events(items: DataFrame, classes, value: float | None = 0.0, id_col: str = ID) -> DataFrame:
    """Edit events that set every class of the given items to one value."""
    return items.select("ts", "event_id", id_col, F.explode(F.array(*[F.lit(c) for c in classes])).alias("field"),
                        F.lit(value).cast("double").alias("value"))


def copy_label_events(labels: DataFrame, copies: DataFrame, classes, id_col: str = ID) -> DataFrame:
    """Edit events that copy the class labels of `source_id` to each `item_id` of `copies`."""
    source = labels.select(F.col(id_col).alias("source_id"), *classes)
    return (copies.join(source, "source_id")
                  .unpivot(["ts", "event_id", id_col], list(classes), "field", "value"))


def quick_tag_events(taps: DataFrame, cls: str, id_col: str = ID, red_excludes: bool = False) -> DataFrame:
    """Border colours to edits of one class: white 0, blue 1, red unknown (and optionally excluded)."""
    value = F.when(F.col("color") == "white", 0.0).when(F.col("color") == "blue", 1.0)
    out = taps.where(F.col("color").isin("white", "blue", "red")).select(
        "ts", "event_id", id_col, F.lit(cls).alias("field"), value.alias("value"))
    if red_excludes:
        out = out.unionByName(taps.where(F.col("color") == "red").select(
            "ts", "event_id", id_col, F.lit("exclude").alias("field"), F.lit(1.0).alias("value")))
    return out
