"""Writing labels, scores, runs and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.schema import ID, class_columns

# The metrics a run keeps, and the groups of its settings.
LOGGED_METRICS = ("accuracy", "base_rate", "prob_above_base_rate", "auc")
PARAM_GROUPS = ("model", "input", "augment")


def labels_to_save(df: DataFrame, only_labeled: bool = False, classes=None, id_col: str = ID) -> DataFrame:
    if not only_labeled:
        return df
    known = [F.col(c).isNotNull() for c in class_columns(df, classes, id_col)]
    return df.where(reduce(lambda a, b: a | b, known))


def save_labels(df: DataFrame, path: str, only_labeled: bool = False, classes=None, id_col: str = ID) -> None:
    labels_to_save(df, only_labeled, classes, id_col).write.mode("overwrite").option("header", "true").option("emptyValue", '""').csv(path)


def load_labels(spark: SparkSession, path: str, classes, id_col: str = ID) -> DataFrame:
    """A saved label table, by its header: id, flags and classes get their types, other columns stay text."""
    text = spark.read.option("header", "true").option("emptyValue", "").csv(path)
    kinds = {id_col: "long", "exclude": "boolean", "validation": "boolean", **{c: "double" for c in classes}}
    return text.select([F.col(f"`{c}`").cast(kinds.get(c, "string")).alias(c) for c in text.columns])


def save_predictions(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.parquet(path)


def flatten_metrics(nested: DataFrame, metrics: str = "metrics") -> DataFrame:
    """(…, MAP<class, MAP<metric, text>>) to rows (…, name, value): name is class_metric, value the number before the
    first space."""
    keep = [c for c in nested.columns if c != metrics]
    per_class = nested.select(*keep, F.explode(metrics).alias("class", "_m"))
    rows = per_class.select(*keep, "class", F.explode("_m").alias("metric", "_v"))
    return rows.where(F.col("metric").isin(*LOGGED_METRICS)).select(
        *keep, F.concat_ws("_", "class", "metric").alias("name"),
        F.element_at(F.split("_v", " "), 1).cast("double").alias("value"))


def log_metrics(metrics: DataFrame, path: str) -> None:
    """Append rows (run_id, step, name, value)."""
    metrics.select("run_id", F.col("step").cast("long").alias("step"), "name", "value").write.mode("append").parquet(path)


def log_run(spark: SparkSession, run_id: str, params: dict, path: str) -> None:
    """Append the settings of one run; nested groups model, input, augment and free top-level keys."""
    rows = []
    for key, value in params.items():
        if key in PARAM_GROUPS and isinstance(value, dict):
            rows += [(run_id, key, k, str(v)) for k, v in value.items()]
        else:
            rows.append((run_id, "run", key, str(value)))
    spark.createDataFrame(rows, "run_id string, grp string, name string, value string").coalesce(1).write.mode(
        "append").parquet(path)


def save_round(tables: dict[str, DataFrame], path: str, round_no: int) -> None:
    """Write the tables of a labelling round (labels, scores, …) next to the earlier rounds."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/round={round_no}")


def load_round(spark: SparkSession, path: str, name: str, round_no: int | None = None) -> DataFrame:
    """A table as of one round; by default the newest."""
    every = spark.read.parquet(f"{path}/{name}")
    if round_no is None:
        round_no = every.agg(F.max("round")).first()[0]
    return every.where(F.col("round") == round_no).drop("round")
