"""Label tables from paths, records, pairs and file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.schema import ID, PROTECTED

MAX_CLASSES = 2000


def prep_label_table(paths: DataFrame, classes) -> DataFrame:
    """A fresh label table: nothing excluded, nothing in validation, every class unknown."""
    return paths.select("*", F.lit(False).alias("exclude"), F.lit(False).alias("validation"),
                        *[F.lit(None).cast("double").alias(c) for c in classes])


def labels_from_records(df: DataFrame, record: str = "record", classes=None, id_col: str = ID) -> DataFrame:
    """Ragged records (JSON text or MAP<STRING,STRING>) to a label table. A missing key is an unknown label.

    With `classes` only those are kept, in order filepath, exclude, validation, classes; otherwise every key found becomes
    a column (the distinct keys are read once; more than MAX_CLASSES is an error).
    """
    if isinstance(df.schema[record].dataType, T.StringType):
        df = df.withColumn(record, F.from_json(record, "map<string,string>"))
    keep_subset = classes is None
    if classes is None:
        keys = df.select(F.explode(F.map_keys(record)).alias("k")).distinct().limit(MAX_CLASSES + 1).collect()
        if len(keys) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} distinct keys; pass classes")
        found = sorted(r["k"] for r in keys)
        classes = [k for k in found if k not in PROTECTED]
        keep_subset = "subset" in found

    def text(name: str) -> Column:
        return F.element_at(F.col(record), F.lit(name))

    def flag(name: str) -> Column:
        return F.coalesce(F.lower(text(name)).isin("true", "1", "1.0"), F.lit(False))

    cols = [F.col(id_col), F.coalesce(text("filepath"), F.lit("")).alias("filepath"), flag("exclude").alias("exclude"),
            flag("validation").alias("validation")]
    if keep_subset:
        cols.append(text("subset").alias("subset"))
    return df.select(*cols, *[text(c).cast("double").alias(c) for c in classes])


def labels_from_pairs(df: DataFrame, path: str = "filepath", label: str = "label") -> DataFrame:
    """path -> category; a comma separates the two inputs of a pair."""
    parts = F.split(F.col(path), ",")
    return df.select(F.element_at(parts, 1).alias("filepath_0"),
                     F.when(F.size(parts) > 1, F.element_at(parts, 2)).alias("filepath_1"),
                     F.col(label).cast("string").alias("label"))


def image_type_code(path) -> Column:
    """png 0, jpg 1, gif 2, tif 3 by substring of the lower-cased path."""
    p = F.lower(path)
    return (F.when(p.contains(".jpg") | p.contains("jpeg"), 1).when(p.contains(".gif"), 2)
             .when(p.contains(".tif"), 3).otherwise(0))


def file_manifest(source, path: str = "filepath") -> DataFrame:
    """One row per file with type code, parent and grandparent folder (NULL where the path is too short).

    `source` is a table with a path column, or (session, folder) for a recursive listing that never opens the files.
    """
    if isinstance(source, tuple):
        spark, folder = source
        source = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
                  .select(F.col("path").alias(path), "length", "modificationTime"))
    parts = F.split(F.col(path), "/")
    return source.select("*", image_type_code(F.col(path)).alias("type_code"),
                         F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(-2))).alias("parent"),
                         F.when(F.size(parts) > 2, F.try_element_at(parts, F.lit(-3))).alias("grandparent"))


def labels_from_path(df: DataFrame, keywords, path: str = "filepath", out: str = "label") -> DataFrame:
    """1 where any keyword is a substring of the path, else 0."""
    words = F.array(*[F.lit(k) for k in keywords])
    return df.withColumn(out, F.exists(words, lambda w: F.col(path).contains(w)).cast("double"))
