"""The tables the operators work on, derived from the given ones; as DataFrames and as SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.hashing import hash_uniform
from tagweave.functions.vectors import as_double, l2_normalize

CLASSES = ["quality", "toxic"]
TASKS = ["lang", "source"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def label_table(spark, sf) -> DataFrame:
    d, lab = table(spark, sf, "documents").select("doc_id", "lang", "source"), table(spark, sf, "labels")
    j = d.join(lab, "doc_id", "left")
    path = F.concat(F.lit("doc/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return j.select(F.col("doc_id").alias("item_id"), path.alias("filepath"), (F.col("doc_id") % 17 == 0).alias("exclude"),
                    (F.col("doc_id") % 5 == 0).alias("validation"), F.col("source").alias("subset"),
                    F.col("quality").cast("double").alias("quality"),
                    F.when(F.col("doc_id") % 7 != 3, F.col("toxic").cast("double")).alias("toxic"))


def pred_table(spark, sf, tag: str = "") -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("item_id"), *[hash_uniform(tag + c, "doc_id", digits=8).alias(c) for c in CLASSES])


def task_table(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("item_id"), *[F.when(F.col("doc_id") % 7 != 3, F.col(t)).alias(t) for t in TASKS])


def embed_table(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("item_id"), "embedding", "label",
                    F.when(F.col("vec_id") % 3 == 0, (F.col("label") % 2).cast("double")).alias("odd"))


def embed_labels(spark, sf) -> DataFrame:
    """Label table of the vectors with the one class `odd`."""
    e = embed_table(spark, sf)
    return e.select("item_id", F.lit("").alias("filepath"), (F.col("item_id") % 17 == 0).alias("exclude"),
                    (F.col("item_id") % 5 == 0).alias("validation"), "odd")


def view_pairs(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", as_double("embedding").alias("z1"))
    noisy = F.transform("z1", lambda x, j: x + F.lit(0.1) * (hash_uniform("v", F.col("vec_id") * 64 + j, digits=8) - 0.5))
    return e.select((F.col("vec_id") / 50).cast("long").alias("batch_id"), F.col("vec_id").alias("pair_id"), "z1",
                    noisy.alias("_n")).select("batch_id", "pair_id", "z1", l2_normalize("_n").alias("z2"))


def as_label_events(events: DataFrame) -> DataFrame:
    name = F.col("event_type")
    field = (F.when(name.isin("click", "purchase"), "quality").when(name == "view", "toxic")
              .when(name == "signup", "validation").otherwise("exclude"))
    value = F.when(F.col("event_id") % 10 == 0, F.lit(None).cast("double")).when(F.col("event_id") % 3 == 0, 1.0).otherwise(0.0)
    return events.select("event_id", "ts", (F.col("event_id") % 1000).alias("item_id"), field.alias("field"), value.alias("value"))


def label_events(spark, sf) -> DataFrame:
    return as_label_events(table(spark, sf, "events"))


def planted_table(spark, sf) -> DataFrame:
    """The vectors with a learnable signal: class item_id mod 4 adds 4 to its coordinate. `lead` marks classes 0 and 1."""
    e = embed_table(spark, sf)
    c = (F.col("item_id") % 4).cast("int")
    vec = F.transform(as_double("embedding"), lambda x, j: x * 4.0 + F.when(j == F.col("c"), 4.0).otherwise(0.0))
    return e.withColumn("c", c).select("item_id", vec.alias("embedding"), "c")


def planted_labels(spark, sf) -> DataFrame:
    """Two classes that the planted vectors determine, known for two thirds and for one half of the items."""
    p = planted_table(spark, sf)
    return p.select("item_id", F.lit("").alias("filepath"), (F.col("item_id") % 17 == 0).alias("exclude"),
                    (F.col("item_id") % 5 == 0).alias("validation"), F.concat(F.lit("s"), F.col("item_id") % 3).alias("subset"),
                    F.when(F.col("item_id") % 3 != 1, (F.col("c") < 2).cast("double")).alias("low"),
                    F.when(F.floor(F.col("item_id") / 4) % 2 == 0, (F.col("c") == 3).cast("double")).alias("last"))


PLANTED = ["low", "last"]


# ---- the same in SQL --------------------------------------------------------------------------------------------

def u(seed, *keys, digits: int = 13) -> str:
    text = " || ".join([f"'{seed}'"] + [f"':' || CAST({k} AS VARCHAR)" for k in keys])
    return f"(('0x' || substr(md5({text}), 1, {digits}))::BIGINT::DOUBLE / {16.0 ** digits:.1f}::DOUBLE)"


CTES = {
    "label_table": """SELECT d.doc_id AS item_id,
        concat('doc/', d.lang, '/', d.source, '/', CAST(d.doc_id AS VARCHAR), '.txt') AS filepath,
        (d.doc_id % 17 = 0) AS exclude, (d.doc_id % 5 = 0) AS validation, d.source AS subset,
        CAST(l.quality AS DOUBLE) AS quality, CASE WHEN d.doc_id % 7 <> 3 THEN CAST(l.toxic AS DOUBLE) END AS toxic
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "pred_table": f"SELECT doc_id AS item_id, {u('quality', 'doc_id', digits=8)} AS quality, {u('toxic', 'doc_id', digits=8)} AS toxic FROM documents",
    "pred_b": f"SELECT doc_id AS item_id, {u('bquality', 'doc_id', digits=8)} AS quality, {u('btoxic', 'doc_id', digits=8)} AS toxic FROM documents",
    "task_table": """SELECT doc_id AS item_id, CASE WHEN doc_id % 7 <> 3 THEN lang END AS lang,
        CASE WHEN doc_id % 7 <> 3 THEN source END AS source FROM documents""",
    "embed_table": """SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS embedding, label,
        CASE WHEN vec_id % 3 = 0 THEN CAST(label % 2 AS DOUBLE) END AS odd FROM embeddings""",
    "embed_labels": """SELECT item_id, (item_id % 17 = 0) AS exclude, (item_id % 5 = 0) AS validation, odd FROM embed_table""",
    "view_raw": f"""SELECT vec_id // 50 AS batch_id, vec_id AS pair_id, CAST(embedding AS DOUBLE[]) AS z1,
        list_transform(CAST(embedding AS DOUBLE[]), lambda x, j: x + 0.1::DOUBLE * ({u('v', 'vec_id * 64 + j - 1', digits=8)} - 0.5::DOUBLE)) AS n
        FROM embeddings""",
    "view_pairs": """SELECT batch_id, pair_id, z1,
        list_transform(n, lambda x: x / sqrt(list_dot_product(n, n))) AS z2 FROM view_raw""",
    "views": """SELECT batch_id, pair_id, 0 AS view, z1 AS z FROM view_pairs
        UNION ALL SELECT batch_id, pair_id, 1 AS view, z2 AS z FROM view_pairs""",
    "label_events": """SELECT event_id, ts, event_id % 1000 AS item_id,
        CASE WHEN event_type IN ('click', 'purchase') THEN 'quality' WHEN event_type = 'view' THEN 'toxic'
             WHEN event_type = 'signup' THEN 'validation' ELSE 'exclude' END AS field,
        CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value
        FROM events""",
    "scored": """SELECT l.*, p.quality AS pred_quality, p.toxic AS pred_toxic
        FROM label_table l JOIN pred_table p ON l.item_id = p.item_id""",
    "known": """SELECT item_id, validation, 'quality' AS class, quality AS y, pred_quality AS p FROM scored WHERE quality IS NOT NULL
        UNION ALL SELECT item_id, validation, 'toxic' AS class, toxic AS y, pred_toxic AS p FROM scored WHERE toxic IS NOT NULL""",
}
_NEEDS = {"embed_labels": ["embed_table"], "view_pairs": ["view_raw"], "views": ["view_pairs"],
          "scored": ["label_table", "pred_table"], "known": ["scored"]}


def sql(*names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """WITH the named fixtures (and their needs), then `extra` CTEs, then the body."""
    ordered: list[str] = []

    def need(n):
        for d in _NEEDS.get(n, []):
            need(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        need(n)
    parts = [f"{n} AS ({CTES[n]})" for n in ordered] + [f"{n} AS ({t})" for n, t in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def entropy_sql(p: str) -> str:
    q = f"least(greatest({p}, 1e-5::DOUBLE), 0.99999::DOUBLE)"
    return f"(-({q} * log2({q}) + (1.0::DOUBLE - {q}) * log2(1.0::DOUBLE - {q})))"


def bce_sql(y: str, p: str) -> str:
    q = f"least(greatest({p}, 1e-7::DOUBLE), 1.0::DOUBLE - 1e-7::DOUBLE)"
    return f"(-(({y}) * ln({q}) + (1.0::DOUBLE - ({y})) * ln(1.0::DOUBLE - {q})))"


UNLABELED = "(quality IS NULL AND toxic IS NULL)"
LABELED = "(quality IS NOT NULL AND toxic IS NOT NULL)"
