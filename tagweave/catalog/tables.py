"""Sources, sinks, filters, edits, picks, set operations and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.catalog.fixtures import (CLASSES, LABELED, TASKS, UNLABELED, embed_table, entropy_sql, label_events, label_table,
                                       pred_table, sql, table, task_table, u)
from tagweave.catalog.registry import query, rounded
from tagweave.functions.scoring import (clip_unit, label_smoothing, rescale_unit,
                                        shannon_entropy)
from tagweave.functions.text import pad_tokens
from tagweave.functions.vectors import cosine_distance, dot, sq_euclid
from tagweave.operators import corpus, edits, encode, filters, metrics, select
from tagweave.operators.ranking import ordered_index
from tagweave.schema import class_columns
from tagweave.session import scratch_path
from tagweave.sources import items, labels as label_sources, store

CLIP = "least(greatest(quality, 0.05::DOUBLE), 0.95::DOUBLE)"


# ---- A: sources and sinks ---------------------------------------------------------------------------------------

@query("a01_prep_label_table", sql("label_table", body="""
    SELECT item_id, filepath, false AS exclude, false AS validation, CAST(NULL AS DOUBLE) AS quality,
           CAST(NULL AS DOUBLE) AS toxic FROM label_table"""))
def _(spark, sf):
    return label_sources.prep_label_table(label_table(spark, sf).select("item_id", "filepath"), CLASSES)


def _records(spark, sf):
    t = label_table(spark, sf)
    return t.select("item_id", F.to_json(F.struct("filepath", "exclude", "validation", *CLASSES)).alias("record"))


@query("a02_labels_from_records", sql("label_table", body="""
    SELECT item_id, filepath, exclude, validation, quality, toxic FROM label_table"""))
def _(spark, sf):
    return label_sources.labels_from_records(_records(spark, sf), classes=CLASSES)


@query("a02_labels_from_records_all_keys", sql("label_table", body="""
    SELECT item_id, filepath, exclude, validation, quality, toxic FROM label_table"""))
def _(spark, sf):
    return label_sources.labels_from_records(_records(spark, sf))


@query("a03_labels_from_pairs", sql("label_table", body="""
    SELECT split_part(p, ',', 1) AS filepath_0, CASE WHEN contains(p, ',') THEN split_part(p, ',', 2) END AS filepath_1,
           subset AS label
    FROM (SELECT CASE WHEN item_id % 4 = 0 THEN filepath || ',' || 'alt/' || filepath ELSE filepath END AS p, subset
          FROM label_table)"""))
def _(spark, sf):
    t = label_table(spark, sf)
    pair = F.concat(F.col("filepath"), F.lit(",alt/"), F.col("filepath"))
    return label_sources.labels_from_pairs(
        t.select(F.when(F.col("item_id") % 4 == 0, pair).otherwise(F.col("filepath")).alias("filepath"),
                 F.col("subset").alias("label")))


@query("a04_file_manifest", """
    SELECT page_id AS item_id, filepath,
      CASE WHEN contains(lower(filepath), '.jpg') OR contains(lower(filepath), 'jpeg') THEN 1
           WHEN contains(lower(filepath), '.gif') THEN 2 WHEN contains(lower(filepath), '.tif') THEN 3 ELSE 0 END AS type_code,
      CASE WHEN len(string_split(filepath, '/')) > 1 THEN string_split(filepath, '/')[-2] END AS parent,
      CASE WHEN len(string_split(filepath, '/')) > 2 THEN string_split(filepath, '/')[-3] END AS grandparent
    FROM (SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' WHEN 2 THEN '.JPEG'
                                      WHEN 3 THEN '.gif' ELSE '.tiff' END AS filepath FROM pages)""")
def _(spark, sf):
    endings = F.array(*[F.lit(e) for e in (".PNG", ".jpg", ".JPEG", ".gif", ".tiff")])
    files = table(spark, sf, "pages").select(F.col("page_id").alias("item_id"), F.concat(
        F.col("url"), F.element_at(endings, (F.col("page_id") % 5 + 1).cast("int"))).alias("filepath"))
    return label_sources.file_manifest(files)


@query("a05_labels_from_path", sql("label_table", body="""
    SELECT item_id, CASE WHEN contains(filepath, '/en/') OR contains(filepath, 'src5') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label
    FROM label_table"""))
def _(spark, sf):
    return label_sources.labels_from_path(label_table(spark, sf), ["/en/", "src5"]).select("item_id", "label")


@query("a06_read_embeddings", """
    SELECT vec_id AS item_id, j - 1 AS j, round(x[j] / sqrt(list_dot_product(x, x)), 6) AS value
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) t, (SELECT unnest(range(1, 65))::INTEGER AS j) r""")
def _(spark, sf):
    e = items.read_embeddings(spark, f"{sf}/embeddings.parquet")
    return rounded(e.select(F.col("vec_id").alias("item_id"), F.posexplode("embedding").alias("j", "value")), "value")


@query("a06_read_embeddings_cut", """
    SELECT item_id, cell, round(list_sum(list_transform(x, lambda v: v / sqrt(list_dot_product(x, x)))), 6) AS total
    FROM (SELECT vec_id AS item_id, c::INTEGER AS cell, CAST(embedding AS DOUBLE[])[c * 16 + 1 : c * 16 + 16] AS x
          FROM embeddings, (SELECT unnest(range(0, 4)) AS c) r)""")
def _(spark, sf):
    e = items.read_embeddings(spark, f"{sf}/embeddings.parquet", dim=16)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return rounded(e.select(F.col("vec_id").alias("item_id"), "cell", total.alias("total")), "total")


@query("a07_scan_items_batches", "SELECT CAST(ceil(count(*) / 32.0) AS BIGINT) AS num_batches FROM documents")
def _(spark, sf):
    return items.batch_count(items.scan_items(spark, f"{sf}/documents.parquet"), 32)


@query("a07_scan_items_shuffled", f"""
    SELECT item_id, position, position // 32 AS batch_no FROM (
      SELECT doc_id AS item_id, row_number() OVER (ORDER BY {u('epoch', 'doc_id')}, doc_id) - 1 AS position FROM documents)""")
def _(spark, sf):
    docs = items.scan_items(spark, f"{sf}/documents.parquet").withColumnRenamed("doc_id", "item_id")
    return items.shuffled_batches(docs, 32, "epoch").select("item_id", "position", "batch_no")


@query("a07_scan_items_with_labels", """
    SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def _(spark, sf):
    docs = items.scan_items(spark, f"{sf}/documents.parquet", table(spark, sf, "labels"), id_col="doc_id")
    return docs.select("doc_id", "lang", "quality")


@query("a08_save_sharded", sql("label_table", body=f"""
    SELECT CAST(floor({u('0:shard', 'item_id')} * 8) AS INTEGER) AS shard, count(*) AS n, CAST(sum(item_id) AS BIGINT) AS ids
    FROM label_table GROUP BY 1"""))
def _(spark, sf):
    path = scratch_path(spark, "shards")
    items.save_sharded(label_table(spark, sf), path, 8)
    back = items.load_sharded(spark, path, lambda d: d.withColumn("seen", F.lit(1)))
    return back.groupBy("shard").agg(F.sum("seen").alias("n"), F.sum("item_id").alias("ids"))


@query("a09_prompt_features", """
    SELECT d.doc_id AS item_id, concat(d.lang, '/', d.source) AS prompt, len(e.embedding) AS dim,
           round(CAST(e.embedding[1] AS DOUBLE), 6) AS first_value
    FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id""")
def _(spark, sf):
    path = scratch_path(spark, "prompts")
    prompts = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.concat_ws("/", "lang", "source").alias("prompt"))
    items.save_prompt_features(prompts, embed_table(spark, sf), path, 4)
    back = items.load_prompt_features(spark, path)
    return rounded(back.select("item_id", "prompt", F.size("embedding").cast("long").alias("dim"),
                               F.element_at("embedding", 1).cast("double").alias("first_value")), "first_value")


@query("a10_save_labels", sql("label_table", body="SELECT * FROM label_table WHERE quality IS NOT NULL OR toxic IS NOT NULL"))
def _(spark, sf):
    path = scratch_path(spark, "labels")
    store.save_labels(label_table(spark, sf), path, only_labeled=True)
    return store.load_labels(spark, path, CLASSES)


@query("a11_save_predictions", sql("pred_table", body="""
    SELECT item_id, round(quality, 6) AS quality, round(toxic, 6) AS toxic FROM pred_table"""))
def _(spark, sf):
    path = scratch_path(spark, "preds")
    store.save_predictions(pred_table(spark, sf), path, "csv")
    back = spark.read.option("header", "true").schema("item_id long, quality double, toxic double").csv(path)
    return rounded(back, *CLASSES)


_COUNTS = """SELECT class, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p < 0.5) AS tn,
    count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn
    FROM known WHERE validation GROUP BY class"""
_ESTIMATE = f"""SELECT *, (5.0::DOUBLE + tp + tn) / (10.0::DOUBLE + tp + tn + fp + fn) AS accuracy,
    greatest((tp + fn) / (tp + tn + fp + fn)::DOUBLE, 1.0::DOUBLE - (tp + fn) / (tp + tn + fp + fn)::DOUBLE) AS base_rate
    FROM ({_COUNTS}) WHERE tp + fn > 0 AND tn + fp > 0"""


@query("a12_log_metrics", sql("known", body=f"""
    SELECT 'r1' AS run_id, CAST(7 AS BIGINT) AS step, class || '_accuracy' AS name, round(accuracy, 3) AS value FROM ({_ESTIMATE})
    UNION ALL SELECT 'r1', CAST(7 AS BIGINT), class || '_base_rate', round(base_rate, 3) FROM ({_ESTIMATE})"""))
def _(spark, sf):
    path = scratch_path(spark, "metrics")
    counts = metrics.confusion_counts(label_table(spark, sf), pred_table(spark, sf), 0.5, CLASSES)
    text = metrics.accuracy_estimate(counts, as_text=True)
    inner = F.create_map(F.lit("accuracy"), F.col("accuracy"), F.lit("base_rate"), F.col("base_rate"),
                         F.lit("not_logged"), F.lit("1.0"))
    nested = text.select(F.lit("r1").alias("run_id"), F.lit(7).alias("step"), F.create_map(F.col("class"), inner).alias("metrics"))
    store.log_metrics(store.flatten_metrics(nested), path)
    return spark.read.parquet(path)


def auc_sql(rows: str, keys: str = "class") -> str:
    """Rank-sum AUC with averaged ties over (keys, y, p)."""
    return f"""SELECT {keys}, CASE WHEN np > 0 AND nn > 0 THEN w / (np * nn) ELSE 0.0::DOUBLE END AS auc,
        CASE WHEN np > 0 AND nn > 0 THEN hits / (np + nn) ELSE 0.0::DOUBLE END AS accuracy, np AS n_pos, nn AS n_neg FROM (
        SELECT {keys}, sum(CASE WHEN y = 1 THEN r ELSE 0.0::DOUBLE END) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1.0::DOUBLE) / 2.0::DOUBLE AS w,
               count(*) FILTER (y = 1) AS np, count(*) FILTER (y = 0) AS nn,
               (count(*) FILTER ((p >= 0.5) = (y = 1)))::DOUBLE AS hits
        FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY p)
                     + (count(*) OVER (PARTITION BY {keys}, p) - 1.0::DOUBLE) / 2.0::DOUBLE AS r FROM ({rows}))
        GROUP BY {keys})"""


@query("a13_run_summary", sql("known", body=f"""
    SELECT class, nv AS num_validation_points, n - nu - nv AS num_training_points, round(auc, 6) AS val_auc, round(accuracy, 6) AS val_acc
    FROM ({auc_sql("SELECT * FROM known WHERE validation")}),
         (SELECT count(*) AS n, count(*) FILTER {UNLABELED} AS nu, count(*) FILTER (validation) AS nv FROM label_table)"""))
def _(spark, sf):
    return rounded(metrics.run_summary(label_table(spark, sf), pred_table(spark, sf), CLASSES), "val_auc", "val_acc")


# ---- B: predicates, projections, edits --------------------------------------------------------------------------

@query("b01_class_columns", sql("label_table", body="""
    SELECT 'quality' AS class, count(quality) AS n_known FROM label_table
    UNION ALL SELECT 'toxic', count(toxic) FROM label_table"""))
def _(spark, sf):
    t = label_table(spark, sf)
    return metrics.tag_summary(t, class_columns(t)).select("class", (F.col("n_neg") + F.col("n_pos")).alias("n_known"))


for _name, _cond, _where in (("b02_is_unlabeled", filters.is_unlabeled, UNLABELED),
                             ("b03_is_fully_labeled", filters.is_fully_labeled, LABELED),
                             ("b04_is_partially_labeled", filters.is_partially_labeled, f"NOT {UNLABELED} AND NOT {LABELED}")):
    @query(_name, sql("label_table", body=f"SELECT item_id FROM label_table WHERE {_where}"))
    def _(spark, sf, cond=_cond):
        return label_table(spark, sf).where(cond(CLASSES)).select("item_id")


@query("b05_labeled_ids", sql("label_table", body=f"SELECT item_id FROM label_table WHERE {LABELED}"))
def _(spark, sf):
    return filters.labeled_ids(label_table(spark, sf), CLASSES)


@query("b05_excluded_ids", sql("label_table", body="SELECT item_id FROM label_table WHERE exclude"))
def _(spark, sf):
    return filters.excluded_ids(label_table(spark, sf))


_SUBSETS = {
    "unlabeled_all": (("unlabeled", "not excluded", "all"), f"{UNLABELED} AND NOT exclude"),
    "labeled_contains": (("labeled", "not excluded", "contains: toxic"), f"{LABELED} AND NOT exclude AND toxic = 1"),
    "labeled_lacks": (("labeled", "not excluded", "doesn't contain: quality"), f"{LABELED} AND NOT exclude AND quality = 0"),
    "partial_unlabeled_class": (("partial", "not excluded", "unlabeled: toxic"),
                                f"NOT {UNLABELED} AND NOT {LABELED} AND NOT exclude AND toxic IS NULL"),
    "excluded_all": (("unlabeled", "excluded", "all"), f"{UNLABELED} AND exclude"),
    "validation_subset": (("labeled", "validation", "subset: src5"), f"{LABELED} AND validation AND subset = 'src5'"),
}
for _name, (_args, _where) in _SUBSETS.items():
    @query(f"b06_find_subset_{_name}", sql("label_table", body=f"SELECT item_id FROM label_table WHERE {_where}"))
    def _(spark, sf, args=_args):
        return filters.find_subset(label_table(spark, sf), *args, classes=CLASSES).select("item_id")


@query("b07_in_predicted_class", sql("pred_table", body="SELECT item_id FROM pred_table WHERE toxic >= 0.7"))
def _(spark, sf):
    return filters.in_predicted_class(pred_table(spark, sf), "toxic", 0.7)


@query("b08_training_rows", sql("label_table", body="SELECT item_id FROM label_table WHERE NOT exclude AND NOT validation"))
def _(spark, sf):
    return filters.training_rows(label_table(spark, sf)).select("item_id")


@query("b08_validation_rows", sql("label_table", body="SELECT item_id FROM label_table WHERE validation"))
def _(spark, sf):
    return filters.validation_rows(label_table(spark, sf)).select("item_id")


@query("b09_null_to_minus_one", sql("label_table", body="""
    SELECT item_id, coalesce(quality, -1.0::DOUBLE) AS quality, coalesce(toxic, -1.0::DOUBLE) AS toxic FROM label_table"""))
def _(spark, sf):
    return filters.null_to_minus_one(label_table(spark, sf), CLASSES).select("item_id", *CLASSES)


@query("b10_deterministic_split", """
    SELECT page_id, (row_number() OVER (ORDER BY url, page_id) - 1) % 3 = 0 AS is_test FROM pages""")
def _(spark, sf):
    pages = ordered_index(table(spark, sf, "pages").select("page_id", "url"), ["url", "page_id"])
    return filters.deterministic_split(pages, 3, "row_no").select("page_id", "is_test")


_LAST = """SELECT item_id, field, arg_max(struct_pack(v := value), (ts, event_id)) AS w FROM edits GROUP BY item_id, field"""


def _applied(edit_sql: str) -> str:
    def pick(field, boolean=False):
        value = f"{field}_e.w.v"
        value = f"coalesce({value} = 1, false)" if boolean else value
        return f"CASE WHEN {field}_e.item_id IS NOT NULL THEN {value} ELSE l.{field} END AS {field}"

    joins = " ".join(f"LEFT JOIN (SELECT * FROM last WHERE field = '{f}') {f}_e ON l.item_id = {f}_e.item_id"
                     for f in ("exclude", "validation", "quality", "toxic"))
    return sql("label_table", "label_events", extra={"edits": edit_sql, "last": _LAST}, body=f"""
        SELECT l.item_id, {pick('exclude', True)}, {pick('validation', True)}, {pick('quality')}, {pick('toxic')}
        FROM label_table l {joins}""")


@query("b11_apply_label_events", _applied("SELECT item_id, field, value, ts, event_id FROM label_events"))
def _(spark, sf):
    out = edits.apply_label_events(label_table(spark, sf), label_events(spark, sf), CLASSES)
    return out.select("item_id", "exclude", "validation", *CLASSES)


@query("b11_set_all_and_copy", _applied("""
    SELECT e.item_id, c.field, 0.0::DOUBLE AS value, e.ts, e.event_id FROM label_events e,
           (SELECT unnest(['quality', 'toxic']) AS field) c WHERE e.field = 'quality'
    UNION ALL
    SELECT e.item_id, c.field, CASE WHEN c.field = 'quality' THEN l.quality ELSE l.toxic END, e.ts, e.event_id
    FROM label_events e JOIN label_table l ON l.item_id = e.event_id % 97,
         (SELECT unnest(['quality', 'toxic']) AS field) c WHERE e.field = 'toxic'"""))
def _(spark, sf):
    t, ev = label_table(spark, sf), label_events(spark, sf)
    zeros = edits.set_all_events(ev.where(F.col("field") == "quality"), CLASSES, 0.0)
    copies = ev.where(F.col("field") == "toxic").select("ts", "event_id", "item_id", (F.col("event_id") % 97).alias("source_id"))
    both = zeros.unionByName(edits.copy_label_events(t, copies, CLASSES))
    return edits.apply_label_events(t, both, CLASSES).select("item_id", "exclude", "validation", *CLASSES)


@query("b11_quick_tags", _applied("""
    SELECT item_id, 'toxic' AS field, CASE event_id % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE END AS value, ts, event_id
    FROM label_events
    UNION ALL SELECT item_id, 'exclude', 1.0::DOUBLE, ts, event_id FROM label_events WHERE event_id % 3 = 2"""))
def _(spark, sf):
    colors = F.element_at(F.array(F.lit("white"), F.lit("blue"), F.lit("red")), (F.col("event_id") % 3 + 1).cast("int"))
    taps = label_events(spark, sf).select("ts", "event_id", "item_id", colors.alias("color"))
    out = edits.apply_label_events(label_table(spark, sf), edits.quick_tag_events(taps, "toxic", red_excludes=True), CLASSES)
    return out.select("item_id", "exclude", "validation", *CLASSES)


def _codes(spark, sf):
    t = task_table(spark, sf)
    return t, encode.class_codes(t.where(F.col("item_id") % 3 != 0), t.where(F.col("item_id") % 3 == 0), TASKS)


@query("b12_encode_classes", sql("task_table", extra={
    "codes": """SELECT task, category, row_number() OVER (PARTITION BY task ORDER BY category) - 1 AS code FROM (
        SELECT DISTINCT 'lang' AS task, lang AS category FROM task_table WHERE lang IS NOT NULL
        UNION ALL SELECT DISTINCT 'source', source FROM task_table WHERE source IS NOT NULL)"""}, body="""
    SELECT t.item_id, coalesce(a.code, -1) AS lang_code, coalesce(b.code, -1) AS source_code FROM task_table t
    LEFT JOIN codes a ON a.task = 'lang' AND a.category = t.lang LEFT JOIN codes b ON b.task = 'source' AND b.category = t.source"""))
def _(spark, sf):
    t, codes = _codes(spark, sf)
    return encode.encode_classes(t, codes, TASKS).select("item_id", "lang_code", "source_code")


@query("b12_missing_classes", sql("task_table", extra={
    "side": """SELECT item_id % 3 = 0 AS val, 'item' AS task, CAST(item_id // 2 AS VARCHAR) AS category FROM task_table
        UNION ALL SELECT item_id % 3 = 0, 'lang', lang FROM task_table WHERE lang IS NOT NULL"""}, body="""
    SELECT task, category, CASE WHEN bool_and(val) THEN 'train' ELSE 'validation' END AS missing_from
    FROM side GROUP BY task, category HAVING bool_and(val) OR bool_and(NOT val)"""))
def _(spark, sf):
    t = task_table(spark, sf).withColumn("item", F.floor(F.col("item_id") / 2).cast("string"))
    tasks = ["item", "lang"]
    return encode.missing_classes(encode.task_values(t.where(F.col("item_id") % 3 != 0), t.where(F.col("item_id") % 3 == 0), tasks))


@query("b18_pseudo_label", sql("pred_table", body="""
    SELECT item_id, """ + ", ".join(f"""CASE WHEN {c} > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y_{c},
    CASE WHEN {c} >= 0.9 OR {c} <= 1.0::DOUBLE - 0.9::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mask_{c}""" for c in CLASSES) + """
    FROM pred_table"""))
def _(spark, sf):
    return filters.pseudo_label(pred_table(spark, sf), 0.9, CLASSES)


@query("b19_row_error_score", sql("known", body="""
    SELECT item_id, class, y AS label, round(p, 6) AS score,
      round(-y * log2(p + 1e-5::DOUBLE) - (1.0::DOUBLE - y) * log2(1.0::DOUBLE - p + 1e-5::DOUBLE), 6) AS error,
      CASE WHEN p >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS predicted, (p >= 0.5) <> (y = 1) AS wrong FROM known"""))
def _(spark, sf):
    return rounded(filters.row_error_score(label_table(spark, sf), pred_table(spark, sf), CLASSES), "score", "error")


@query("b20_label_smoothing", sql("label_table", body="""
    SELECT item_id, round(quality * 0.9::DOUBLE + 0.05::DOUBLE, 6) AS quality FROM label_table"""))
def _(spark, sf):
    return rounded(label_table(spark, sf).select("item_id", label_smoothing("quality", 0.1).alias("quality")), "quality")


# ---- C1, C6, C10: key joins -------------------------------------------------------------------------------------

@query("c01_align", sql("scored", body="""
    SELECT b.item_id, b.quality, round(b.pred_quality, 6) AS pred_quality, round(b.pred_toxic, 6) AS pred_toxic, e.label
    FROM scored b JOIN embeddings e ON b.item_id = e.vec_id"""))
def _(spark, sf):
    out = filters.align(label_table(spark, sf), pred_table(spark, sf), CLASSES, features=embed_table(spark, sf).select("item_id", "label"))
    return rounded(out.select("item_id", "quality", "pred_quality", "pred_toxic", "label"), "pred_quality", "pred_toxic")


@query("c06_drop_labeled", sql("label_table", body=f"SELECT doc_id AS item_id FROM documents WHERE doc_id NOT IN (SELECT item_id FROM label_table WHERE {LABELED})"))
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"))
    return filters.drop_labeled(docs, label_table(spark, sf), CLASSES)


@query("c10_predict_join", sql("label_table", "pred_table", "pred_b", body="""
    SELECT p.item_id, round(CASE WHEN l.validation THEN b.quality ELSE p.quality END, 6) AS quality,
           round(CASE WHEN l.validation THEN b.toxic ELSE p.toxic END, 6) AS toxic
    FROM pred_table p JOIN label_table l ON p.item_id = l.item_id JOIN pred_b b ON p.item_id = b.item_id"""))
def _(spark, sf):
    val = filters.validation_rows(label_table(spark, sf)).select("item_id")
    fresh = pred_table(spark, sf, "b").join(val, "item_id", "left_semi")
    return rounded(filters.predict_join(pred_table(spark, sf), fresh, CLASSES), *CLASSES)


# ---- E: picks ---------------------------------------------------------------------------------------------------

_OPEN = f"FROM label_table l JOIN pred_table p ON l.item_id = p.item_id WHERE l.quality IS NULL AND l.toxic IS NULL AND NOT l.exclude"
_BOTH_ENTROPY = f"greatest({entropy_sql('p.quality')}, {entropy_sql('p.toxic')})"
_PICKS = {
    "e01_pick_random": ("random", u("0", "l.item_id"), "ASC"),
    "e02_pick_max_entropy": ("max entropy", _BOTH_ENTROPY, "DESC"),
    "e03_pick_maxent_class": ("maxent: toxic", entropy_sql("p.toxic"), "DESC"),
    "e04_pick_highest": ("highest: quality", "p.quality", "DESC"),
    "e04_pick_lowest": ("lowest: quality", "p.quality", "ASC"),
    "e05_pick_high": ("high: toxic", f"-ln(greatest({u('0', 'l.item_id')}, 1e-16::DOUBLE)) / pow(p.toxic, 4)", "ASC"),
    "e05_pick_low": ("low: toxic", f"-ln(greatest({u('0', 'l.item_id')}, 1e-16::DOUBLE)) / pow(1.0::DOUBLE - p.toxic, 4)", "ASC"),
}
for _name, (_sort, _key, _dir) in _PICKS.items():
    @query(_name, sql("label_table", "pred_table", body=f"""
        SELECT item_id, round(key, 6) AS key FROM (SELECT l.item_id, {_key} AS key {_OPEN} ORDER BY key {_dir}, l.item_id LIMIT 20)"""))
    def _(spark, sf, sort=_sort):
        return rounded(select.pick(label_table(spark, sf), pred_table(spark, sf), 20, sort_by=sort, classes=CLASSES), "key")


@query("e07_sample_random", sql("label_table", body=f"""
    SELECT item_id, round(key, 6) AS key FROM (SELECT item_id, {u('0', 'item_id')} AS key FROM label_table WHERE NOT {LABELED}
    ORDER BY key, item_id LIMIT 40)"""))
def _(spark, sf):
    return rounded(select.sample_random(label_table(spark, sf), 40, CLASSES), "key")


@query("e08_sample_uncertainty", sql("label_table", "pred_table", body=f"""
    SELECT p.item_id, round({_BOTH_ENTROPY}, 6) AS entropy FROM pred_table p
    WHERE p.item_id NOT IN (SELECT item_id FROM label_table WHERE {LABELED})"""))
def _(spark, sf):
    return rounded(select.sample_uncertainty(label_table(spark, sf), pred_table(spark, sf), classes=CLASSES), "entropy")


@query("e09_latest_k", "SELECT vec_id, label FROM embeddings ORDER BY vec_id DESC LIMIT 128")
def _(spark, sf):
    return select.latest_k(table(spark, sf, "embeddings").select("vec_id", "label"), 128, "vec_id")


@query("e10_first_per_class", "SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label")
def _(spark, sf):
    return select.first_per_class(table(spark, sf, "embeddings"), "label", "vec_id")


# ---- G: scalar functions ----------------------------------------------------------------------------------------

@query("g01_shannon_entropy", sql("pred_table", body=f"""
    SELECT item_id, round(greatest({entropy_sql('quality')}, {entropy_sql('toxic')}), 6) AS e_max,
           round({entropy_sql('quality')} + {entropy_sql('toxic')}, 6) AS e_sum FROM pred_table"""))
def _(spark, sf):
    p = pred_table(spark, sf)
    return rounded(p.select("item_id", shannon_entropy(CLASSES).alias("e_max"), shannon_entropy(CLASSES, "sum").alias("e_sum")), "e_max", "e_sum")


@query("g02_clip_unit", sql("pred_table", body=f"""
    SELECT item_id, round({CLIP}, 6) AS clipped, round(quality * 0.9::DOUBLE + 0.05::DOUBLE, 6) AS mapped FROM pred_table"""))
def _(spark, sf):
    p = pred_table(spark, sf)
    return rounded(p.select("item_id", clip_unit("quality", 0.05).alias("clipped"), rescale_unit("quality", 0.05).alias("mapped")),
                   "clipped", "mapped")


_WARM = "list_transform(x, lambda v, j: v * (j % 3))"


@query("g03_vector_functions", f"""
    SELECT vec_id AS item_id, round(list_dot_product(x, {_WARM}), 6) AS dot, round(1 - list_cosine_similarity(x, {_WARM}), 6) AS cosine,
           round(power(list_distance(x, {_WARM}), 2), 6) AS sq_euclid
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    e = e.withColumn("y", F.transform("x", lambda v, j: v * ((j + 1) % 3)))
    return rounded(e.select(F.col("vec_id").alias("item_id"), dot("x", "y").alias("dot"), cosine_distance("x", "y").alias("cosine"),
                            sq_euclid("x", "y").alias("sq_euclid")), "dot", "cosine", "sq_euclid")


_IDS = "list_transform(range(0, doc_id % 12), lambda k: CAST(doc_id % 50 + k + 1 AS INTEGER))"


@query("g04_pad_tokens", f"""
    SELECT doc_id AS item_id,
      array_to_string(list_concat(ids[1:8], list_transform(range(0, 8 - len(ids[1:8])), lambda k: 0)), ' ') AS padded_end,
      array_to_string(list_concat(list_transform(range(0, 8 - len(ids[1:8])), lambda k: 0), ids[1:8]), ' ') AS padded_front
    FROM (SELECT doc_id, {_IDS} AS ids FROM documents)""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    n = (F.col("doc_id") % 12).cast("int")
    ids = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: (F.col("doc_id") % 50 + k + 1).cast("int")))
    d = d.withColumn("ids", F.coalesce(ids, F.array().cast("array<int>")))
    return d.select(F.col("doc_id").alias("item_id"), F.array_join(pad_tokens("ids", 8), " ").alias("padded_end"),
                    F.array_join(pad_tokens("ids", 8, "front"), " ").alias("padded_front"))


_TOKENS = r"SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) > 0) AS w FROM documents"
_VOCAB = f"""SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 3 AS token_id FROM (
    SELECT token, count(*) AS n FROM (SELECT unnest(w) AS token FROM ({_TOKENS})) GROUP BY token)"""


@query("g05_vocabulary", f"SELECT token, n, CAST(token_id AS INTEGER) AS token_id FROM ({_VOCAB})")
def _(spark, sf):
    return corpus.build_vocabulary(table(spark, sf, "documents"))


@query("g05_encode_corpus", sql(extra={"tokens": _TOKENS, "vocab": _VOCAB, "ids": """
    SELECT t.doc_id, list(v.token_id ORDER BY t.pos) AS i FROM (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM tokens) t
    JOIN vocab v ON t.token = v.token WHERE t.pos <= 24 GROUP BY t.doc_id""", "marked": """
    SELECT t.doc_id, list_concat([2], coalesce(i.i, []), CASE WHEN len(t.w) <= 24 THEN [3] ELSE [] END)[1:24] AS ids
    FROM tokens t LEFT JOIN ids i ON t.doc_id = i.doc_id"""}, body="""
    SELECT doc_id AS item_id, array_to_string(list_concat(list_transform(range(0, 24 - len(ids)), lambda k: 0), ids), ' ') AS token_ids FROM marked"""))
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text")
    out = corpus.encode_corpus(d, corpus.build_vocabulary(d), 24)
    return out.select("item_id", F.array_join("token_ids", " ").alias("token_ids"))


@query("g05_encode_conversations", sql(extra={"tokens": r"""
    SELECT conv_id, turn, list_filter(regexp_split_to_array(lower('the ' || role || ' says ' || text), '[^\p{L}\p{N}]+'), lambda w: length(w) > 0) AS w FROM conversations""",
    "vocab": r"""SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 3 AS token_id FROM (
    SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) > 0)) AS token FROM conversations) GROUP BY token)""",
    "ids": """SELECT t.conv_id, t.turn, list(coalesce(v.token_id, 1) ORDER BY t.pos) AS i FROM (SELECT conv_id, turn, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM tokens) t
    LEFT JOIN vocab v ON t.token = v.token WHERE t.pos <= 16 GROUP BY t.conv_id, t.turn"""}, body="""
    SELECT item_id, array_to_string(list_concat(ids, list_transform(range(0, 16 - len(ids)), lambda k: 0)), ' ') AS token_ids FROM (
      SELECT t.conv_id * 1000 + t.turn AS item_id, list_concat([2], coalesce(i.i, []), CASE WHEN len(t.w) <= 16 THEN [3] ELSE [] END)[1:16] AS ids
      FROM tokens t LEFT JOIN ids i ON t.conv_id = i.conv_id AND t.turn = i.turn)"""))
def _(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), "role", "text")
    vocabulary = corpus.build_vocabulary(c)
    prompts = c.select("item_id", F.concat_ws(" ", F.lit("the"), "role", F.lit("says"), "text").alias("text"))
    out = corpus.encode_corpus(prompts, vocabulary, 16, side="end")
    return out.select("item_id", F.array_join("token_ids", " ").alias("token_ids"))


# ---- I: set operations ------------------------------------------------------------------------------------------

@query("i01_union_labels", """
    SELECT CASE WHEN doc_id % 3 = 0 THEN 'val' ELSE 'train' END AS side, doc_id, lang FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    train = d.where(F.col("doc_id") % 3 != 0).withColumn("side", F.lit("train"))
    return train.unionByName(d.where(F.col("doc_id") % 3 == 0).withColumn("side", F.lit("val")))


@query("i02_unavailable_ids", sql("label_table", body=f"SELECT item_id FROM label_table WHERE {LABELED} UNION SELECT item_id FROM label_table WHERE exclude"))
def _(spark, sf):
    return filters.unavailable_ids(label_table(spark, sf), CLASSES)


@query("i03_unlabeled_difference", sql("label_table", body=f"SELECT item_id FROM label_table EXCEPT SELECT item_id FROM label_table WHERE {LABELED}"))
def _(spark, sf):
    t = label_table(spark, sf)
    return filters.drop_labeled(t.select("item_id"), t, CLASSES)


@query("i04_intersection", sql("label_table", body="""
    SELECT item_id FROM label_table WHERE quality = 1 INTERSECT SELECT item_id FROM label_table WHERE validation"""))
def _(spark, sf):
    t = label_table(spark, sf)
    return t.where(F.col("quality") == 1).select("item_id").intersect(filters.validation_rows(t).select("item_id"))
