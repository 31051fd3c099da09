"""Draws with and without replacement."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.catalog.fixtures import (CLASSES, TASKS, UNLABELED, embed_table, label_table, sql, table, task_table, u)
from tagweave.catalog.registry import query, rounded
from tagweave.operators import filters, sample

_STRATA = """SELECT item_id, class, value FROM (
    SELECT item_id, 'quality' AS class, quality AS value FROM label_table WHERE NOT exclude AND NOT validation
    UNION ALL SELECT item_id, 'toxic', toxic FROM label_table WHERE NOT exclude AND NOT validation) WHERE value IN (0, 1)"""
DRAWS = 2000


@query("f01_strata", sql("label_table", body=_STRATA))
def _(spark, sf):
    return sample.strata(label_table(spark, sf), CLASSES)


_WEIGHT = {"class": "1.0::DOUBLE", "instance": "n::DOUBLE", "squareroot": "sqrt(n)"}
_ROW = u("row", "item_id")


def _stratified_sql(mode):
    return sql("label_table", extra={
        "st": _STRATA,
        "numbered": f"SELECT *, row_number() OVER (PARTITION BY class, value ORDER BY {_ROW}, item_id) - 1 AS row_no FROM st",
        "sizes": "SELECT class, value, count(*) AS n FROM st GROUP BY class, value",
        "shares": f"SELECT *, {_WEIGHT[mode]} / sum({_WEIGHT[mode]}) OVER () AS p FROM sizes",
        "bounds": """SELECT *, sum(p) OVER (ORDER BY class, value) AS hi, coalesce(sum(p) OVER (ORDER BY class, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM shares""",
        "draws": f"SELECT d AS draw, {u('0:stratum', 'd')} AS u1, {u('0:row', 'd')} AS u2 FROM (SELECT unnest(range(0, {DRAWS})) AS d)"}, body="""
        SELECT d.draw, x.item_id, b.class, b.value, coalesce(l.quality, -1.0::DOUBLE) AS quality, coalesce(l.toxic, -1.0::DOUBLE) AS toxic
        FROM draws d JOIN bounds b ON d.u1 >= b.lo AND d.u1 < b.hi
        JOIN numbered x ON x.class = b.class AND x.value = b.value AND x.row_no = floor(d.u2 * b.n) JOIN label_table l ON l.item_id = x.item_id""")


for _mode in _WEIGHT:
    @query(f"f02_stratified_sample_{_mode}", _stratified_sql(_mode))
    def _(spark, sf, mode=_mode):
        out = sample.stratified_sample(label_table(spark, sf), DRAWS, mode, CLASSES)
        return out.select("draw", "item_id", "class", "value", *CLASSES)

    @query(f"f02w_sampling_weights_{_mode}", sql("label_table", extra={
        "st": _STRATA, "sizes": "SELECT class, value, count(*) AS n FROM st GROUP BY class, value",
        "shares": f"SELECT *, {_WEIGHT[_mode]} / sum({_WEIGHT[_mode]}) OVER () AS p FROM sizes"}, body="""
        SELECT item_id, round(sum(p / n), 9) AS weight FROM st JOIN shares USING (class, value) GROUP BY item_id"""))
    def _(spark, sf, mode=_mode):
        return rounded(sample.sampling_weights(label_table(spark, sf), mode, CLASSES), "weight", digits=9)


def _grouped_sql(rows, n, out="d.draw, x.item_id, b.subset, b.ordinal"):
    return sql("label_table", extra={
        "r": rows, "numbered": f"SELECT *, row_number() OVER (PARTITION BY subset ORDER BY {_ROW}, item_id) - 1 AS row_no FROM r",
        "b": "SELECT subset, count(*) AS n, row_number() OVER (ORDER BY subset) - 1 AS ordinal FROM r GROUP BY subset",
        "draws": f"SELECT d AS draw, {u('0:stratum', 'd')} AS u1, {u('0:row', 'd')} AS u2 FROM (SELECT unnest(range(0, {n})) AS d)"}, body=f"""
        SELECT {out} FROM draws d JOIN b ON b.ordinal = floor(d.u1 * (SELECT count(*) FROM b))
        JOIN numbered x ON x.subset = b.subset AND x.row_no = floor(d.u2 * b.n)""")


@query("f03_subset_sample", _grouped_sql("SELECT item_id, subset FROM label_table WHERE NOT exclude AND NOT validation AND subset IS NOT NULL", DRAWS))
def _(spark, sf):
    return sample.subset_sample(label_table(spark, sf), DRAWS).select("draw", "item_id", "subset", "ordinal")


def _uniform_sql(rows, n):
    return sql("label_table", extra={"r": f"SELECT item_id, row_number() OVER (ORDER BY {_ROW}, item_id) - 1 AS row_no FROM ({rows})"}, body=f"""
        SELECT d AS draw, item_id FROM (SELECT unnest(range(0, {n})) AS d) JOIN r ON r.row_no = floor({u('0:row', 'd')} * (SELECT count(*) FROM r))""")


@query("f04_unlabeled_sample", _uniform_sql(f"SELECT item_id FROM label_table WHERE {UNLABELED}", DRAWS))
def _(spark, sf):
    return sample.unlabeled_sample(label_table(spark, sf), DRAWS, CLASSES)


@query("f05_tag_batch_uniform", sql("label_table", body=f"""
    SELECT item_id, round(key, 6) AS key FROM (SELECT item_id, {u('0', 'item_id')} AS key FROM label_table WHERE toxic IS NULL ORDER BY key, item_id LIMIT 9)"""))
def _(spark, sf):
    return rounded(sample.tag_batch(label_table(spark, sf), "toxic"), "key")


@query("f06_tag_batch_stratified", _grouped_sql("SELECT item_id, subset FROM label_table WHERE toxic IS NULL AND subset IS NOT NULL", 9))
def _(spark, sf):
    return sample.tag_batch(label_table(spark, sf), "toxic", "stratified").select("draw", "item_id", "subset", "ordinal")


@query("f07_cluster_stratified", sql("embed_table", extra={
    "numbered": f"SELECT item_id, label, row_number() OVER (PARTITION BY label ORDER BY {_ROW}, item_id) - 1 AS row_no FROM embed_table",
    "sizes": "SELECT label, count(*) AS n FROM embed_table GROUP BY label",
    "slots": "SELECT label, n, unnest(range(0, (SELECT 2 * (count(*) // (max(label) + 1)) FROM embed_table))) AS slot FROM sizes"}, body=f"""
    SELECT x.item_id, s.label AS cluster, CAST(s.slot AS INTEGER) AS slot, round({u('0:order', 's.label', 's.slot')}, 6) AS order_key
    FROM slots s JOIN numbered x ON x.label = s.label AND x.row_no = floor({u('0:row', 's.label', 's.slot')} * s.n)"""))
def _(spark, sf):
    a = embed_table(spark, sf).select("item_id", F.col("label").alias("cluster"))
    return rounded(sample.cluster_stratified(a, 2).select("item_id", "cluster", F.col("slot").cast("int").alias("slot"), "order_key"), "order_key")


@query("f08_missingness_weights", sql("task_table", body="""
    SELECT item_id, round(CASE WHEN lang IS NOT NULL THEN 0.5::DOUBLE / (SELECT count(lang) FROM task_table) ELSE 0.0::DOUBLE END
      + CASE WHEN source IS NOT NULL THEN 0.5::DOUBLE / (SELECT count(source) FROM task_table) ELSE 0.0::DOUBLE END, 9) AS weight FROM task_table"""))
def _(spark, sf):
    return rounded(sample.missingness_weights(task_table(spark, sf), TASKS), "weight", digits=9)


@query("f08_missingness_sample", sql("task_table", extra={
    "long": "SELECT item_id, 'lang' AS task FROM task_table WHERE lang IS NOT NULL UNION ALL SELECT item_id, 'source' FROM task_table WHERE source IS NOT NULL",
    "numbered": f"SELECT *, row_number() OVER (PARTITION BY task ORDER BY {_ROW}, item_id) - 1 AS row_no FROM long",
    "sizes": "SELECT task, count(*) AS n, row_number() OVER (ORDER BY task) - 1 AS ordinal FROM long GROUP BY task"}, body=f"""
    SELECT d AS draw, x.item_id, s.task FROM (SELECT unnest(range(0, {DRAWS})) AS d) JOIN sizes s ON s.ordinal = floor({u('0:stratum', 'd')} * 2)
    JOIN numbered x ON x.task = s.task AND x.row_no = floor({u('0:row', 'd')} * s.n)"""))
def _(spark, sf):
    return sample.missingness_sample(task_table(spark, sf), TASKS, DRAWS)


@query("f08_missingness_sample_unbalanced", _uniform_sql("SELECT doc_id AS item_id FROM documents", DRAWS))
def _(spark, sf):
    return sample.missingness_sample(task_table(spark, sf), TASKS, DRAWS, balanced=False)


@query("f14_learning_curve_subsample", sql("label_table", extra={
    "pool": f"SELECT item_id, quality, {u('0:curve', 'item_id')} AS key FROM label_table WHERE NOT exclude AND NOT validation AND quality IS NOT NULL",
    "size": f"SELECT CAST(floor(pow(10, log10(20) + {u('0:size', '3')} * (log10(count(*)) - log10(20)))) AS BIGINT) AS n FROM pool",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY quality ORDER BY key, item_id) AS r FROM pool"}, body="""
    SELECT item_id, quality, round(key, 6) AS key FROM ranked, size
    WHERE (quality = 1 AND r <= greatest(1, floor(n * 0.3))) OR (quality = 0 AND r <= n - greatest(1, floor(n * 0.3)))"""))
def _(spark, sf):
    t = label_table(spark, sf)
    pool = filters.training_rows(t).where(F.col("quality").isNotNull())
    n = sample.learning_curve_size(pool.count(), 20, 0, 3)
    return rounded(sample.learning_curve_subsample(pool, n, "quality", 0.3), "key")


@query("f15_add_label_noise", sql("label_table", body="SELECT item_id, " + ", ".join(
    f"CASE WHEN {u(f'0:noise:{c}', 'item_id')} < 0.25 THEN 1 - {c} ELSE {c} END AS {c}" for c in CLASSES) + " FROM label_table"))
def _(spark, sf):
    return sample.add_label_noise(label_table(spark, sf), CLASSES, 0.25).select("item_id", *CLASSES)


@query("f16_split_domains", sql("label_table", body=f"""
    SELECT item_id, subset, subset = (SELECT arg_min(subset, ({u('0:domain', 'subset')}, subset)) FROM label_table) AS is_test
    FROM label_table WHERE subset IS NOT NULL"""))
def _(spark, sf):
    return sample.split_domains(label_table(spark, sf)).select("item_id", "subset", "is_test")


@query("f17_param_samples", f"""
    SELECT doc_id AS trial, round(0.1::DOUBLE + {u('0:lam', 'doc_id')} * 0.9::DOUBLE, 6) AS lam,
      round(exp(ln(1e-4::DOUBLE) + {u('0:rate', 'doc_id')} * (ln(1e-1::DOUBLE) - ln(1e-4::DOUBLE))), 6) AS learning_rate,
      CAST(2 + floor({u('0:finetune', 'doc_id')} * 8) AS INTEGER) AS finetune,
      (['none', 'cosine'])[CAST(floor({u('0:decay', 'doc_id')} * 2) AS INTEGER) + 1] AS lr_decay,
      (['adam', 'momentum'])[CAST(floor({u('0:optimizer', 'doc_id')} * 2) AS INTEGER) + 1] AS optimizer,
      (['class', 'instance', 'squareroot'])[CAST(floor({u('0:sampling', 'doc_id')} * 3) AS INTEGER) + 1] AS sampling FROM documents""")
def _(spark, sf):
    trials = table(spark, sf, "documents").select(F.col("doc_id").alias("trial"))
    out = sample.with_param_draws(trials, "trial", (0.1, 1.0), (1e-4, 1e-1), (2, 10), True, True, True)
    return rounded(out, "lam", "learning_rate")


@query("c07_zip_labeled_unlabeled", sql("label_table", extra={
    "s": "SELECT item_id FROM label_table WHERE quality IS NOT NULL", "t": "SELECT item_id FROM label_table WHERE quality IS NULL AND toxic IS NULL",
    "sn": f"SELECT (row_number() OVER (ORDER BY {u('0:labeled', 'item_id')}, item_id) - 1) // 16 AS batch_no, 'labeled' AS role, item_id FROM s",
    "tn": f"SELECT (row_number() OVER (ORDER BY {u('0:unlabeled', 'item_id')}, item_id) - 1) // 48 AS batch_no, 'unlabeled' AS role, item_id FROM t",
    "m": "SELECT least((SELECT max(batch_no) FROM sn), (SELECT max(batch_no) FROM tn)) AS m"}, body="""
    SELECT batch_no, role, item_id FROM (SELECT * FROM sn UNION ALL SELECT * FROM tn), m WHERE batch_no <= m"""))
def _(spark, sf):
    t = label_table(spark, sf)
    sup = t.where(F.col("quality").isNotNull())
    return sample.zip_labeled_unlabeled(sup, t.where(filters.is_unlabeled(CLASSES)), 16, 3)
