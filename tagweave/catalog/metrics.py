"""Label counts, classifier metrics and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.catalog.fixtures import CLASSES, bce_sql, embed_table, label_table, pred_table, sql, task_table, u
from tagweave.catalog.registry import query, rounded
from tagweave.catalog.tables import _COUNTS, _ESTIMATE, auc_sql
from tagweave.functions.hashing import hash_uniform
from tagweave.operators import metrics as M

_LABEL_ROWS = """SELECT 'quality' AS class, validation, quality AS y FROM label_table
    UNION ALL SELECT 'toxic', validation, toxic FROM label_table"""


@query("d01_label_summary", sql("label_table", body=f"""
    SELECT class, CASE WHEN validation THEN 'validation' ELSE 'training' END AS split,
           count(*) FILTER (y = 0) AS neg, count(*) FILTER (y = 1) AS pos FROM ({_LABEL_ROWS}) GROUP BY 1, 2"""))
def _(spark, sf):
    return M.label_summary(label_table(spark, sf), CLASSES)


@query("d02_tag_summary", sql("label_table", body=f"""
    SELECT class, count(*) FILTER (y IS NULL) AS n_unknown, count(*) FILTER (y = 0) AS n_neg, count(*) FILTER (y = 1) AS n_pos
    FROM ({_LABEL_ROWS}) GROUP BY 1"""))
def _(spark, sf):
    return M.tag_summary(label_table(spark, sf), CLASSES)


@query("d03_confusion_counts", sql("known", body=f"SELECT * FROM ({_COUNTS}) WHERE tp + fn > 0 AND tn + fp > 0"))
def _(spark, sf):
    return M.confusion_counts(label_table(spark, sf), pred_table(spark, sf), 0.5, CLASSES)


@query("d04_accuracy_estimate", sql("known", body=f"""
    SELECT class, tp, tn, fp, fn, round(accuracy, 6) AS accuracy, round(base_rate, 6) AS base_rate FROM ({_ESTIMATE})"""))
def _(spark, sf):
    counts = M.confusion_counts(label_table(spark, sf), pred_table(spark, sf), 0.5, CLASSES)
    return rounded(M.accuracy_estimate(counts).drop("interval_low", "interval_high", "prob_above_base_rate"), "accuracy", "base_rate")


def _tail(x: str) -> str:
    """P(share <= x) as a binomial tail, which is the incomplete beta function of whole parameters."""
    n = "(tp + tn + fp + fn)"
    return f"""list_sum([exp(lgamma(10.0::DOUBLE + {n}) - lgamma(j + 1.0::DOUBLE) - lgamma(10.0::DOUBLE + {n} - j)
        + j * ln({x}) + (9.0::DOUBLE + {n} - j) * ln(1 - {x})) for j in range(5 + tp + tn, 10 + {n})])"""


_HALVES = f"""SELECT class, q, 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM est, (SELECT unnest([0.05::DOUBLE, 0.95::DOUBLE]) AS q)
    UNION ALL SELECT h.class, q, step + 1, CASE WHEN {_tail("((lo + hi) / 2)")} < q THEN (lo + hi) / 2 ELSE lo END,
        CASE WHEN {_tail("((lo + hi) / 2)")} < q THEN hi ELSE (lo + hi) / 2 END
    FROM halves h JOIN est USING (class) WHERE step < 45"""


@query("d04_accuracy_interval", sql("known", extra={"est": _ESTIMATE, "halves": _HALVES, "found": """
        SELECT class, max(CASE WHEN q < 0.5 THEN lo END) AS low, max(CASE WHEN q > 0.5 THEN lo END) AS high FROM halves WHERE step = 45 GROUP BY class"""}, body=f"""
    SELECT class, tp, tn, fp, fn, round(accuracy, 6) AS accuracy, round(low, 6) AS interval_low, round(high, 6) AS interval_high,
        round(base_rate, 6) AS base_rate, round(1 - {_tail("base_rate")}, 6) AS prob_above_base_rate FROM est JOIN found USING (class)""").replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, sf):
    counts = M.confusion_counts(label_table(spark, sf), pred_table(spark, sf), 0.5, CLASSES)
    return rounded(M.accuracy_estimate(counts), "accuracy", "interval_low", "interval_high", "base_rate", "prob_above_base_rate")


@query("d04_prob_above_base_rate", sql("known", extra={"est": _ESTIMATE}, body="""
    SELECT class, round(1 - list_sum(list_transform(range(5 + tp + tn, 10 + tp + tn + fp + fn), lambda j:
      exp(lgamma(10.0::DOUBLE + tp + tn + fp + fn) - lgamma(j + 1.0::DOUBLE) - lgamma(10.0::DOUBLE + tp + tn + fp + fn - j)
          + j * ln(base_rate) + (9.0::DOUBLE + tp + tn + fp + fn - j) * ln(1 - base_rate)))), 6) AS prob_above_base_rate FROM est"""))
def _(spark, sf):
    counts = M.confusion_counts(label_table(spark, sf), pred_table(spark, sf), 0.5, CLASSES)
    return rounded(M.accuracy_estimate(counts).select("class", "prob_above_base_rate"), "prob_above_base_rate")


for _name, _val, _rows in (("d05_auc_validation", True, "SELECT * FROM known WHERE validation"),
                           ("d05_auc_training", False, "SELECT * FROM known WHERE NOT validation"),
                           ("d05_auc_all", None, "SELECT * FROM known")):
    @query(_name, sql("known", body=f"""SELECT class, n_pos, n_neg, round(auc, 6) AS auc, round(accuracy, 6) AS accuracy FROM ({auc_sql(_rows)})"""))
    def _(spark, sf, val=_val):
        return rounded(M.auc(label_table(spark, sf), pred_table(spark, sf), CLASSES, val), "auc", "accuracy")


@query("d05_auc_with_ties", sql("known", body=f"""SELECT class, n_pos, n_neg, round(auc, 6) AS auc, round(accuracy, 6) AS accuracy
    FROM ({auc_sql("SELECT class, y, floor(p * 10) / 10.0::DOUBLE AS p FROM known")})"""))
def _(spark, sf):
    coarse = pred_table(spark, sf).select("item_id", *[(F.floor(F.col(c) * 10) / F.lit(10.0)).alias(c) for c in CLASSES])
    return rounded(M.auc(label_table(spark, sf), coarse, CLASSES, None), "auc", "accuracy")


_GROUPS = """SELECT item_id, class, CASE WHEN y IS NULL THEN 'unlabeled' ELSE (CASE WHEN validation THEN 'validation_' ELSE 'training_' END)
      || (CASE WHEN y = 1 THEN 'positive' ELSE 'negative' END) END AS "group", p FROM (
    SELECT item_id, validation, 'quality' AS class, quality AS y, pred_quality AS p FROM scored
    UNION ALL SELECT item_id, validation, 'toxic', toxic, pred_toxic FROM scored)"""
_BIN = "CAST(least(floor(p * 14), 13) AS INTEGER)"


@query("d06_score_histogram", sql("scored", extra={"g": _GROUPS}, body=f"""
    SELECT class, "group", bin, n, round(n * 14.0::DOUBLE / sum(n) OVER (PARTITION BY class, "group"), 6) AS density
    FROM (SELECT class, "group", {_BIN} AS bin, count(*) AS n FROM g GROUP BY 1, 2, 3)"""))
def _(spark, sf):
    return rounded(M.score_histogram(label_table(spark, sf), pred_table(spark, sf), CLASSES), "density")


@query("d07_raw_scores_by_group", sql("scored", extra={"g": _GROUPS}, body='SELECT class, "group", item_id, round(p, 6) AS score FROM g'))
def _(spark, sf):
    return rounded(M.raw_scores_by_group(label_table(spark, sf), pred_table(spark, sf), CLASSES), "score")


@query("d08_masked_bce", sql("known", body=f"SELECT round(avg({bce_sql('y', 'p')}), 6) AS loss, count(*) AS n_known FROM known"))
def _(spark, sf):
    return rounded(M.masked_bce(label_table(spark, sf), pred_table(spark, sf), CLASSES), "loss")


@query("d08_masked_bce_smoothed", sql("known", body=f"""
    SELECT round(avg({bce_sql('y * 0.8::DOUBLE + 0.1::DOUBLE', 'p')}), 6) AS loss, count(*) AS n_known FROM known"""))
def _(spark, sf):
    return rounded(M.masked_bce(label_table(spark, sf), pred_table(spark, sf), CLASSES, 0.2), "loss")


@query("d09_masked_focal", sql("known", body="""
    SELECT round(avg(CASE WHEN y = 1 THEN -ln(p + 1e-7::DOUBLE) * pow(1 - p, 2) ELSE -ln(1 - p + 1e-7::DOUBLE) * pow(p, 2) END), 6) AS loss,
           count(*) AS n_known FROM known"""))
def _(spark, sf):
    return rounded(M.masked_focal(label_table(spark, sf), pred_table(spark, sf), CLASSES), "loss")


@query("d10_masked_mae", sql("known", body="SELECT round(avg(abs(y - p)), 6) AS loss, count(*) AS n_known FROM known"))
def _(spark, sf):
    return rounded(M.masked_mae(label_table(spark, sf), pred_table(spark, sf), CLASSES), "loss")


def _probs(spark, sf, tag="s"):
    """Probabilities over four codes and a partly known code per document."""
    t = task_table(spark, sf)
    raw = [hash_uniform(f"{tag}{i}", "item_id") + 0.05 for i in range(4)]
    t = t.select("item_id", F.when(F.col("lang").isNotNull(), F.pmod("item_id", F.lit(4)).cast("int")).alias("code"), F.array(*raw).alias("r"))
    return t.select("item_id", "code", F.transform("r", lambda v: v / F.aggregate("r", F.lit(0.0), lambda a, b: a + b)).alias("probs"))


def _probs_sql(tag="s"):
    raw = ", ".join(f"{u(f'{tag}{i}', 'item_id')} + 0.05::DOUBLE" for i in range(4))
    return f"""SELECT item_id, code, list_transform(r, lambda v: v / list_sum(r)) AS probs FROM (
        SELECT item_id, CASE WHEN lang IS NOT NULL THEN CAST(item_id % 4 AS INTEGER) END AS code, [{raw}] AS r FROM task_table)"""


@query("d11_masked_sparse_ce", sql("task_table", extra={"t": _probs_sql()}, body="""
    SELECT round(avg(-ln(probs[code + 1])), 6) AS loss, count(code) AS n_known FROM t WHERE code IS NOT NULL"""))
def _(spark, sf):
    return rounded(M.masked_sparse_ce(_probs(spark, sf), "code", "probs"), "loss")


@query("d12_entropy_loss", sql("pred_table", body=f"""
    SELECT round(avg(({bce_sql('quality', 'quality')} + {bce_sql('toxic', 'toxic')}) / 2), 6) AS loss FROM pred_table"""))
def _(spark, sf):
    return rounded(M.entropy_loss(pred_table(spark, sf), CLASSES), "loss")


def _soft_sql(x):
    return f"(1 / (1 + exp(-((2 * {x} - 1) / 2.0::DOUBLE))))"


_DIST = " + ".join(f"-({_soft_sql('a.' + c)} * ln({_soft_sql('b.' + c)} + 1e-7::DOUBLE) + (1 - {_soft_sql('a.' + c)}) * ln(1 - {_soft_sql('b.' + c)} + 1e-7::DOUBLE))" for c in CLASSES)


@query("d13_distillation_loss", sql("pred_table", "pred_b", body=f"""
    SELECT round(avg(({_DIST}) / 2), 6) AS loss FROM pred_table a JOIN pred_b b ON a.item_id = b.item_id"""))
def _(spark, sf):
    return rounded(M.distillation_loss(pred_table(spark, sf), pred_table(spark, sf, "b"), CLASSES, 2.0), "loss")


@query("d14_kl_divergence", sql("task_table", extra={"t": _probs_sql("s"), "s": _probs_sql("r"), "t2": _probs_sql("q"), "s2": _probs_sql("w")}, body="""
    SELECT round(avg(k1) + avg(k2), 6) AS kl FROM (SELECT
      list_sum(list_transform(range(1, 5), lambda i: t.probs[i] * ln(t.probs[i] / s.probs[i]))) AS k1,
      list_sum(list_transform(range(1, 5), lambda i: t2.probs[i] * ln(t2.probs[i] / s2.probs[i]))) AS k2
      FROM t JOIN s ON t.item_id = s.item_id JOIN t2 ON t.item_id = t2.item_id JOIN s2 ON t.item_id = s2.item_id)"""))
def _(spark, sf):
    def heads(a, b):
        return _probs(spark, sf, a).select("item_id", F.col("probs").alias("h1")).join(
            _probs(spark, sf, b).select("item_id", F.col("probs").alias("h2")), "item_id")
    return rounded(M.kl_divergence(heads("s", "q"), heads("r", "w"), ["h1", "h2"]), "kl")


@query("d26_nmi", sql("embed_table", extra={"n": "SELECT label AS a, label % 4 AS b, count(*)::DOUBLE AS n FROM embed_table GROUP BY 1, 2",
    "h": """SELECT (SELECT -sum(x / t * ln(x / t)) FROM (SELECT sum(n) AS x FROM n GROUP BY a), (SELECT sum(n) AS t FROM n)) AS ha,
                   (SELECT -sum(x / t * ln(x / t)) FROM (SELECT sum(n) AS x FROM n GROUP BY b), (SELECT sum(n) AS t FROM n)) AS hb,
                   (SELECT -sum(n / t * ln(n / t)) FROM n, (SELECT sum(n) AS t FROM n)) AS hab"""}, body="""
    SELECT round((ha + hb - hab) / ((ha + hb) / 2), 6) AS nmi FROM h"""))
def _(spark, sf):
    return rounded(M.nmi(embed_table(spark, sf).withColumn("other", F.col("label") % 4), "label", "other"), "nmi")


@query("d27_confusion_matrix", sql("embed_table", body="SELECT label, label % 4 AS pred, count(*) AS n FROM embed_table GROUP BY 1, 2"))
def _(spark, sf):
    return M.confusion_matrix(embed_table(spark, sf).withColumn("pred", F.col("label") % 4), "label", "pred")


@query("d27_multiclass_accuracy", sql("embed_table", body="SELECT round(avg(CAST(label = label % 4 AS INTEGER)), 6) AS accuracy FROM embed_table"))
def _(spark, sf):
    return rounded(M.multiclass_accuracy(embed_table(spark, sf).withColumn("pred", F.col("label") % 4), "label", "pred"), "accuracy")


@query("d28_task_accuracy", sql("task_table", extra={"t": _probs_sql("s"), "w": _probs_sql("w")}, body="""
    SELECT 'one' AS task, round(avg(CAST(list_position(probs, list_max(probs)) - 1 = code AS INTEGER)), 6) AS accuracy, count(*) AS n_known FROM t WHERE code IS NOT NULL
    UNION ALL SELECT 'two', round(avg(CAST(list_position(probs, list_max(probs)) - 1 = code AS INTEGER)), 6), count(*) FROM w WHERE code IS NOT NULL"""))
def _(spark, sf):
    other = _probs(spark, sf, "w").select("item_id", F.col("probs").alias("probs2"))
    df = _probs(spark, sf).join(other, "item_id")
    return rounded(M.task_accuracy(df, {"one": ("code", "probs"), "two": ("code", "probs2")}), "accuracy")


@query("d29_worst_cases", sql("known", body="""
    SELECT class, arg_max(item_id, (p, -item_id)) FILTER (y = 0) AS worst_negative, round(max(p) FILTER (y = 0), 6) AS worst_negative_score,
           arg_min(item_id, (p, item_id)) FILTER (y = 1) AS worst_positive, round(min(p) FILTER (y = 1), 6) AS worst_positive_score
    FROM known GROUP BY class"""))
def _(spark, sf):
    return rounded(M.worst_cases(label_table(spark, sf), pred_table(spark, sf), CLASSES), "worst_negative_score", "worst_positive_score")


def _per_class(expr):
    return "(" + " + ".join(expr.format(w=f"a.{c}", s=f"b.{c}") for c in CLASSES) + ") / 2"


_MASK = "CASE WHEN {w} >= 0.8 OR {w} <= 1.0::DOUBLE - 0.8::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_STRONG = bce_sql("CAST({w} > 0.5 AS INTEGER)", "{s}")


@query("d30_fixmatch_stats", sql("pred_table", "pred_b", body=f"""
    SELECT round(avg({_per_class(_MASK)}), 6) AS mask_fraction, round(avg({_per_class('CAST(({w} > 0.5) = ({s} > 0.5) AS INTEGER)')}), 6) AS agreement,
           round(avg({_per_class(f'({_MASK}) * {_STRONG}')}), 6) AS loss FROM pred_table a JOIN pred_b b ON a.item_id = b.item_id"""))
def _(spark, sf):
    return rounded(M.fixmatch_stats(pred_table(spark, sf), pred_table(spark, sf, "b"), CLASSES, 0.8), "mask_fraction", "agreement", "loss")


@query("d31_cluster_sizes", sql("embed_table", body="""
    SELECT CAST(k AS INTEGER) AS cluster, count(e.item_id) AS n FROM (SELECT unnest(range(0, 12)) AS k) LEFT JOIN embed_table e ON e.label = k GROUP BY 1"""))
def _(spark, sf):
    return M.cluster_sizes(embed_table(spark, sf), 12, "label").select(F.col("label").alias("cluster"), "n")


@query("d32_scores_by_class_hist", sql("known", body=f"""
    SELECT class, "group", bin, n, round(n * 14.0::DOUBLE / sum(n) OVER (PARTITION BY class, "group"), 6) AS density FROM (
      SELECT class, CASE WHEN y = 1 THEN 'positive' ELSE 'negative' END AS "group", {_BIN} AS bin, count(*) AS n FROM known GROUP BY 1, 2, 3)"""))
def _(spark, sf):
    return rounded(M.scores_by_class_hist(label_table(spark, sf), pred_table(spark, sf), CLASSES), "density")
