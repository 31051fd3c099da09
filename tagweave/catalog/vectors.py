"""Feature vectors, neighbours, contrastive reports and representation measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.catalog.fixtures import CLASSES, embed_table, planted_table, sql, u, view_pairs
from tagweave.catalog.registry import query, rounded
from tagweave.functions.hashing import hash_uniform
from tagweave.functions.vectors import as_double, dot, norm
from tagweave.functions.views import build_view_pairs, coordinate_mask, gaussian_noise
from tagweave.operators import contrast, diversity, features, heads, neighbors, select
from tagweave.sources.items import unit_vectors

_CELLS = """SELECT item_id, c, j, embedding[c * 8 + j + 1] AS x FROM embed_table,
    (SELECT unnest(range(0, 8)) AS c) a, (SELECT unnest(range(0, 8)) AS j) b"""


def _cells(spark, sf):
    e = embed_table(spark, sf)
    return e.select("item_id", features.reshape_cells("embedding", 8).alias("cells"))


def _pooled_query(how, agg):
    @query(f"b13_pool_{how}", sql("embed_table", extra={"cells": _CELLS}, body=f"""
        SELECT item_id, CAST(j AS INTEGER) AS j, round({agg}(x), 6) AS value FROM cells GROUP BY item_id, j"""))
    def _(spark, sf):
        p = _cells(spark, sf).select("item_id", F.posexplode(features.pool("cells", how)).alias("j", "value"))
        return rounded(p, "value")


_pooled_query("max", "max")
_pooled_query("average", "avg")


@query("b13_pool_layers_flatten", sql("embed_table", extra={"cells": _CELLS}, body="""
    SELECT item_id, CAST(c * 8 + j AS INTEGER) AS j, round(x, 6) AS value FROM cells
    UNION ALL SELECT item_id, CAST(64 + c * 8 + j AS INTEGER), round(x, 6) FROM cells"""))
def _(spark, sf):
    p = _cells(spark, sf).select("item_id", F.posexplode(features.pool_layers(["cells", "cells"], "flatten")).alias("j", "value"))
    return rounded(p, "value")


@query("b14_l2_normalize", sql("embed_table", body="""
    SELECT item_id, CAST(j - 1 AS INTEGER) AS j, round(x[j] / sqrt(list_dot_product(x, x)), 6) AS value
    FROM (SELECT item_id, list_transform(embedding, lambda v, i: v * i) AS x FROM embed_table), (SELECT unnest(range(1, 65)) AS j) r"""))
def _(spark, sf):
    e = embed_table(spark, sf).select("item_id", F.transform(as_double("embedding"), lambda v, i: v * (i + 1)).alias("embedding"))
    return rounded(unit_vectors(e).select("item_id", F.posexplode("embedding").alias("j", "value")), "value")


@query("b15_standardize", sql("embed_table", extra={
    "long": "SELECT item_id, j, embedding[j] AS x FROM embed_table, (SELECT unnest(range(1, 65)) AS j) r",
    "fit": "SELECT j, avg(x) AS m, stddev_pop(x) AS s FROM long WHERE item_id % 3 <> 0 GROUP BY j"}, body="""
    SELECT item_id, CAST(l.j - 1 AS INTEGER) AS j, round((x - m) / s, 6) AS value FROM long l JOIN fit ON l.j = fit.j"""))
def _(spark, sf):
    e = embed_table(spark, sf).select("item_id", "embedding")
    s = features.standardize(e, e.where(F.col("item_id") % 3 != 0))
    return rounded(s.select("item_id", F.posexplode("embedding").alias("j", "value")), "value")


@query("b16_random_projection")
def _(spark, sf):
    p = features.random_projection(embed_table(spark, sf).select("item_id", "embedding"), 32, seed=3)
    return p.select("item_id", F.size("embedding").alias("dim"), norm("embedding").alias("length"))


@query("b17_pca_project")
def _(spark, sf):
    p = features.pca_project(embed_table(spark, sf).select("item_id", "embedding"), 8, whiten=True)
    return p.select("item_id", F.posexplode("embedding").alias("component", "value"))


# ---- C: similarity ----------------------------------------------------------------------------------------------

_PAIRS = """SELECT a.item_id AS src, b.item_id AS dst, round(1 - list_cosine_similarity(a.embedding, b.embedding), 9) AS dist
    FROM embed_table a JOIN embed_table b ON a.item_id <> b.item_id"""
KNN10 = f"""SELECT * FROM (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM ({_PAIRS})) WHERE rank <= 10"""


@query("c02_knn_graph", sql("embed_table", body=f"SELECT src, dst, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM ({KNN10})"))
def _(spark, sf):
    return rounded(neighbors.knn_graph(embed_table(spark, sf), 10), "dist")


@query("c02_knn_graph_with_copies", sql("embed_table", extra={
    "copies": """SELECT item_id * 2 + c AS item_id, CASE WHEN item_id % 3 = 0 THEN first(embedding) OVER (ORDER BY item_id) ELSE embedding END AS embedding
                 FROM embed_table, (SELECT unnest([0, 1]) AS c) t"""}, body="""
    SELECT src, dst, round(dist, 6) + 0.0 AS dist, CAST(rank AS INTEGER) AS rank FROM (
      SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM (
        SELECT a.item_id AS src, b.item_id AS dst, round(greatest(1 - list_cosine_similarity(a.embedding, b.embedding), 0.0::DOUBLE), 9) AS dist
        FROM copies a JOIN copies b ON a.item_id <> b.item_id)) WHERE rank <= 5"""))
def _(spark, sf):
    e = embed_table(spark, sf).select("item_id", "embedding")
    hot = F.broadcast(e.orderBy("item_id").limit(1).select(F.col("embedding").alias("_hot"), F.lit(0).alias("_k")))
    e = e.withColumn("_k", F.when(F.col("item_id") % 3 == 0, 0).otherwise(1)).join(hot, "_k", "left")
    e = e.select("item_id", F.coalesce("_hot", "embedding").alias("embedding"), F.explode(F.array(F.lit(0), F.lit(1))).alias("c"))
    copies = e.select((F.col("item_id") * 2 + F.col("c")).alias("item_id"), "embedding")
    return rounded(neighbors.knn_graph(copies, 5, block_rows=256), "dist")


@query("c02_knn_graph_lsh")
def _(spark, sf):
    return neighbors.knn_graph_lsh(planted_table(spark, sf), 10)


@query("c03_knn_query_first_of_class", sql("embed_table", body="""
    SELECT src, dst, round(dist, 6) + 0.0 AS dist, CAST(rank AS INTEGER) AS rank FROM (
      SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM (
        SELECT q.item_id AS src, c.item_id AS dst, round(1 - list_cosine_similarity(q.embedding, c.embedding), 9) AS dist
        FROM (SELECT * FROM embed_table WHERE item_id IN (SELECT min(item_id) FROM embed_table GROUP BY label)) q, embed_table c)) WHERE rank <= 6"""))
def _(spark, sf):
    e = embed_table(spark, sf)
    first = select.first_per_class(e).select("item_id")
    return rounded(neighbors.knn_query(e.join(first, "item_id", "left_semi"), e, 6), "dist")


@query("c03_knn_query_ranked_all", sql("embed_table", body="""
    SELECT q.item_id AS src, c.item_id AS dst, round(round(1 - list_cosine_similarity(q.embedding, c.embedding), 9), 6) + 0.0 AS dist
    FROM (SELECT * FROM embed_table WHERE item_id = (SELECT min(item_id) FROM embed_table)) q, embed_table c"""))
def _(spark, sf):
    e = embed_table(spark, sf)
    text_vector = e.orderBy("item_id").limit(1)
    return rounded(neighbors.knn_query(text_vector, e, None), "dist")


@query("c04_nearest_in_queue", sql("embed_table", "view_pairs", body="""
    SELECT item_id, nn_id, round(round(dot, 9), 6) AS dot, round(nn[1], 6) AS first_value FROM (
      SELECT v.pair_id AS item_id, q.item_id AS nn_id, list_dot_product(v.z2, q.embedding) AS dot, q.embedding AS nn,
             row_number() OVER (PARTITION BY v.pair_id ORDER BY round(-list_dot_product(v.z2, q.embedding), 9), q.item_id) AS r
      FROM view_pairs v, embed_table q) WHERE r = 1"""))
def _(spark, sf):
    z = view_pairs(spark, sf).select(F.col("pair_id").alias("item_id"), F.col("z2").alias("embedding"))
    out = neighbors.nearest_in_queue(z, embed_table(spark, sf))
    return rounded(out.select("item_id", "nn_id", "dot", F.element_at("nn", 1).alias("first_value")), "dot", "first_value")


_PROMPTS = """SELECT concat('class ', label) AS prompt, label AS code, embedding FROM embed_table
    WHERE item_id IN (SELECT min(item_id) FROM embed_table GROUP BY label)"""
_ASSIGNED = f"""SELECT item_id, own, assigned, CAST(own = assigned AS INTEGER) AS hit FROM (
    SELECT e.item_id, concat('class ', e.label) AS own, p.prompt AS assigned, row_number() OVER (PARTITION BY e.item_id
      ORDER BY round(1 - list_cosine_similarity(e.embedding, p.embedding), 9), p.code) AS r FROM embed_table e, ({_PROMPTS}) p) WHERE r = 1"""


def _assigned(spark, sf):
    e = embed_table(spark, sf)
    first = select.first_per_class(e).select("item_id")
    prompts = e.join(first, "item_id", "left_semi").select(F.concat(F.lit("class "), "label").alias("prompt"), F.col("label").alias("code"), "embedding")
    return neighbors.zero_shot_assign(e.withColumn("prompt", F.concat(F.lit("class "), "label")), prompts)


@query("c05_zero_shot_assign", sql("embed_table", body=f"SELECT item_id, assigned, own AS own_prompt, hit FROM ({_ASSIGNED})"))
def _(spark, sf):
    return _assigned(spark, sf)


@query("c05_zero_shot_accuracy", sql("embed_table", body=f"SELECT round(avg(hit), 6) AS accuracy FROM ({_ASSIGNED})"))
def _(spark, sf):
    return rounded(_assigned(spark, sf).agg(F.avg("hit").alias("accuracy")), "accuracy")


_TOP = """SELECT src, q, dst, v, d, CAST(r AS INTEGER) AS rank FROM (
    SELECT p.pair_id AS src, p.z2 AS q, e.item_id AS dst, e.embedding AS v, list_dot_product(p.z2, e.embedding) AS d,
           row_number() OVER (PARTITION BY p.pair_id ORDER BY round(-list_dot_product(p.z2, e.embedding), 9), e.item_id) AS r
    FROM view_pairs p, embed_table e) WHERE r <= 6"""




@query("c09_hard_negatives", sql("embed_table", "view_pairs", extra={"top": _TOP, "slots": f"""
    SELECT DISTINCT t.src, t.q, CAST(x.slot AS INTEGER) AS slot FROM top t, (SELECT unnest(range(1, 4)) AS slot) x""",
    "mixed": f"""SELECT s.src, 'mix' AS kind, s.slot, s.q, list_transform(range(1, 65), lambda i:
          {u('0:alpha', 's.src', 's.slot')} * a.v[i] + (1.0::DOUBLE - {u('0:alpha', 's.src', 's.slot')}) * b.v[i]) AS m
        FROM slots s JOIN top a ON a.src = s.src AND a.rank = floor({u('0:n1', 's.src', 's.slot')} * 6) + 1
                     JOIN top b ON b.src = s.src AND b.rank = floor({u('0:n2', 's.src', 's.slot')} * 6) + 1
        UNION ALL
        SELECT s.src, 'mix_query', s.slot, s.q, list_transform(range(1, 65), lambda i:
          0.5::DOUBLE * {u('0:beta', 's.src', 's.slot')} * s.q[i] + (1.0::DOUBLE - 0.5::DOUBLE * {u('0:beta', 's.src', 's.slot')}) * b.v[i])
        FROM slots s JOIN top b ON b.src = s.src AND b.rank = floor({u('0:n3', 's.src', 's.slot')} * 6) + 1 WHERE s.slot <= 2"""}, body="""
    SELECT src AS item_id, 'top' AS kind, rank AS slot, round(round(d, 9), 6) AS dot FROM top
    UNION ALL SELECT src, kind, slot, round(list_dot_product(m, q) / sqrt(list_dot_product(m, m)), 6) FROM mixed"""))
def _(spark, sf):
    q = view_pairs(spark, sf).select(F.col("pair_id").alias("item_id"), F.col("z2").alias("embedding"))
    return rounded(neighbors.hard_negatives(q, embed_table(spark, sf), 6, 3, 2), "dot")


# ---- C8, D15–D25: view pairs ------------------------------------------------------------------------------------

_ANCHOR = """SELECT a.batch_id, a.pair_id, a.view, b.pair_id AS other, b.view AS other_view, list_dot_product(a.z, b.z) AS s
    FROM views a JOIN views b ON a.batch_id = b.batch_id AND NOT (a.pair_id = b.pair_id AND a.view = b.view)"""


@query("c08_contrast_pairs", sql("views", extra={"s": _ANCHOR}, body="""
    SELECT batch_id, pair_id, view, 1 - view AS positive_view, count(*) FILTER (other <> pair_id) AS n_neg,
           round(max(s) FILTER (other = pair_id), 6) AS positive, round(max(s) FILTER (other <> pair_id), 6) AS hardest_negative
    FROM s GROUP BY batch_id, pair_id, view"""))
def _(spark, sf):
    return rounded(contrast.contrast_pairs(view_pairs(spark, sf)), "positive", "hardest_negative")


def _contrast_sql(temp, eps, term):
    return sql("views", extra={"s": _ANCHOR, "a": f"""
        SELECT batch_id, pair_id, view, max(s) FILTER (other = pair_id) AS pos, (max(s) FILTER (other = pair_id) - {eps}::DOUBLE) / {temp}::DOUBLE AS lp,
               sum(exp((s + {eps}::DOUBLE) / {temp}::DOUBLE)) FILTER (other <> pair_id) AS neg,
               max((s + {eps}::DOUBLE) / {temp}::DOUBLE) FILTER (other <> pair_id) AS hardest
        FROM s GROUP BY batch_id, pair_id, view"""}, body=f"""
        SELECT batch_id, round({term}, 6) AS loss, round(avg(CAST(lp > hardest AS INTEGER)), 6) AS accuracy FROM a GROUP BY batch_id""")


_STANDARD = "avg(-ln(exp(lp) / (exp(lp) + neg) + 1e-8::DOUBLE))"
_CONTRAST = {
    "standard": (dict(temp=0.2), _contrast_sql(0.2, 0, _STANDARD)),
    "shifted": (dict(temp=0.5, eps=0.05), _contrast_sql(0.5, 0.05, _STANDARD)),
    "decoupled": (dict(temp=0.2, decoupled=True), _contrast_sql(0.2, 0, """
        (sum(ln(neg)) - (2.0::DOUBLE * sum(lp) - sum(exp(pos / 0.5::DOUBLE) * lp) * count(*) / sum(exp(pos / 0.5::DOUBLE)))) / count(*)""")),
    "robust": (dict(temp=0.5, q=0.5, lam=0.01), _contrast_sql(0.5, 0,
               "avg(-pow(exp(lp), 0.5) / 0.5::DOUBLE + 0.01::DOUBLE * pow(exp(lp) + neg, 0.5) / 0.5::DOUBLE)")),
}
for _name, (_opts, _text) in _CONTRAST.items():
    @query(f"d21_contrastive_report_{_name}", _text)
    def _(spark, sf, opts=_opts):
        return rounded(contrast.contrastive_report(view_pairs(spark, sf), **opts), "loss", "accuracy")


@query("d21_contrastive_report_one_batch", _contrast_sql(0.2, 0, _STANDARD).replace("vec_id // 50 AS batch_id", "CAST(0 AS BIGINT) AS batch_id"))
def _(spark, sf):
    whole = view_pairs(spark, sf).withColumn("batch_id", F.lit(0).cast("long"))
    return rounded(contrast.contrastive_report(whole, 0.2, block_rows=128), "loss", "accuracy")


@query("d22_hcl_report", sql("views", extra={"s": _ANCHOR, "a": """
    SELECT batch_id, pair_id, view, max(s) FILTER (other = pair_id) AS pos, count(*) FILTER (other <> pair_id) AS n,
           max(s) FILTER (other <> pair_id) AS hardest,
           sum(exp(0.5::DOUBLE * s / 0.2::DOUBLE)) FILTER (other <> pair_id) AS imp,
           sum(exp(0.5::DOUBLE * s / 0.2::DOUBLE) * exp(s / 0.2::DOUBLE)) FILTER (other <> pair_id) AS impneg
    FROM s GROUP BY batch_id, pair_id, view""", "g": """
    SELECT *, exp(pos / 0.2::DOUBLE) AS ep, greatest((impneg / (imp / (n + 2)) - 0.1::DOUBLE * n * exp(pos / 0.2::DOUBLE)) / 0.9::DOUBLE,
           n * exp(-1.0::DOUBLE / 0.2::DOUBLE)) AS ng FROM a"""}, body="""
    SELECT batch_id, round(avg(-ln(ep / (ep + ng) + 1e-8::DOUBLE)), 6) AS loss, round(avg(CAST(pos > hardest AS INTEGER)), 6) AS accuracy
    FROM g GROUP BY batch_id"""))
def _(spark, sf):
    return rounded(contrast.hcl_report(view_pairs(spark, sf), 0.2, 0.5, 0.1), "loss", "accuracy")


_CROSS = """SELECT a.batch_id, a.pair_id, a.view, b.pair_id AS other, list_dot_product(a.z, b.z) AS s
    FROM views a JOIN views b ON a.batch_id = b.batch_id AND a.view <> b.view"""
_CROSS_A = """SELECT batch_id, pair_id, view, max(s) FILTER (other = pair_id) AS pos, ln(sum(exp(s / 0.07::DOUBLE))) AS lse,
    max(s) AS best, arg_min(other, (round(-s, 12), other)) AS said FROM x GROUP BY batch_id, pair_id, view"""


@query("d23_nce_pair_report", sql("views", extra={"x": _CROSS, "a": _CROSS_A}, body="""
    SELECT batch_id, round(avg(lse - pos / 0.07::DOUBLE), 6) AS loss,
           round(avg(CAST(said = pair_id AS INTEGER)) FILTER (view = 0), 6) AS accuracy_one_way,
           round(avg(CAST(said = pair_id AS INTEGER)), 6) AS accuracy_two_way FROM a GROUP BY batch_id"""))
def _(spark, sf):
    return rounded(contrast.nce_pair_report(view_pairs(spark, sf)), "loss", "accuracy_one_way", "accuracy_two_way")


_BUFFER = f"SELECT vec_id AS item_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x, j: x * (CASE WHEN j % 2 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END)) AS b FROM embeddings"


@query("d24_queue_nce_report", sql("views", extra={"x": _CROSS, "a": "SELECT batch_id, pair_id, max(s) FILTER (other = pair_id) AS pos, sum(exp((s - 1) / 0.07::DOUBLE)) AS se, max(s) AS best, arg_min(other, (round(-s, 12), other)) AS said FROM x WHERE view = 0 GROUP BY batch_id, pair_id",
    "buffer": _BUFFER, "q": """SELECT v.pair_id, sum(exp((list_dot_product(v.z1, b.b) - 1) / 0.07::DOUBLE)) AS se, max(list_dot_product(v.z1, b.b)) AS best
    FROM view_pairs v, buffer b GROUP BY v.pair_id"""}, body="""
    SELECT a.batch_id, round(avg(ln(a.se + q.se) + (1 - a.pos) / 0.07::DOUBLE), 6) AS loss,
           round(avg(CAST(a.said = a.pair_id AND a.best >= q.best AS INTEGER)), 6) AS accuracy
    FROM a JOIN q ON a.pair_id = q.pair_id GROUP BY a.batch_id"""))
def _(spark, sf):
    e = embed_table(spark, sf)
    buffer = e.select("item_id", F.transform(as_double("embedding"), lambda x, j: F.when(j % 2 == 1, -x).otherwise(x)).alias("embedding"))
    return rounded(contrast.queue_nce_report(view_pairs(spark, sf), buffer), "loss", "accuracy")


@query("d15_alignment", sql("view_pairs", body="""
    SELECT round(avg(power(list_distance(list_transform(z1, lambda x: x / sqrt(list_dot_product(z1, z1))), z2), 2)), 6) AS alignment FROM view_pairs"""))
def _(spark, sf):
    return rounded(contrast.alignment(view_pairs(spark, sf)), "alignment")


for _name, _sq, _expr in (("d16_uniformity", False, "list_distance(a.embedding, b.embedding)"),
                          ("d16_uniformity_squared", True, "power(list_distance(a.embedding, b.embedding), 2)")):
    @query(_name, sql("embed_table", body=f"SELECT round(ln(avg(exp(-2.0::DOUBLE * {_expr}))), 6) AS uniformity FROM embed_table a, embed_table b"))
    def _(spark, sf, squared=_sq):
        return rounded(contrast.uniformity(embed_table(spark, sf), squared=squared, block_rows=256), "uniformity")


@query("d17_mmd", sql("embed_table", extra={
    "long": "SELECT label % 3 AS d, j, embedding[j] AS x FROM embed_table, (SELECT unnest(range(1, 65)) AS j) r",
    "means": "SELECT d, j, sum(x) / (count(*) + 1e-5::DOUBLE) AS m FROM long GROUP BY d, j",
    "grid": """SELECT k.d, r.j, coalesce(m.m, 0.0::DOUBLE) AS m FROM (SELECT unnest(range(0, 4)) AS d) k CROSS JOIN (SELECT unnest(range(1, 65)) AS j) r
               LEFT JOIN means m ON m.d = k.d AND m.j = r.j"""}, body="""
    SELECT round(sum(power(a.m - b.m, 2)) / 4.0::DOUBLE, 6) AS mmd FROM grid a JOIN grid b ON a.j = b.j AND a.d <> b.d"""))
def _(spark, sf):
    return rounded(contrast.mmd(embed_table(spark, sf).withColumn("domain", F.col("label") % 3), "domain", 4), "mmd")


def _soft(spark, sf):
    """Two soft assignments to four units from eight-channel slices of the vectors."""
    def head(start):
        x = F.transform(F.slice(as_double("embedding"), start, 4), lambda v: F.exp(v * 8.0))
        return F.transform(x, lambda v: v / F.aggregate(x, F.lit(0.0), lambda a, b: a + b))
    return embed_table(spark, sf).select("item_id", head(1).alias("x"), head(9).alias("y"))


_SOFT = {"e": """SELECT list_transform(embedding[1:4], lambda v: exp(v * 8.0::DOUBLE)) AS a,
                 list_transform(embedding[9:12], lambda v: exp(v * 8.0::DOUBLE)) AS b FROM embed_table""",
         "cells": """SELECT i, j, sum(a[i] / list_sum(a) * b[j] / list_sum(b)) AS g FROM e,
                     (SELECT unnest(range(1, 5)) AS i) x, (SELECT unnest(range(1, 5)) AS j) y GROUP BY i, j""",
         "sym": "SELECT l.i, l.j, (l.g + r.g) / 2 AS p FROM cells l JOIN cells r ON l.i = r.j AND l.j = r.i"}


@query("d18_mutual_information", sql("embed_table", extra={**_SOFT,
    "p": "SELECT i, j, greatest(p, 1e-7::DOUBLE) / sum(greatest(p, 1e-7::DOUBLE)) OVER () AS p FROM sym",
    "m": "SELECT p, sum(p) OVER (PARTITION BY j) AS pi, sum(p) OVER (PARTITION BY i) AS pj FROM p"}, body="""
    SELECT round(-sum(p * ln(pj)) + sum(p * (ln(p) - ln(pi))), 6) AS mutual_information, round(-sum(p * ln(pj)), 6) AS entropy,
           round(-sum(p * (ln(p) - ln(pi))), 6) AS conditional_entropy FROM m"""))
def _(spark, sf):
    return rounded(contrast.mutual_information(_soft(spark, sf), "x", "y"), "mutual_information", "entropy", "conditional_entropy")


@query("d18_joint_scaled", sql("embed_table", extra=_SOFT, body="""
    SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(p / max(p) OVER (), 6) AS p FROM sym"""))
def _(spark, sf):
    return rounded(contrast.joint_scaled(_soft(spark, sf), "x", "y"), "p")


@query("d19_variance_covariance", sql("view_pairs", extra={
    "long": "SELECT pair_id, j, z1[j] AS a, z2[j] AS b FROM view_pairs, (SELECT unnest(range(1, 65)) AS j) r",
    "st": """SELECT (avg(greatest(1 - sqrt(va + 1e-4::DOUBLE), 0)) + avg(greatest(1 - sqrt(vb + 1e-4::DOUBLE), 0))) / 2 AS std_term
             FROM (SELECT j, var_pop(a) AS va, var_pop(b) AS vb FROM long GROUP BY j)""",
    "cv": """SELECT sum(power(ca, 2) + power(cb, 2)) / 64 AS cov_term FROM (SELECT x.j AS i, y.j AS j, covar_samp(x.a, y.a) AS ca, covar_samp(x.b, y.b) AS cb
             FROM long x JOIN long y ON x.pair_id = y.pair_id AND x.j <> y.j GROUP BY x.j, y.j)""",
    "iv": "SELECT avg(power(a - b, 2)) AS invariance FROM long"}, body="""
    SELECT round(invariance, 6) AS invariance, round(std_term, 6) AS std_term, round(cov_term, 6) AS cov_term,
           round(25 * invariance + 25 * std_term + cov_term, 6) AS total FROM iv, st, cv"""))
def _(spark, sf):
    return rounded(contrast.variance_covariance(view_pairs(spark, sf)), "invariance", "std_term", "cov_term", "total")


@query("d20_avg_cosine", sql("embed_table", body="""
    SELECT round(avg(list_cosine_similarity(a.embedding, b.embedding)), 6) AS avg_cosine FROM embed_table a, embed_table b"""))
def _(spark, sf):
    return rounded(contrast.avg_cosine(embed_table(spark, sf)), "avg_cosine")


_UNIT1 = "list_transform(z1, lambda x: x / sqrt(list_dot_product(z1, z1)))"


@query("d25_pair_mse", sql("view_pairs", body=f"""
    SELECT round(avg(power(list_distance({_UNIT1}, z2), 2) / 64) * 2, 6) AS mse FROM view_pairs"""))
def _(spark, sf):
    v = view_pairs(spark, sf).select("*", F.col("z1").alias("p1"), F.col("z2").alias("p2"))
    return rounded(contrast.pair_mse(v), "mse")


@query("d25_pair_cosine", sql("view_pairs", body="SELECT round(-avg(list_cosine_similarity(z1, z2)), 6) AS loss FROM view_pairs"))
def _(spark, sf):
    return rounded(contrast.pair_cosine(view_pairs(spark, sf)), "loss")


@query("k03_build_view_pairs")
def _(spark, sf):
    v = build_view_pairs(embed_table(spark, sf), gaussian_noise(0.05), coordinate_mask(0.2), 64, "views")
    return v.select("batch_id", "pair_id", dot("z1", "z2").alias("dot"))


@query("k03_coordinate_mask", sql("embed_table", body=f"""
    SELECT batch_id, pair_id, kept FROM (SELECT (row_number() OVER (ORDER BY {u('m', 'item_id')}, item_id) - 1) // 64 AS batch_id, item_id AS pair_id,
      len(list_filter(embedding, lambda x, j: {u('m:1', 'item_id', 'j - 1')} >= 0.2::DOUBLE)) AS kept FROM embed_table)"""))
def _(spark, sf):
    v = build_view_pairs(embed_table(spark, sf), coordinate_mask(0.2), None, 64, "m")
    return v.select("batch_id", "pair_id", F.size(F.filter("z1", lambda x: x != 0.0)).cast("long").alias("kept"))


# ---- F9–F13, G6: diversity on vectors ---------------------------------------------------------------------------

def _kpp_sql(source: str, need=("embed_table",), extra=None, taken: str | None = None, picks: int = 3, seed: str = "0") -> str:
    """Unrolled picks: the first uniform, later ones by exponential race on the distance to the nearest unavailable row."""
    ctes = dict(extra or {})
    ctes["pts"] = source
    ctes["taken"] = taken or "SELECT item_id, v FROM pts WHERE false"
    ctes["d0"] = """SELECT p.item_id, p.v, p.item_id NOT IN (SELECT item_id FROM taken) AS open,
        (SELECT min(power(list_distance(p.v, t.v), 2)) FROM taken t) AS d2 FROM pts p"""
    for t in range(picks):
        key = u(f"{seed}:{t}", "item_id") if t == 0 else f"-ln(greatest({u(f'{seed}:{t}', 'item_id')}, 1e-16::DOUBLE)) / d2"
        cond = "open" if t == 0 else "open AND d2 > 0"
        ctes[f"k{t}"] = f"SELECT item_id, v FROM d{t} WHERE {cond} ORDER BY {key}, item_id LIMIT 1"
        ctes[f"d{t + 1}"] = f"""SELECT d.item_id, d.v, d.open AND d.item_id <> k.item_id AS open,
            least(coalesce(d.d2, 1e300::DOUBLE), power(list_distance(d.v, k.v), 2)) AS d2 FROM d{t} d, k{t} k"""
    body = " UNION ALL ".join(f"SELECT item_id, {t} AS pick FROM k{t}" for t in range(picks))
    return sql(*need, extra=ctes, body=body)


@query("f09_kpp_sample", _kpp_sql("SELECT item_id, embedding AS v FROM embed_table"))
def _(spark, sf):
    return diversity.kpp_sample(embed_table(spark, sf), 3)


_ODD = "SELECT item_id, embedding AS v FROM embed_table WHERE odd IS NOT NULL"


@query("f09_kpp_sample_unavailable", _kpp_sql("SELECT item_id, embedding AS v FROM embed_table", taken=_ODD, picks=4))
def _(spark, sf):
    e = embed_table(spark, sf)
    return diversity.kpp_sample(e, 4, unavailable=e.where(F.col("odd").isNotNull()))


@query("f09_oversampled_candidates", sql("embed_table", extra={
    "pts": "SELECT item_id, embedding AS v, odd IS NULL AS open FROM embed_table",
    "k0": f"SELECT item_id, v FROM pts WHERE open ORDER BY {u('0:0', 'item_id')}, item_id LIMIT 1",
    "d1": """SELECT p.item_id, p.v, p.open, least(power(list_distance(p.v, k.v), 2), (SELECT min(power(list_distance(p.v, t.v), 2)) FROM pts t WHERE NOT t.open)) AS d2
             FROM pts p, k0 k""",
    "k1": f"SELECT item_id, v FROM d1 WHERE open AND d2 > 1e-9 AND {u('0:round:1', 'item_id')} < 40 * d2 / (SELECT sum(d2) FROM d1 WHERE open)",
    "d2": "SELECT p.item_id, p.open, least(p.d2, (SELECT min(power(list_distance(p.v, k.v), 2)) FROM k1 k)) AS d2 FROM d1 p",
    "k2": f"SELECT item_id FROM d2 WHERE open AND d2 > 1e-9 AND {u('0:round:2', 'item_id')} < 40 * d2 / (SELECT sum(d2) FROM d2 WHERE open)"}, body="""
    SELECT item_id, 0 AS round FROM k0 WHERE item_id IN (SELECT item_id FROM d1 WHERE d2 IS NOT NULL)
    UNION ALL SELECT item_id, 1 FROM k1 UNION ALL SELECT item_id, 2 FROM k2"""))
def _(spark, sf):
    """Two oversampling rounds next to the labelled rows. Round 0 draws by distance too where something is unavailable."""
    e = embed_table(spark, sf)
    found, _ = diversity.oversampled_candidates(e, 40, 2, e.where(F.col("odd").isNotNull()))
    return found.select(F.col("id").alias("item_id"), "round")


@query("e06_pick_diversity", sql("embed_labels", extra={
    "pts": "SELECT item_id, embedding AS v FROM embed_table", "taken": "SELECT p.* FROM pts p JOIN embed_labels l ON p.item_id = l.item_id WHERE l.odd IS NOT NULL OR l.exclude",
    "d0": """SELECT p.item_id, p.v, p.item_id NOT IN (SELECT item_id FROM taken) AS open,
             (SELECT min(power(list_distance(p.v, t.v), 2)) FROM taken t) AS d2 FROM pts p""",
    "k0": f"SELECT item_id, v FROM d0 WHERE open ORDER BY {u('0:0', 'item_id')}, item_id LIMIT 1",
    "d1": "SELECT d.item_id, d.v, d.open AND d.item_id <> k.item_id AS open, least(d.d2, power(list_distance(d.v, k.v), 2)) AS d2 FROM d0 d, k0 k",
    "k1": f"SELECT item_id FROM d1 WHERE open AND d2 > 0 ORDER BY -ln(greatest({u('0:1', 'item_id')}, 1e-16::DOUBLE)) / d2, item_id LIMIT 1"}, body="""
    SELECT item_id, 0 AS pick FROM k0 UNION ALL SELECT item_id, 1 FROM k1"""))
def _(spark, sf):
    from tagweave.catalog.fixtures import embed_labels
    return select.pick(embed_labels(spark, sf), None, 2, sort_by="diversity", classes=["odd"], vectors=embed_table(spark, sf))


def _scores(spark, sf):
    return embed_table(spark, sf).select("item_id", *[hash_uniform(c, "item_id").alias(c) for c in CLASSES])


_GRAD = f"""SELECT item_id, flatten(list_transform(embedding, lambda h: [h * (a - CAST(a >= 0.5 AS INTEGER)) / 2, h * (b - CAST(b >= 0.5 AS INTEGER)) / 2])) AS v
    FROM (SELECT item_id, embedding, {u('quality', 'item_id')} AS a, {u('toxic', 'item_id')} AS b FROM embed_table)"""


@query("f11_badge_embeddings", sql("embed_table", extra={"g": _GRAD}, body="""
    SELECT item_id, CAST(j AS INTEGER) AS j, round(v[j + 1], 6) + 0.0 AS value FROM g, (SELECT unnest(range(0, 128)) AS j) r"""))
def _(spark, sf):
    g = diversity.badge_embeddings(embed_table(spark, sf), _scores(spark, sf), CLASSES)
    return rounded(g.select("item_id", F.posexplode("embedding").alias("j", "value")), "value")


@query("f11_badge_one_class", sql("embed_table", extra={"g": _GRAD}, body="""
    SELECT item_id, CAST(j AS INTEGER) AS j, round(v[2 * j + 2], 6) + 0.0 AS value FROM g, (SELECT unnest(range(0, 64)) AS j) r"""))
def _(spark, sf):
    g = diversity.badge_embeddings(embed_table(spark, sf), _scores(spark, sf), CLASSES, "toxic")
    return rounded(g.select("item_id", F.posexplode("embedding").alias("j", "value")), "value")


@query("f12_badge_sample", _kpp_sql("SELECT item_id, v FROM g", extra={"g": _GRAD}, taken="SELECT p.* FROM pts p JOIN embed_table e ON p.item_id = e.item_id WHERE e.odd IS NOT NULL"))
def _(spark, sf):
    e = embed_table(spark, sf)
    labels = e.select("item_id", *[F.col("odd").alias(c) for c in CLASSES])
    return diversity.badge_sample(labels, e, _scores(spark, sf), 3, CLASSES)


@query("f10_sample_diversity")
def _(spark, sf):
    from tagweave.catalog.fixtures import embed_labels
    return diversity.sample_diversity(embed_labels(spark, sf), embed_table(spark, sf), 12, ["odd"])


@query("f13_projected_diversity_sample")
def _(spark, sf):
    from tagweave.catalog.fixtures import embed_labels
    return diversity.projected_diversity_sample(embed_labels(spark, sf), embed_table(spark, sf).select("item_id", "embedding"), 5, 24, ["odd"])


def _kernel():
    import numpy as np
    j = np.arange(64)[:, None]
    return np.cos(0.1 * j * (np.arange(4)[None, :] + 1)), np.array([[1.0, 0.5], [-0.3, 0.8]])


_P = [f"list_sum(list_transform(embedding, lambda v, j: v * cos(0.1::DOUBLE * (j - 1) * {c + 1})))" for c in range(4)]


@query("g06_cosine_score", sql("embed_table", extra={"p": f"SELECT item_id, {', '.join(f'{e} AS p{i}' for i, e in enumerate(_P))} FROM embed_table"}, body="""
    SELECT item_id,
      round(1 / (1 + exp(-(p0 * 1.0::DOUBLE + p1 * 0.5::DOUBLE) / sqrt(1.25::DOUBLE) / sqrt(p0 * p0 + p1 * p1))), 6) AS quality,
      round(1 / (1 + exp(-(p2 * -0.3::DOUBLE + p3 * 0.8::DOUBLE) / sqrt(0.73::DOUBLE) / sqrt(p2 * p2 + p3 * p3))), 6) AS toxic FROM p"""))
def _(spark, sf):
    kernel, classes = _kernel()
    return rounded(heads.cosine_score(embed_table(spark, sf), kernel, classes, CLASSES), *CLASSES)
