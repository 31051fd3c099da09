"""Iterative jobs and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tagweave.catalog.fixtures import (PLANTED, TASKS, as_label_events, embed_labels, embed_table, label_table,
                                       planted_labels, planted_table, sql, table, u, view_pairs, CLASSES)
from tagweave.catalog.registry import query, rounded
from tagweave.catalog.tables import _applied
from tagweave.catalog.vectors import KNN10
from tagweave.functions.views import gaussian_noise
from tagweave.functions.vectors import as_double
from tagweave.operators import metrics
from tagweave.operators.edits import BOOLEAN_FIELDS
from tagweave.operators.encode import class_codes, encode_classes
from tagweave.operators.sample import with_param_draws
from tagweave.plans import cluster, evaluate, network, propagate, rounds, training, trials
from tagweave.session import scratch_path
from tagweave.streaming import edits as streams

ROUNDS = 3


def _propagation_sql() -> str:
    """Rounds unrolled over the kNN edges with the one class `odd`."""
    ctes = {
        "knn": KNN10, "raw": "SELECT src, dst, exp(-dist / 0.01::DOUBLE) AS a FROM knn",
        "deg": "SELECT src, 1 / sqrt(sum(a)) AS s FROM raw GROUP BY src",
        "w": "SELECT r.src, r.dst, r.a * x.s * y.s AS w FROM raw r JOIN deg x ON r.src = x.src JOIN deg y ON r.dst = y.src",
        "hard": """SELECT item_id, CASE WHEN NOT exclude AND NOT validation AND odd = 0 THEN 1.0::DOUBLE END AS hn,
                   CASE WHEN NOT exclude AND NOT validation AND odd = 1 THEN 1.0::DOUBLE END AS hp FROM embed_labels""",
        "s0": "SELECT item_id, coalesce(hn, 0) AS n, coalesce(hp, 0) AS p FROM hard"}
    for t in range(ROUNDS):
        ctes[f"m{t}"] = f"SELECT w.src, sum(w.w * s.n) AS n, sum(w.w * s.p) AS p FROM w JOIN s{t} s ON s.item_id = w.dst GROUP BY w.src"
        ctes[f"s{t + 1}"] = f"""SELECT h.item_id, coalesce(h.hn, m.n, 0) AS n, coalesce(h.hp, m.p, 0) AS p
                                FROM hard h LEFT JOIN m{t} m ON m.src = h.item_id"""
    return sql("embed_labels", extra=ctes, body=f"SELECT item_id, CASE WHEN n + p > 0 THEN round(p / (n + p), 6) END AS odd FROM s{ROUNDS}")


@query("h01_propagate_labels", _propagation_sql())
def _(spark, sf):
    out = propagate.propagate_labels(embed_labels(spark, sf), vectors=embed_table(spark, sf), iterations=ROUNDS, classes=["odd"])
    return rounded(out, "odd")


def _planted_sql(extra: dict, body: str) -> str:
    labels = """SELECT item_id, (item_id % 17 = 0) AS exclude, (item_id % 5 = 0) AS validation,
        CASE WHEN item_id % 3 <> 1 THEN CAST(item_id % 4 < 2 AS INTEGER)::DOUBLE END AS low,
        CASE WHEN (item_id // 4) % 2 = 0 THEN CAST(item_id % 4 = 3 AS INTEGER)::DOUBLE END AS last FROM embed_table"""
    points = """SELECT item_id, list_transform(embedding, lambda x, j: x * 4.0::DOUBLE + CASE WHEN j = item_id % 4 + 1 THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END) AS x
        FROM embed_table"""
    return sql("embed_table", extra={"planted_labels": labels, "points": points, **extra}, body=body)


_KNOWN = {
    "known": """SELECT * FROM (SELECT item_id, 'low' AS class, low AS y FROM planted_labels WHERE NOT exclude AND NOT validation
        UNION ALL SELECT item_id, 'last', last FROM planted_labels WHERE NOT exclude AND NOT validation) WHERE y IS NOT NULL""",
    "size": "SELECT class, y, CAST(count(*) AS DOUBLE) AS n FROM known GROUP BY class, y",
    "share": """SELECT mode, class, y, n, CASE mode WHEN 'class' THEN 1.0::DOUBLE WHEN 'instance' THEN n ELSE sqrt(n) END AS s
        FROM size, (SELECT unnest(['class', 'instance', 'squareroot']) AS mode)""",
    "stratum": "SELECT mode, class, y, s / sum(s) OVER (PARTITION BY mode) / n * sum(n) OVER (PARTITION BY mode) AS w FROM share",
    "weight": "SELECT item_id, mode, sum(w) AS w FROM known JOIN stratum USING (class, y) GROUP BY item_id, mode"}


def _quality(summary):
    return summary.select("class", "num_validation_points", "num_training_points", "val_auc", "val_acc")


@query("h02_train_heads")
def _(spark, sf):
    labels, vectors = planted_labels(spark, sf), planted_table(spark, sf)
    heads = training.train_heads(vectors, labels, PLANTED, steps=20)
    return _quality(metrics.run_summary(labels, heads.predict(vectors), PLANTED))


@query("h02_train_heads_focal")
def _(spark, sf):
    labels, vectors = planted_labels(spark, sf), planted_table(spark, sf)
    heads = training.train_heads(vectors, labels, PLANTED, loss="focal", steps=12)
    return _quality(metrics.run_summary(labels, heads.predict(vectors), PLANTED))


@query("h02_train_and_report")
def _(spark, sf):
    _, _, report = evaluate.train_and_report(planted_table(spark, sf), planted_labels(spark, sf), PLANTED, steps=20, smoothing=0.05)
    return report


@query("h03_train_mlp_head")
def _(spark, sf):
    labels, vectors = planted_labels(spark, sf), planted_table(spark, sf).select("item_id", "embedding")
    models = training.train_mlp_head(vectors, labels, PLANTED, (8,), 30)
    return _quality(metrics.run_summary(labels, training.predict_mlp(models, vectors), PLANTED))


def _network_sql(units: int = 3, steps: int = 2, rate: float = 0.05) -> str:
    """Steps of one hidden layer from fixed weights; unit `units` and position 64 are the biases."""
    start = "sin(0.3::DOUBLE * ({0} + 1)) / 4"
    ctes = {**_KNOWN,
            "cell": "SELECT k.item_id, k.class, k.y, w.w FROM known k JOIN weight w USING (item_id) WHERE mode = 'class'",
            "xs": "SELECT item_id, unnest(range(0, 65)) AS j, unnest(list_append(x, 1.0::DOUBLE)) AS v FROM points WHERE item_id IN (SELECT item_id FROM cell)",
            "c": "SELECT * FROM (VALUES ('low', 0), ('last', 1)) t(class, k)",
            "a0": f"""SELECT j, u, CASE WHEN j = 64 THEN 0.0::DOUBLE ELSE {start.format(f'j * {units} + u')} END AS th, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v
                FROM (SELECT unnest(range(0, 65)) AS j), (SELECT unnest(range(0, {units})) AS u)""",
            "b0": f"""SELECT u, class, CASE WHEN u = {units} THEN 0.0::DOUBLE ELSE {start.format('u * 2 + k')} END AS th, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v
                FROM (SELECT unnest(range(0, {units + 1})) AS u), c"""}
    for t in range(steps):
        moved = f"""th - {rate}::DOUBLE * ((0.9::DOUBLE * m + 0.1::DOUBLE * g) / {1 - 0.9 ** (t + 1)!r}::DOUBLE)
            / (sqrt((0.999::DOUBLE * v + 0.001::DOUBLE * g * g) / {1 - 0.999 ** (t + 1)!r}::DOUBLE) + 1e-8::DOUBLE) AS th, 0.9::DOUBLE * m + 0.1::DOUBLE * g AS m,
            0.999::DOUBLE * v + 0.001::DOUBLE * g * g AS v"""
        ctes |= {
            f"h{t}": f"""SELECT item_id, u, greatest(sum(x.v * a.th), 0) AS h FROM xs x JOIN a{t} a USING (j) GROUP BY item_id, u
                UNION ALL SELECT DISTINCT item_id, {units}, 1.0::DOUBLE FROM xs""",
            f"s{t}": f"""SELECT item_id, class, (1 / (1 + exp(-any_value(z))) - any_value(y)) * any_value(w) AS slope FROM cell JOIN (
                SELECT item_id, class, sum(h * th) AS z FROM h{t} JOIN b{t} USING (u) GROUP BY item_id, class) USING (item_id, class) GROUP BY item_id, class""",
            f"gb{t}": f"SELECT u, class, sum(slope * h) / (SELECT sum(w) FROM cell) AS g FROM s{t} JOIN h{t} USING (item_id) GROUP BY u, class",
            f"back{t}": f"""SELECT s.item_id, b.u, sum(slope * th) AS d FROM s{t} s JOIN b{t} b USING (class) JOIN h{t} h ON h.item_id = s.item_id AND h.u = b.u
                WHERE h > 0 AND b.u < {units} GROUP BY s.item_id, b.u""",
            f"ga{t}": f"SELECT j, u, sum(d * v) / (SELECT sum(w) FROM cell) AS g FROM back{t} JOIN xs USING (item_id) GROUP BY j, u",
            f"a{t + 1}": f"SELECT j, u, {moved} FROM (SELECT a.*, coalesce(g, 0) AS g FROM a{t} a LEFT JOIN ga{t} USING (j, u))",
            f"b{t + 1}": f"SELECT u, class, {moved} FROM (SELECT b.*, coalesce(g, 0) AS g FROM b{t} b LEFT JOIN gb{t} USING (u, class))"}
    return _planted_sql(ctes, f"""
        SELECT 0 AS layer, CAST(j AS INTEGER) AS i, CAST(u AS INTEGER) AS j, round(th, 6) + 0.0 AS value FROM a{steps}
        UNION ALL SELECT 1, CAST(u AS INTEGER), k, round(th, 6) + 0.0 FROM b{steps} JOIN c USING (class)""")


@query("h03_network_steps", _network_sql())
def _(spark, sf):
    """Two steps of a network with three hidden units from fixed weights."""
    start = [np.concatenate([np.sin(0.3 * np.arange(1, a * b + 1)).reshape(a, b) / 4, np.zeros((1, b))]) for a, b in ((64, 3), (3, 2))]
    net = network.train_network(planted_table(spark, sf), planted_labels(spark, sf), PLANTED, (3,), 2, 0.05, layers=start)
    rows = [(n, i, j, float(v)) for n, w in enumerate(net.layers) for i, line in enumerate(w) for j, v in enumerate(line)]
    return rounded(spark.createDataFrame(rows, "layer int, i int, j int, value double"), "value")


@query("h03_shared_network")
def _(spark, sf):
    labels, vectors = planted_labels(spark, sf), planted_table(spark, sf)
    net = network.train_network(vectors, labels, PLANTED, (8,), 40, 0.05, dropout=0.1)
    return _quality(metrics.run_summary(labels, net.predict(vectors), PLANTED))


@query("h04_linear_probe")
def _(spark, sf):
    _, matrix = training.linear_probe(planted_table(spark, sf), "c")
    return matrix


@query("h05_sample_and_evaluate")
def _(spark, sf):
    vectors = planted_table(spark, sf)
    noisy = vectors.select("item_id", gaussian_noise(1.0)(as_double("embedding"), F.col("item_id"), "x").alias("embedding"))
    return evaluate.sample_and_evaluate({"plain": vectors, "noisy": noisy}, planted_labels(spark, sf), "low", 2, noise=0.05, domains=True, rescale=True)


@query("h06_deepcluster_assign")
def _(spark, sf):
    vectors = planted_table(spark, sf).select("item_id", "embedding")
    held_out = vectors.select((-F.col("item_id") - 1).alias("item_id"), "embedding")
    assigned, _, test = cluster.deepcluster_assign(vectors, 6, 5, 2, held_out=held_out)
    return assigned.withColumn("side", F.lit("fit")).unionByName(test.withColumn("side", F.lit("held_out")))


@query("h07_cluster_epochs")
def _(spark, sf):
    vectors = planted_table(spark, sf).select("item_id", "embedding")
    later = vectors.select("item_id", gaussian_noise(0.1)(as_double("embedding"), F.col("item_id"), "later").alias("embedding"))
    epochs = cluster.cluster_epochs([vectors, later], 6, 4)
    sizes = [e["sizes"].select(F.lit(e["epoch"]).alias("epoch"), F.col("cluster").cast("string").alias("what"), F.col("n").cast("double").alias("value")) for e in epochs]
    change = epochs[1]["nmi"].select(F.lit(1).alias("epoch"), F.lit("nmi").alias("what"), F.col("nmi").alias("value"))
    feed = epochs[1]["feed"].agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(1).alias("epoch"), F.lit("feed").alias("what"), "value")
    return sizes[0].unionByName(sizes[1]).unionByName(change).unionByName(feed)


_GRID = "SELECT i, j, list_transform(range(0, 64), lambda k: sin(0.3::DOUBLE * (i * 4 + j + 1) * (k + 1)) / 8) AS w FROM (SELECT unnest(range(0, 3)) AS i), (SELECT unnest(range(0, 4)) AS j)"


@query("h08_som_assign", sql("embed_table", extra={"grid": _GRID}, body="""
    SELECT item_id, CAST(i AS INTEGER) AS gi, CAST(j AS INTEGER) AS gj FROM (SELECT e.item_id, g.i, g.j, row_number() OVER (PARTITION BY e.item_id
      ORDER BY round(list_dot_product(g.w, g.w) - 2 * list_dot_product(e.embedding, g.w), 12), g.i * 4 + g.j) AS r FROM embed_table e, grid g) WHERE r = 1"""))
def _(spark, sf):
    unit = np.arange(12).reshape(3, 4, 1) + 1.0
    grid = np.sin(0.3 * unit * (np.arange(64)[None, None, :] + 1.0)) / 8
    return cluster.som_assign(embed_table(spark, sf), grid)


_ASSIGNED = """SELECT item_id, embedding, i, j FROM (SELECT e.item_id, e.embedding, g.i, g.j, row_number() OVER (PARTITION BY e.item_id
    ORDER BY round(list_dot_product(g.w, g.w) - 2 * list_dot_product(e.embedding, g.w), 12), g.i * 4 + g.j) AS r FROM embed_table e, grid g) WHERE r = 1"""


@query("h08_som_epoch", sql("embed_table", extra={
    "grid": _GRID, "best": _ASSIGNED,
    "unit": "SELECT i, j, count(*) AS c FROM best GROUP BY i, j",
    "total": "SELECT i, j, k, sum(x) AS s FROM (SELECT i, j, unnest(range(0, 64)) AS k, unnest(embedding) AS x FROM best) GROUP BY i, j, k",
    "near": """SELECT g.i, g.j, u.i AS bi, u.j AS bj, u.c, exp(-((g.i - u.i) * (g.i - u.i) + (g.j - u.j) * (g.j - u.j)) / 3.0::DOUBLE) AS h
               FROM grid g JOIN unit u ON g.i - u.i BETWEEN -3 AND 2 AND g.j - u.j BETWEEN -3 AND 2""",
    "share": "SELECT i, j, 1 - exp(sum(c * ln(1 - 0.02::DOUBLE * h))) AS share, sum(h * c) AS weight FROM near GROUP BY i, j",
    "pull": "SELECT n.i, n.j, k, sum(h * s) AS pull FROM near n JOIN total t ON t.i = n.bi AND t.j = n.bj GROUP BY n.i, n.j, k",
    "was": "SELECT i, j, unnest(range(0, 64)) AS k, unnest(w) AS w FROM grid"}, body="""
    SELECT CAST(i AS INTEGER) AS gi, CAST(j AS INTEGER) AS gj, CAST(k AS INTEGER) AS k, round(CASE WHEN weight > 0 THEN w + share * (pull / weight - w) ELSE w END, 6) + 0.0 AS value
    FROM was LEFT JOIN share USING (i, j) LEFT JOIN pull USING (i, j, k)"""))
def _(spark, sf):
    """One epoch from a fixed grid."""
    unit = np.arange(12).reshape(3, 4, 1) + 1.0
    grid = cluster.som_train(embed_table(spark, sf), np.sin(0.3 * unit * (np.arange(64)[None, None, :] + 1.0)) / 8, 0.02, 1.5, epochs=1)
    rows = [(i, j, k, float(grid[i, j, k])) for i in range(3) for j in range(4) for k in range(64)]
    return rounded(spark.createDataFrame(rows, "gi int, gj int, k int, value double"), "value")


@query("h08_som_train")
def _(spark, sf):
    vectors = planted_table(spark, sf)
    grid = cluster.som_train(vectors, cluster.init_grid(vectors, 3, 3), epochs=3)
    return cluster.som_assign(vectors, grid)


@query("h09_self_train")
def _(spark, sf):
    labels, vectors = planted_labels(spark, sf), planted_table(spark, sf)
    strong = vectors.select("item_id", gaussian_noise(0.5)(as_double("embedding"), F.col("item_id"), "s").alias("embedding"))
    heads, _ = training.self_train(labels, vectors, strong, 0.9, rounds=1, steps=10, classes=PLANTED)
    return _quality(metrics.run_summary(labels, heads.predict(vectors), PLANTED))


@query("h10_distill")
def _(spark, sf):
    labels, vectors = planted_labels(spark, sf), planted_table(spark, sf)
    teacher = training.train_heads(vectors, labels, PLANTED, steps=20).predict(vectors)
    student = training.distill(teacher, vectors, PLANTED, 0.5, steps=12).predict(vectors)
    return metrics.auc(labels, student, PLANTED, None).join(metrics.worst_cases(labels, student, PLANTED), "class")


@query("h11_train_multitask")
def _(spark, sf):
    vectors = planted_table(spark, sf)
    t = vectors.select("item_id", F.when(F.col("item_id") % 7 != 3, F.concat(F.lit("c"), "c")).alias("lang"),
                       F.when(F.col("item_id") % 5 != 1, (F.col("c") < 2).cast("string")).alias("source"))
    val = F.col("item_id") % 3 == 0
    codes = encode_classes(t, class_codes(t.where(~val), t.where(val), TASKS), TASKS)
    models, _ = training.train_multitask(vectors, codes.where(~val), TASKS, "adaptive", 20)
    scored = codes.where(val).join(training.predict_multitask(models, vectors), "item_id")
    return metrics.task_accuracy(scored, {x: (f"{x}_code", f"{x}_probs") for x in TASKS})


def _trials(vectors):
    one = vectors.select(F.col("c").alias("trial")).distinct()
    return with_param_draws(one, "trial", (0.0, 0.1), (0.05, 0.5), lr_decay=True, optimizer=True, sampling=True)


@query("h12_random_search")
def _(spark, sf):
    vectors = planted_table(spark, sf)
    return evaluate.random_search(vectors, planted_labels(spark, sf), _trials(vectors), PLANTED, 8)


def _two_steps_sql() -> str:
    """Two full-batch steps of every trial from zero weights, position 64 being the bias."""
    return _planted_sql({
        "t": f"""SELECT trial, {u('0:lam', 'trial')} * 0.1::DOUBLE AS lam,
            exp(ln(0.05::DOUBLE) + {u('0:rate', 'trial')} * (ln(0.5::DOUBLE) - ln(0.05::DOUBLE))) AS rate,
            floor({u('0:decay', 'trial')} * 2) = 1 AS cosine, floor({u('0:optimizer', 'trial')} * 2) = 0 AS adam,
            (['class', 'instance', 'squareroot'])[CAST(floor({u('0:sampling', 'trial')} * 3) AS INTEGER) + 1] AS mode
            FROM (SELECT unnest(range(0, 4)) AS trial)""",
        **_KNOWN,
        "cell": "SELECT trial, k.item_id, k.class, k.y, w.w FROM t JOIN weight w USING (mode) JOIN known k USING (item_id)",
        "total": "SELECT trial, sum(w) AS total FROM cell GROUP BY trial",
        "xs": "SELECT item_id, unnest(range(0, 65)) AS j, unnest(list_append(x, 1.0::DOUBLE)) AS v FROM points",
        "g1": """SELECT trial, class, j, sum(w * (0.5::DOUBLE - y) * v) / any_value(total) AS g
            FROM cell JOIN total USING (trial) JOIN xs USING (item_id) GROUP BY trial, class, j""",
        "th1": "SELECT trial, class, j, g, CASE WHEN adam THEN -rate * g / (abs(g) + 1e-8::DOUBLE) ELSE -rate * g END AS th FROM g1 JOIN t USING (trial)",
        "p": """SELECT c.trial, c.class, c.item_id, any_value(c.w) AS w, any_value(c.y) AS y, 1 / (1 + exp(-sum(th * v))) AS p
            FROM cell c JOIN xs USING (item_id) JOIN th1 ON th1.trial = c.trial AND th1.class = c.class AND th1.j = xs.j GROUP BY c.trial, c.class, c.item_id""",
        "g2": """SELECT trial, class, j, sum(w * (p - y) * v) / any_value(total) AS g FROM p JOIN total USING (trial) JOIN xs USING (item_id) GROUP BY trial, class, j""",
        "both": """SELECT trial, class, j, th, a.g AS g1, b.g + CASE WHEN j < 64 THEN lam * th ELSE 0 END AS g2, adam, rate * CASE WHEN cosine THEN 0.5 ELSE 1 END AS rate
            FROM th1 a JOIN g2 b USING (trial, class, j) JOIN t USING (trial)"""}, """
        SELECT CAST(trial AS BIGINT) AS trial, class, CAST(j AS INTEGER) AS position, round(CASE WHEN adam
            THEN th - rate * ((0.09::DOUBLE * g1 + 0.1::DOUBLE * g2) / 0.19::DOUBLE) / (sqrt((0.000999::DOUBLE * g1 * g1 + 0.001::DOUBLE * g2 * g2) / 0.001999::DOUBLE) + 1e-8::DOUBLE)
            ELSE th - rate * (0.9::DOUBLE * g1 + g2) END, 6) + 0.0 AS value FROM both""")


@query("h12_trial_steps", _two_steps_sql().replace("both", "merged"))
def _(spark, sf):
    vectors, labels = planted_table(spark, sf), planted_labels(spark, sf)
    fits = trials.fit_trials(trials.training_cells(labels, {None: vectors}, PLANTED), trials.read_trials(_trials(vectors)), PLANTED, 2)
    values = F.concat("weights", F.array("bias"))
    return rounded(fits.table(spark).select("trial", "class", F.posexplode(values).alias("position", "value")), "value")


@query("h13_active_round")
def _(spark, sf):
    labels, vectors = planted_labels(spark, sf), planted_table(spark, sf)
    preds = vectors.select("item_id", *[F.lit(0.5).alias(c) for c in PLANTED])

    def annotate(picked):
        truth = picked.join(vectors, "item_id")
        each = F.explode(F.array(F.struct(F.lit("low").alias("field"), (F.col("c") < 2).cast("double").alias("value")),
                                 F.struct(F.lit("last").alias("field"), (F.col("c") == 3).cast("double").alias("value"))))
        return truth.select(F.lit(1).alias("ts"), F.col("item_id").alias("event_id"), "item_id", each.alias("e")).select(
            "ts", "event_id", "item_id", "e.*")

    state = evaluate.active_round(labels, preds, vectors, annotate, 20, PLANTED, steps=10)
    return _quality(state["summary"])


def _rounds_sql(n: int = 3, m: int = 20) -> str:
    """Each round labels the m first open rows by the draw of that round."""
    ctes = {"l0": "SELECT *, CAST(NULL AS INTEGER) AS round FROM planted_labels"}
    for r in range(1, n + 1):
        ctes[f"p{r}"] = f"""SELECT item_id FROM l{r - 1} WHERE low IS NULL AND last IS NULL AND NOT exclude
                            ORDER BY {u(f'0:{r}', 'item_id')}, item_id LIMIT {m}"""
        ctes[f"l{r}"] = f"""SELECT l.item_id, l.exclude, l.validation, CASE WHEN p.item_id IS NULL THEN low ELSE CAST(l.item_id % 4 < 2 AS INTEGER) END AS low,
                            CASE WHEN p.item_id IS NULL THEN last ELSE CAST(l.item_id % 4 = 3 AS INTEGER) END AS last,
                            CASE WHEN p.item_id IS NULL THEN round ELSE {r} END AS round FROM l{r - 1} l LEFT JOIN p{r} p USING (item_id)"""
    return _planted_sql(ctes, f"SELECT item_id, CAST(low AS DOUBLE) AS low, CAST(last AS DOUBLE) AS last, coalesce(round, 0) AS round FROM l{n}")


@query("h13_resumed_rounds", _rounds_sql())
def _(spark, sf):
    """Three rounds, the second of which fails once after its rows were picked."""
    labels, vectors = planted_labels(spark, sf), planted_table(spark, sf)
    preds = vectors.select("item_id", *[F.lit(0.5).alias(c) for c in PLANTED])
    failures = [2]

    def annotate(picked, no):
        if no in failures:
            failures.remove(no)
            raise InterruptedError("planned")
        each = F.explode(F.array(F.struct(F.lit("low").alias("field"), (F.col("c") < 2).cast("double").alias("value")),
                                 F.struct(F.lit("last").alias("field"), (F.col("c") == 3).cast("double").alias("value"))))
        return picked.join(vectors, "item_id").select(F.lit(no).alias("ts"), F.col("item_id").alias("event_id"), "item_id",
                                                      each.alias("e")).select("ts", "event_id", "item_id", "e.*")

    path, log = scratch_path(spark, "rounds"), None
    while log is None:
        try:
            log = rounds.label_rounds(path, labels, preds, vectors, annotate, 20, 3, classes=PLANTED, sort_by="random", steps=5)
        except InterruptedError:
            continue
    picked = log.history("picked").select("item_id", "round")
    return log.read("labels").select("item_id", *PLANTED).join(picked, "item_id", "left").na.fill(0, ["round"])


@query("h14_representation_report")
def _(spark, sf):
    return evaluate.representation_report(planted_table(spark, sf), view_pairs(spark, sf), "c")


# ---- J: streams over the event file -----------------------------------------------------------------------------

def _in_files(spark, sf, name, order, files=4):
    """The table as a stream over several files, one a micro-batch. Files are cut along `order`, but a tenth of all rows
    lie in another file than their place, so late rows come."""
    folder, source = scratch_path(spark, name), table(spark, sf, name)
    cuts = source.approxQuantile(order, [i / files for i in range(1, files)], 0.01)
    place = sum([F.when(F.col(order) > c, 1).otherwise(0) for c in cuts], F.lit(1))
    late = F.when(F.pmod(F.xxhash64(order), F.lit(10)) == 0, F.pmod(F.xxhash64(order), F.lit(files)) + 1).otherwise(place)
    parts = source.withColumn("_file", late).persist()
    try:
        for i in range(1, files + 1):
            parts.where(F.col("_file") == i).drop("_file").coalesce(1).write.mode("append").parquet(folder)
    finally:
        parts.unpersist()
    return streams.event_stream(spark, folder, source.schema, files_per_trigger=1)


def _events(spark, sf):
    return as_label_events(_in_files(spark, sf, "events", "event_id"))


def _finish(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


@query("j01_label_event_stream", _applied("SELECT item_id, field, value, ts, event_id FROM label_events"))
def _(spark, sf):
    log, mark = scratch_path(spark, "edit-log"), scratch_path(spark, "edit-mark")
    _finish(streams.label_event_stream(_events(spark, sf), log, mark, [*BOOLEAN_FIELDS, *CLASSES]))
    return streams.current_labels(label_table(spark, sf), log, CLASSES).select("item_id", "exclude", "validation", *CLASSES)


@query("j02_running_label_counts", sql("label_events", body="SELECT field, value, count(*) AS n FROM label_events GROUP BY field, value"))
def _(spark, sf):
    path = scratch_path(spark, "counts")
    _finish(streams.running_label_counts(_events(spark, sf), path, scratch_path(spark, "counts-mark")))
    return streams.newest_batch(spark, path)


@query("j02_windowed_label_counts", sql("label_events", body="""
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, field, count(*) AS n FROM label_events GROUP BY 1, 2"""))
def _(spark, sf):
    path = scratch_path(spark, "windows")
    _finish(streams.windowed_label_counts(_events(spark, sf), path, scratch_path(spark, "windows-mark")))
    return streams.newest_batch(spark, path).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "field", "n")


@query("j03_stream_latest_k", "SELECT vec_id, embedding[1]::DOUBLE AS first, label FROM embeddings ORDER BY vec_id DESC LIMIT 64")
def _(spark, sf):
    path = scratch_path(spark, "queue")
    _finish(streams.stream_latest_k(_in_files(spark, sf, "embeddings", "vec_id"), 64, "vec_id", path, scratch_path(spark, "queue-mark")))
    return streams.newest_batch(spark, path).select("vec_id", F.col("embedding")[0].cast("double").alias("first"), "label")


@query("j04_stream_score")
def _(spark, sf):
    labels, vectors = planted_labels(spark, sf), planted_table(spark, sf)
    heads = training.train_heads(vectors, labels, PLANTED, steps=10)
    path = scratch_path(spark, "scored")
    stream = streams.event_stream(spark, sf, table(spark, sf, "embeddings").schema, "embeddings.parquet")
    items = stream.select(F.col("vec_id").alias("item_id"), "embedding")
    _finish(streams.stream_score(items, heads.predict, PLANTED, 0.5, path, scratch_path(spark, "scored-mark")))
    return spark.read.schema("item_id long, low double, last double, entropy double").parquet(path)
