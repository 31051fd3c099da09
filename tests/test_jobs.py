import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.operators import corpus, encode, metrics
from tagweave.operators.edits import apply_label_events
from tagweave.plans import cluster, evaluate, propagate, training
from tagweave.session import scratch_path
from tagweave.streaming import edits as streams

N = 240


@pytest.fixture(scope="module")
def planted(spark):
    """Four separable groups of vectors and a label table of two classes with gaps."""
    rng = np.random.default_rng(11)
    c = np.arange(N) % 4
    x = np.eye(6)[c] * 4 + rng.normal(size=(N, 6)) * 0.5
    rows = [(i, [float(v) for v in r], int(g)) for i, (r, g) in enumerate(zip(x, c))]
    vectors = spark.createDataFrame(rows, "item_id long, embedding array<double>, c int").repartition(3).cache()
    labels = vectors.select("item_id", F.lit("").alias("filepath"), (F.col("item_id") % 17 == 0).alias("exclude"),
                            (F.col("item_id") % 5 == 0).alias("validation"),
                            F.when(F.col("item_id") % 3 != 1, (F.col("c") < 2).cast("double")).alias("low"),
                            F.when(F.col("item_id") % 7 != 2, (F.col("c") == 3).cast("double")).alias("last")).cache()
    return x, c, vectors, labels


def brute_propagate(x, neg, pos, k, temp, rounds):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 9)
    np.fill_diagonal(d, np.inf)
    a = np.zeros_like(d)
    for i, near in enumerate(np.argsort(d, axis=1, kind="stable")[:, :k]):
        a[i, near] = np.exp(-d[i, near] / temp)
    s = 1 / np.sqrt(a.sum(1))
    w = s[:, None] * a * s[None, :]
    y = np.stack([neg, pos], 1).astype(float)
    hard = y > 0
    for _ in range(rounds):
        y = w @ y
        y[hard] = 1.0
    with np.errstate(invalid="ignore"):
        return y[:, 1] / y.sum(1)


@pytest.mark.parametrize("hub", [100_000, 3])
def test_propagation_matches_matrix_form(spark, planted, monkeypatch, hub):
    monkeypatch.setattr(propagate, "HUB_EDGES", hub)
    x, c, vectors, labels = planted
    sparse = labels.select("item_id", "filepath", "exclude", "validation", F.when(F.col("item_id") < 12, F.col("low")).alias("low"))
    got = {r["item_id"]: r["low"] for r in propagate.propagate_labels(sparse, vectors=vectors, iterations=7, n_neighbors=4, temp=0.1).collect()}
    known = np.array([i < 12 and i % 3 != 1 and i % 17 != 0 and i % 5 != 0 for i in range(N)])
    want = brute_propagate(x, known & (c >= 2), known & (c < 2), 4, 0.1, 7)
    for i in range(N):
        assert (got[i] is None) == bool(np.isnan(want[i]))
        assert got[i] is None or abs(got[i] - want[i]) < 1e-6


def accuracy(labels, scores, classes):
    return [r["accuracy"] for r in metrics.auc(labels, scores, classes, True).collect()]


@pytest.mark.parametrize("options", [dict(), dict(smoothing=0.1, normalize=True), dict(loss="focal", steps=20), dict(mode="instance", weight_decay=0.01)])
def test_heads_learn_planted_classes(planted, options):
    _, _, vectors, labels = planted
    heads = training.train_heads(vectors, labels, **options)
    assert min(accuracy(labels, heads.predict(vectors), ["low", "last"])) > 0.95
    assert heads.loss[-1] < heads.loss[0]


def test_focal_gradient_is_right():
    p, y, w = np.array([[0.3, 0.8]]), np.array([[1.0, 0.0]]), np.ones((1, 2))
    logit = np.log(p / (1 - p))
    for kind, opts in (("focal", {"gamma": 2.0}), ("soft", {}), ("distill", {"temp": 0.7})):
        slope = training._loss_and_slope(kind, p, y, w, opts)[1]
        h = 1e-6
        up, down = (training._loss_and_slope(kind, training._sigmoid(logit + s), y, w, opts)[0] for s in (h, -h))
        assert np.allclose(slope, (up - down) / (2 * h), atol=1e-6)


def test_mlp_and_probe(planted):
    _, _, vectors, labels = planted
    models = training.train_mlp_head(vectors, labels, ["low"], (5,), 40)
    assert accuracy(labels, training.predict_mlp(models, vectors.select("item_id", "embedding")), ["low"])[0] > 0.9
    acc, matrix = training.linear_probe(vectors, "c")
    assert acc.first()[0] > 0.95 and matrix.agg(F.sum("n")).first()[0] == N // 3


def test_self_training_and_distillation(planted):
    _, _, vectors, labels = planted
    open_rows = labels.withColumns({c: F.when(F.floor(F.col("item_id") / 4) % 2 == 0, F.col(c)) for c in ("low", "last")})
    heads, report = training.self_train(open_rows, vectors, vectors, 0.9, rounds=1, steps=15)
    assert 0 < report[0]["mask_fraction"] <= 1
    assert min(accuracy(labels, heads.predict(vectors), ["low", "last"])) > 0.9
    teacher = heads.predict(vectors)
    student = training.distill(teacher, vectors, ["low", "last"], 0.5, steps=20).predict(vectors)
    assert min(accuracy(labels, student, ["low", "last"])) > 0.9


def test_multitask(planted):
    _, _, vectors, _ = planted
    t = vectors.select("item_id", F.when(F.col("item_id") % 7 != 3, F.concat(F.lit("c"), "c")).alias("one"), (F.col("c") < 2).cast("string").alias("two"))
    codes = encode.encode_classes(t, encode.class_codes(t, t, ["one", "two"]), ["one", "two"])
    models, report = training.train_multitask(vectors, codes, ["one", "two"], "adaptive", 15)
    scored = codes.join(training.predict_multitask(models, vectors), "item_id")
    out = metrics.task_accuracy(scored, {x: (f"{x}_code", f"{x}_probs") for x in ("one", "two")}).collect()
    assert all(r["accuracy"] > 0.95 for r in out) and len(report) == 2


def test_evaluation_runs(planted):
    _, _, vectors, labels = planted
    out = evaluate.sample_and_evaluate({"a": vectors}, labels, "low", 1, smallest=30, holdout=True).collect()
    assert len(out) == 1 and out[0]["test_accuracy"] > 0.9 and abs(out[0]["test_error"] + out[0]["test_accuracy"] - 1) < 1e-12
    assert evaluate.run_this_epoch(True, 0) and not evaluate.run_this_epoch(False, 3)
    assert not evaluate.run_this_epoch(2, 0) and evaluate.run_this_epoch(2, 4)
    assert evaluate.should_stop([3, 1, 2, 2], 2) and not evaluate.should_stop([3, 2, 1], 2)


def test_deepcluster(planted):
    _, _, vectors, _ = planted
    assigned, centres, held = cluster.deepcluster_assign(vectors, 4, 4, 2, held_out=vectors.where("item_id < 5"))
    both = assigned.join(vectors.select("item_id", "c"), "item_id")
    assert metrics.nmi(both, "cluster", "c").first()[0] > 0.9 and centres.shape == (4, 4) and held.count() == 5


def test_map_epoch_equals_the_sum_over_pairs_of_units():
    rng = np.random.default_rng(2)
    units, counts = rng.normal(size=(7, 5, 3)), rng.integers(0, 4, (7, 5)).astype(float)
    sums = rng.normal(size=(7, 5, 3)) * counts[..., None]
    for rate, radius in ((0.1, 1.0), (1.0, 2.0), (0.3, 0.0)):
        got = cluster._moved(units, sums, counts, rate, radius)
        for place in np.ndindex(7, 5):
            keep, pull, weight = 1.0, np.zeros(3), 0.0
            for best in np.ndindex(7, 5):
                down, across = place[0] - best[0], place[1] - best[1]
                if down in cluster.WINDOW and across in cluster.WINDOW:
                    d2 = down ** 2 + across ** 2
                    h = float(d2 == 0) if radius == 0 else np.exp(-d2 / 2 / radius)
                    keep *= (1 - rate * h) ** counts[best]
                    pull, weight = pull + h * sums[best], weight + h * counts[best]
            want = units[place] if weight == 0 else keep * units[place] + (1 - keep) * pull / weight
            assert np.allclose(got[place], want)


def test_som(spark, planted):
    x, _, vectors, _ = planted
    grid = np.random.default_rng(0).normal(size=(3, 5, 6))
    got = {r["item_id"]: (r["gi"], r["gj"]) for r in cluster.som_assign(vectors, grid).collect()}
    d = ((x[:, None, None, :] - grid[None]) ** 2).sum(3)
    assert all(got[i] == np.unravel_index(d[i].argmin(), (3, 5)) for i in range(N))
    new = cluster.som_train(vectors, grid, epochs=4)
    assert np.min(((x[:, None, None, :] - new[None]) ** 2).sum(3).reshape(N, -1), axis=1).mean() < d.reshape(N, -1).min(1).mean()


def test_vocabulary_and_encoding(spark):
    df = spark.createDataFrame([(0, "b a, A!"), (1, "...a c"), (2, None), (3, "")], "item_id long, text string")
    v = corpus.build_vocabulary(df)
    assert {r["token"]: r["token_id"] for r in v.collect()} == {"a": 4, "b": 5, "c": 6}
    got = {r["item_id"]: r["token_ids"] for r in corpus.encode_corpus(df.where("text is not null"), v, 6, side="end").collect()}
    assert got == {0: [2, 5, 4, 4, 3, 0], 1: [2, 4, 6, 3, 0, 0], 3: [2, 3, 0, 0, 0, 0]}
    short = {r["item_id"]: r["token_ids"] for r in corpus.encode_corpus(
        df.where("item_id < 2"), v.where("token <> 'c'"), 3, prompt_fn=lambda t: F.concat(F.lit("c "), t)).collect()}
    assert short == {0: [2, 1, 5], 1: [2, 1, 4]}


def test_encoding_with_pandas_tokenizer(spark):
    import pandas as pd

    @F.pandas_udf("array<int>")
    def lengths(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [len(w) for w in t.split()])

    df = spark.createDataFrame([(0, "aa b"), (1, "cccc")], "item_id long, text string")
    got = {r["item_id"]: r["token_ids"] for r in corpus.encode_corpus(df, None, 3, tokenizer=lengths).collect()}
    assert got == {0: [0, 2, 1], 1: [0, 0, 4]}


def test_stream_equals_batch_and_survives_repeats(spark, planted):
    _, _, vectors, labels = planted
    folder = scratch_path(spark, "events")
    events = spark.range(600).select(
        (F.col("id") * 7 % 600).cast("timestamp").alias("ts"), F.col("id").alias("event_id"), (F.col("id") * 13 % N).alias("item_id"),
        F.element_at(F.array(*[F.lit(f) for f in ("low", "last", "exclude", "validation")]), (F.col("id") % 4 + 1).cast("int")).alias("field"),
        F.when(F.col("id") % 5 == 0, None).otherwise((F.col("id") % 2).cast("double")).alias("value"))
    events.repartition(5).write.parquet(folder)
    fields = ["exclude", "validation", "low", "last"]
    log, mark = scratch_path(spark, "log"), scratch_path(spark, "mark")
    for _ in range(2):
        stream = streams.event_stream(spark, folder, events.schema, files_per_trigger=2)
        streams.label_event_stream(stream, log, mark, fields).awaitTermination()
    want = sorted(map(tuple, apply_label_events(labels, events).collect()), key=str)
    assert sorted(map(tuple, streams.current_labels(labels, log).collect()), key=str) == want
    folded = scratch_path(spark, "folded")
    streams.compact_log(spark, log, folded, fields)
    assert sorted(map(tuple, streams.current_labels(labels, folded).collect()), key=str) == want

    path = scratch_path(spark, "counts")
    streams.running_label_counts(streams.event_stream(spark, folder, events.schema, files_per_trigger=2), path, scratch_path(spark, "m")).awaitTermination()
    batch = events.groupBy("field", "value").count()
    assert sorted(map(str, map(tuple, streams.newest_batch(spark, path).collect()))) == sorted(map(str, map(tuple, batch.collect())))

    queue = scratch_path(spark, "queue")
    streams.stream_latest_k(streams.event_stream(spark, folder, events.schema, files_per_trigger=2).select("event_id"), 20, "event_id",
                            queue, scratch_path(spark, "m")).awaitTermination()
    newest = spark.read.parquet(queue)
    last = newest.where(F.col("batch") == newest.agg(F.max("batch")).first()[0])
    assert sorted(r["event_id"] for r in last.collect()) == list(range(580, 600))


def test_active_round(spark, planted):
    _, _, vectors, labels = planted
    preds = vectors.select("item_id", F.lit(0.5).alias("low"), F.lit(0.5).alias("last"))

    def annotate(picked):
        each = F.explode(F.array(F.struct(F.lit("low").alias("field"), (F.col("c") < 2).cast("double").alias("value"))))
        return picked.join(vectors, "item_id").select(F.lit(1).alias("ts"), F.col("item_id").alias("event_id"), "item_id", each.alias("e")).select(
            "ts", "event_id", "item_id", "e.*")

    state = evaluate.active_round(labels, preds, vectors, annotate, 5, steps=10)
    before = labels.agg(F.count("low")).first()[0]
    assert state["labels"].agg(F.count("low")).first()[0] == before + state["picked"].count()
    assert state["summary"].count() == 2 and state["val_loss"].first()["loss"] < 0.7


def test_state_partitions_are_not_one_task(spark, tmp_path, monkeypatch):
    """The result is one file, but its partitions are not coalesced into the task that writes it."""
    import glob

    from pyspark.sql.classic.dataframe import DataFrame

    source, path = str(tmp_path / "events"), str(tmp_path / "counts")
    spark.range(90).select((F.col("id") % 9).cast("string").alias("field"), F.timestamp_seconds(F.col("id") * 7200).alias("ts")).write.parquet(source)
    monkeypatch.setattr(DataFrame, "coalesce", lambda *a: pytest.fail("coalesced"))
    stream = spark.readStream.schema("field string, ts timestamp").parquet(source)
    q = streams.windowed_label_counts(stream, path, str(tmp_path / "mark"))
    q.awaitTermination()
    assert q.exception() is None
    got = streams.newest_batch(spark, path).collect()
    assert sum(r["n"] for r in got) == 90 and len({(r["window_start"], r["field"]) for r in got}) == len(got)
    assert len(glob.glob(f"{path}/batch=0/*.parquet")) == 1
