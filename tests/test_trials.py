import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.operators.sample import add_label_noise, learning_curve_subsample
from tagweave.plans import evaluate, experiments, trials
from tagweave.session import scratch_path
from tagweave.sources.store import log_metrics  # noqa: F401


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(240, 3)) * [1, 5, 0.2] + [0, 3, 1]
    y = (x[:, 0] + 0.1 * x[:, 1] + rng.normal(size=240) * 0.7 > 0.3).astype(float)
    rows = [(i, [float(v) for v in x[i]], float(y[i]), None if i % 3 == 0 else float(i % 2), f"s{i % 4}", i % 5 == 0, i % 11 == 0) for i in range(240)]
    t = spark.createDataFrame(rows, "item_id long, embedding array<double>, a double, b double, subset string, validation boolean, exclude boolean")
    return x, y, t.select("item_id", "embedding"), t.drop("embedding").withColumn("filepath", F.lit(""))


def test_lbfgs_reaches_the_penalised_optimum(world):
    x, y, vectors, labels = world
    cells = trials.training_cells(labels.drop("b"), {None: vectors}, ["a"])
    table = [{**trials.DEFAULTS, "trial": i, "lam": lam, "optimizer": "lbfgs", "sampling": "instance"} for i, lam in enumerate((0.01, 1.0))]
    fits = trials.fit_trials(cells, table, ["a"], 80)
    use = np.array([i % 5 != 0 and i % 11 != 0 for i in range(240)])
    for t, lam in enumerate((0.01, 1.0)):
        w, b = fits.weights[t][:, 0], fits.bias[t][0]
        slope = sigmoid(x[use] @ w + b) - y[use]
        assert np.abs(x[use].T @ slope / use.sum() + lam * w).max() < 1e-5 and abs(slope.mean()) < 1e-5


def test_scaled_trials_equal_scaled_data(spark, world):
    x, y, vectors, labels = world
    cells = trials.training_cells(labels.drop("b"), {None: vectors}, ["a"])
    mean, scale = x.mean(0), x.std(0)
    scaled = spark.createDataFrame([(i, [float(v) for v in (x[i] - mean) / scale]) for i in range(240)], "item_id long, embedding array<double>")
    one = [{**trials.DEFAULTS, "trial": 0, "lam": 0.1, "optimizer": "lbfgs"}]
    a = trials.fit_trials(cells, one, ["a"], 60, scalers=[(mean, scale)])
    b = trials.fit_trials(trials.training_cells(labels.drop("b"), {None: scaled}, ["a"]), one, ["a"], 60)
    assert np.allclose(a.weights[0] * scale[:, None], b.weights[0], atol=1e-5)
    assert np.allclose(x @ a.weights[0] + a.bias[0], (x - mean) / scale @ b.weights[0] + b.bias[0], atol=1e-5)


def test_jobs_do_not_grow_with_trials(spark, world):
    _, _, vectors, labels = world

    def jobs(n):
        table = spark.range(n).select(F.col("id").alias("trial"), (F.col("id") * 0.01).alias("lam"))
        spark.sparkContext.setJobGroup(f"trials{n}", "")
        evaluate.random_search(vectors, labels, table, ["a", "b"], 3).collect()
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trials{n}"))

    assert jobs(9) <= jobs(2) + 1


def test_settings_of_trials_have_effect_and_are_logged(spark, world):
    _, _, vectors, labels = world
    base = dict(lam=0.0, learning_rate=0.1, lr_decay="none", optimizer="adam", sampling="class")
    change = [{}, {"lam": 0.5}, {"learning_rate": 0.3}, {"lr_decay": "cosine"}, {"optimizer": "momentum"}, {"sampling": "squareroot"}]
    table = spark.createDataFrame([(i, *{**base, **c}.values()) for i, c in enumerate(change)],
                                  "trial long, lam double, learning_rate double, lr_decay string, optimizer string, sampling string")
    _, fits = trials.search(vectors, labels, table, ["a", "b"], 4)
    for t in range(1, len(change)):
        assert not np.allclose(fits.weights[0], fits.weights[t])
    path = scratch_path(spark, "log")
    out = evaluate.random_search(vectors, labels, table, ["a", "b"], 4, log_path=path, run_id="r").collect()
    log = spark.read.parquet(path)
    assert len(out) == 12 and log.where("name LIKE '%_loss'").count() == 24 and log.where("name LIKE '%_auc'").count() == 12
    assert {r["name"]: r["value"] for r in log.collect()}["trial_3_a_auc"] == [r["auc"] for r in out if r["trial"] == 3 and r["class"] == "a"][0]
    with pytest.raises(ValueError, match="unknown setting"):
        trials.read_trials(table.withColumn("optimizer", F.lit("other")))


@pytest.mark.parametrize("collected, bits", [(4096, 10), (1, 3)])
def test_draws_are_the_first_rows_by_key(spark, monkeypatch, collected, bits):
    monkeypatch.setattr(experiments, "COLLECTED", collected)
    monkeypatch.setattr(experiments, "STEP_BITS", bits)
    rows = spark.range(500).select(F.col("id").alias("item_id"), (F.col("id") % 3 == 0).cast("double").alias("y")).repartition(5)
    draws = [(F.lit(True), "s1:curve", 37), (F.col("y") == 1, "s2:curve", 20), (F.lit(True), "s3:curve", 500), (F.lit(True), "s4:curve", 501), (F.lit(True), "s5", 0)]
    bounds = experiments.bounds_of_draws(rows, draws)

    def got(i):
        cond, seed, _ = draws[i]
        return sorted(r["item_id"] for r in rows.where(cond & experiments._first(experiments._key(seed, "item_id"), bounds[i], "item_id")).collect())

    want = learning_curve_subsample(rows, 37, "y", None, seed="s1")
    assert got(0) == sorted(r["item_id"] for r in want.collect())
    want = learning_curve_subsample(rows.where("y = 1"), 20, "y", None, seed="s2")
    assert got(1) == sorted(r["item_id"] for r in want.collect())
    assert len(got(2)) == 500 and bounds[3] is None and len(got(3)) == 500 and got(4) == []


def test_experiments_against_numpy(spark, world):
    x, y, vectors, labels = world
    out = evaluate.sample_and_evaluate({"v": vectors, "w": vectors.select("item_id", F.transform("embedding", lambda v: v * 2).alias("embedding"))},
                                       labels, "a", 3, smallest=40, noise=0.1, domains=True, rescale=True, seed=5, pos_prob=0.4).collect()
    assert len(out) == 6 and all(r["rescale"] and not r["normalize"] and r["pos_class_prob"] == 0.4 for r in out)
    pool = labels.where("NOT exclude AND NOT validation").select("item_id", F.col("a").alias("y"), "subset")
    for r in out:
        assert r["test_domain"] not in r["training_domains"].split(", ") and len(r["training_domains"].split(", ")) == 3
        if r["extractor"] == "w":  # rescaled, twice the vector is the same
            other = next(o for o in out if o["experiment"] == r["experiment"] and o["extractor"] == "v")
            assert all(abs(r[c] - other[c]) < 1e-6 for c in ("train_accuracy", "test_accuracy", "train_auc", "test_auc"))
            continue
        tag = next(f"5:{r['experiment']}:{a}" for a in range(9) if min(("s0", "s1", "s2", "s3"), key=lambda s: experiments._uniform(f"5:{r['experiment']}:{a}:domain", s)) == r["test_domain"])
        train = pool.where(F.col("subset") != r["test_domain"])
        n_pos = max(1, int(r["n"] * 0.4))
        drawn = add_label_noise(learning_curve_subsample(train, r["n"], "y", 0.4, seed=tag), ["y"], 0.1, seed=tag).collect()
        if len(drawn) != r["n"]:
            continue  # a class was too rare for the size asked; n is what was drawn
        ids, target = np.array([d["item_id"] for d in drawn]), np.array([d["y"] for d in drawn])
        mean, scale = x[ids].mean(0), x[ids].std(0)
        z, theta = np.c_[(x[ids] - mean) / scale, np.ones(len(ids))], np.zeros(4)
        ridge = np.diag([1.0, 1.0, 1.0, 0.0])
        for _ in range(50):  # Newton
            p = sigmoid(z @ theta)
            theta -= np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge, z.T @ (p - target) + ridge @ theta)
        test = [t["item_id"] for t in pool.where(F.col("subset") == r["test_domain"]).collect()]
        hit = ((np.c_[(x[test] - mean) / scale, np.ones(len(test))] @ theta >= 0) == (y[test] == 1)).mean()
        assert abs(r["train_accuracy"] - ((z @ theta >= 0) == (target == 1)).mean()) < 1e-9 and abs(r["test_accuracy"] - hit) < 1e-9


def test_experiments_without_two_classes(spark, world):
    _, _, vectors, labels = world
    with pytest.raises(ValueError, match="both classes"):
        evaluate.sample_and_evaluate({"v": vectors}, labels.withColumn("a", F.lit(1.0)), "a", 2, max_tries=3)
    out = evaluate.sample_and_evaluate({"v": vectors}, labels, "a", 2, normalize=True, holdout=True, smallest=30)
    assert [r["normalize"] for r in out.collect()] == [True, True] and out.where("test_domain IS NULL AND training_domains IS NULL").count() == 2
