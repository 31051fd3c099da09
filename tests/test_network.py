import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.plans import network


@pytest.fixture(scope="module")
def world(spark):
    """An exclusive-or of two signs, which no linear head can learn, and a class of which half is unknown."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    a, b = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float), (x[:, 2] > 0).astype(float)
    rows = [(i, [float(v) for v in x[i]], float(a[i]), float(b[i]) if i % 2 else None, i % 7 == 0, False) for i in range(300)]
    t = spark.createDataFrame(rows, "item_id long, embedding array<double>, a double, b double, validation boolean, exclude boolean").repartition(4)
    return x, a, b, t.select("item_id", "embedding"), t.drop("embedding").withColumn("filepath", F.lit(""))


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    layers = [w + 0.1 * rng.normal(size=w.shape) for w in network.start_layers([3, 5, 4, 2], 0)]
    x, y, w = rng.normal(size=(20, 3)), rng.integers(0, 2, (20, 2)).astype(float), rng.random((20, 2))
    for masks in (None, [network.kept_units(np.arange(20), n, at, 1, 0, 0.4) for at, n in enumerate((5, 4))]):
        grads, _ = network.gradient(layers, x, y, w, masks)
        for n, i, j in ((0, 0, 0), (0, 3, 2), (1, 2, 3), (1, 5, 0), (2, 4, 1), (2, 1, 0)):
            step = np.zeros_like(layers[n])
            step[i, j] = 1e-6
            side = [network.gradient([u + s * step if k == n else u for k, u in enumerate(layers)], x, y, w, masks)[1] for s in (1, -1)]
            assert abs((side[0] - side[1]) / 2e-6 - grads[n][i, j]) < 1e-6


@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_two_steps_equal_numpy(spark, world, dropout):
    x, a, b, vectors, labels = world
    start = network.start_layers([3, 6, 2], 4)
    net = network.train_network(vectors, labels, ["a", "b"], (6,), 2, 0.05, 0.01, dropout, "instance", 4, start)
    use = np.array([i for i in range(300) if i % 7])
    y = np.c_[a, b][use]
    known = np.c_[np.ones(300), np.arange(300) % 2][use]
    ids = np.array([r["h"] for r in spark.createDataFrame([(int(i),) for i in use], "item_id long").select(F.xxhash64("item_id").alias("h")).collect()])
    layers, m, v = [w.copy() for w in start], [0, 0], [0, 0]
    # By instance every stratum has a weight of 1, so a row counts once per known class.
    w = known * known.sum(1, keepdims=True)
    for step in (1, 2):
        masks = [network.kept_units(ids, 6, 0, step, 4, dropout)] if dropout else None
        h = np.maximum(x[use] @ layers[0][:-1] + layers[0][-1], 0) * (masks[0] if masks else 1)
        slope = (1 / (1 + np.exp(-(h @ layers[1][:-1] + layers[1][-1]))) - y) * w / w.sum()
        back = (slope @ layers[1][:-1].T) * (h > 0) * (masks[0] if masks else 1)
        grads = [np.r_[x[use].T @ back, back.sum(0)[None]], np.r_[h.T @ slope, slope.sum(0)[None]]]
        for n in (0, 1):
            grads[n][:-1] += 0.01 * layers[n][:-1]
            m[n], v[n] = 0.9 * m[n] + 0.1 * grads[n], 0.999 * v[n] + 0.001 * grads[n] ** 2
            layers[n] = layers[n] - 0.05 * (m[n] / (1 - 0.9 ** step)) / (np.sqrt(v[n] / (1 - 0.999 ** step)) + 1e-8)
    assert all(np.allclose(p, q, atol=1e-9) for p, q in zip(net.layers, layers))


def test_learns_what_a_linear_head_cannot_and_ignores_unknown_labels(spark, world):
    x, a, b, vectors, labels = world
    net = network.train_network(vectors, labels, ["a", "b"], (16,), 120, 0.05, dropout=0.1, seed=1)
    got = {r["item_id"]: (r["a"], r["b"]) for r in net.predict(vectors).collect()}
    held = [i for i in range(300) if i % 7 == 0]
    assert np.mean([(got[i][0] > 0.5) == a[i] for i in held]) > 0.85 and np.mean([(got[i][1] > 0.5) == b[i] for i in held]) > 0.85
    assert net.loss[-1] < 0.5 * net.loss[0]
    linear = network.train_network(vectors, labels, ["a", "b"], (), 60, 0.05).predict(vectors).collect()
    assert np.mean([(r["a"] > 0.5) == a[r["item_id"]] for r in linear if r["item_id"] % 7 == 0]) < 0.75
    # Rows without any label change nothing.
    more = vectors.unionByName(vectors.select((F.col("item_id") + 1000).alias("item_id"), F.transform("embedding", lambda v: v * 9).alias("embedding")))
    blank = labels.unionByName(labels.withColumn("item_id", F.col("item_id") + 1000).withColumns({c: F.lit(None).cast("double") for c in ("a", "b")}))
    one, two = (network.train_network(v, t, ["a", "b"], (4,), 3, seed=2) for v, t in ((vectors, labels), (more, blank)))
    assert all(np.allclose(p, q, atol=1e-9) for p, q in zip(one.layers, two.layers))
    with pytest.raises(ValueError, match="known label"):
        network.train_network(vectors, labels.withColumns({c: F.lit(None).cast("double") for c in ("a", "b")}), ["a", "b"])
