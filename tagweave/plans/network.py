"""A multi-label network with shared hidden layers on top of given vectors, trained by full-batch gradients.

Labels may be missing: a NULL cell has no weight, so it changes neither loss nor gradient. A step is one job: every task adds the
gradient of its rows, cut into chunks, the chunks are summed by a shuffle each in a task of its own, and the driver moves the
weights. Dropout draws from (seed, step, row id, layer, unit) only, so a task that runs again drops the same units.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.vectors import as_double, sum_vectors
from tagweave.operators import blocks as B
from tagweave.plans.trials import MODES, _PARTIAL, _sigmoid, training_cells
from tagweave.schema import ID, class_columns

CHUNK = 1 << 16   # numbers of a gradient that are summed as one vector
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Network:
    """layers[l] is (inputs + 1) × outputs, the last line being the bias; relu between layers, a sigmoid per class at the end."""

    classes: list[str]
    layers: list[np.ndarray]
    loss: list[float] = field(default_factory=list)

    def predict(self, vectors: DataFrame, id_col: str = ID, vec: str = "embedding") -> DataFrame:
        layers, classes = self.layers, self.classes
        rows = vectors.select(F.col(id_col).alias("id"), as_double(vec).alias("x"))
        schema = T.StructType([T.StructField("id", rows.schema["id"].dataType)] + [T.StructField(c, T.DoubleType()) for c in classes])

        def score(batches):
            for batch in batches:
                if batch.num_rows:
                    p = _sigmoid(forward(layers, B.matrix_of(batch.column("x")))[-1])
                    yield B.to_batch({"id": batch.column("id"), **{c: p[:, i] for i, c in enumerate(classes)}}, schema)

        return rows.mapInArrow(score, schema).withColumnRenamed("id", id_col)


def start_layers(sizes: list[int], seed: int) -> list[np.ndarray]:
    """Normal weights of variance 2 / inputs and zero biases."""
    rng = np.random.default_rng(seed)
    return [np.concatenate([rng.normal(size=(a, b)) * np.sqrt(2.0 / a), np.zeros((1, b))]) for a, b in zip(sizes, sizes[1:])]


def kept_units(ids: np.ndarray, units: int, layer: int, step: int, seed: int, rate: float) -> np.ndarray:
    """1 / (1 - rate) for units that stay and 0 for those dropped, a pure function of the arguments."""
    h = ids.astype(np.int64).view(np.uint64)[:, None] * _A + np.arange(units, dtype=np.uint64)[None, :] * _B
    for part in (layer, step, seed):
        h = (h ^ (h >> np.uint64(29))) * _A + np.uint64(part & (2 ** 63 - 1))
    h = (h ^ (h >> np.uint64(32))) * _B
    return ((h >> np.uint64(11)).astype(np.float64) / 2.0 ** 53 >= rate) / (1.0 - rate)


def forward(layers: list[np.ndarray], x: np.ndarray, masks=None) -> list[np.ndarray]:
    """The inputs of every layer, then the logits."""
    seen = [x]
    for at, w in enumerate(layers):
        z = seen[-1] @ w[:-1] + w[-1]
        if at < len(layers) - 1:
            z = np.maximum(z, 0.0)
            z = z * masks[at] if masks else z
        seen.append(z)
    return seen


def gradient(layers, x, y, w, masks=None) -> tuple[list[np.ndarray], float]:
    """Summed gradient per layer and summed loss of weighted binary cross-entropy."""
    seen = forward(layers, x, masks)
    p = _sigmoid(seen[-1])
    q = np.clip(p, 1e-12, 1 - 1e-12)
    loss = float(-(w * (y * np.log(q) + (1 - y) * np.log(1 - q))).sum())
    slope, out = (p - y) * w, [None] * len(layers)
    for at in range(len(layers) - 1, -1, -1):
        out[at] = np.concatenate([seen[at].T @ slope, slope.sum(0, keepdims=True)])
        if at:
            # A unit that relu or dropout has set to 0 passes nothing back.
            slope = (slope @ layers[at][:-1].T) * (seen[at] > 0)
            slope = slope * masks[at - 1] if masks else slope
    return out, loss


def train_network(vectors: DataFrame, labels: DataFrame, classes=None, hidden=(128,), steps: int = 100, learning_rate: float = 0.01,
                  weight_decay: float = 0.0, dropout: float = 0.0, mode: str = "class", seed: int = 0, layers=None,
                  id_col: str = ID, vec: str = "embedding") -> Network:
    """Fit on the training rows by Adam steps, from seeded weights or from `layers`.

    Rows count with the weights that draws by `mode` would give them. With hidden=() it is a linear head. Training rows
    without any known class, or without a vector, have no effect; no known label at all is an error.
    """
    classes = class_columns(labels, classes, id_col)
    rows = training_cells(labels, {None: vectors}, classes, id_col, vec).withColumn("id", F.xxhash64(id_col)).persist()
    try:
        which = MODES.index(mode)
        weight = F.element_at("w", which + 1) * F.aggregate("known", F.lit(0.0), lambda a, k: a + k)
        dim, total = rows.agg(F.max(F.size("x_0")), F.sum(weight)).first()
        if not total:
            raise ValueError("no training row has a known label and a vector")
        layers = [np.array(w, float) for w in layers] if layers is not None else start_layers([dim, *hidden, len(classes)], seed)
        shapes, history = [w.shape for w in layers], []
        m, v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
        for step in range(1, steps + 1):
            def partial(batches, layers=layers, step=step):
                sums, loss = [np.zeros(s) for s in shapes], 0.0
                for batch in batches:
                    if batch.num_rows == 0:
                        continue
                    x, y, known, w = (B.matrix_of(batch.column(c)) for c in ("x_0", "y", "known", "w"))
                    ids = batch.column("id").to_numpy()
                    masks = [kept_units(ids, s[1], at, step, seed, dropout) for at, s in enumerate(shapes[:-1])] if dropout else None
                    grads, part = gradient(layers, x, y, known * w[:, which:which + 1], masks)
                    sums, loss = [a + g for a, g in zip(sums, grads)], loss + part
                flat = np.concatenate([g.ravel() for g in sums] + [[loss]])
                for i, at in enumerate(range(0, len(flat), CHUNK)):
                    yield B.to_batch({"i": np.array([i], np.int32), "g": B.list_array(flat[None, at:at + CHUNK])}, _PARTIAL)

            chunks = {r["i"]: r["g"] for r in sum_vectors(rows.select("id", "x_0", "y", "known", "w").mapInArrow(partial, _PARTIAL), "i", "g").collect()}
            flat = np.concatenate([np.array(chunks[i]) for i in sorted(chunks)]) / total
            history.append(float(flat[-1]))
            at = 0
            for n, shape in enumerate(shapes):
                g = flat[at:at + shape[0] * shape[1]].reshape(shape).copy()
                at += shape[0] * shape[1]
                g[:-1] += weight_decay * layers[n][:-1]
                m[n], v[n] = 0.9 * m[n] + 0.1 * g, 0.999 * v[n] + 0.001 * g ** 2
                layers[n] = layers[n] - learning_rate * (m[n] / (1 - 0.9 ** step)) / (np.sqrt(v[n] / (1 - 0.999 ** step)) + 1e-8)
    finally:
        rows.unpersist()
    return Network(list(classes), layers, history)
