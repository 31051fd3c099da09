"""Many fits in one scan: the linear heads of all trials as one parameter matrix.

A trial is a row of a table with its settings: weight decay `lam`, `learning_rate`, its schedule `lr_decay`, `optimizer` and `sampling`
(the draws of `sample.with_param_draws`), and optionally the vectors it reads (`extractor`) and rows of its own. Every pass
over the rows gives the loss and gradient of all trials, so the number of Spark jobs follows from the steps and not from the
number of trials. A task adds its rows up to one vector per trial; these are summed by a shuffle, and what reaches the driver is
trials * classes * (d + 1) numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.vectors import as_double, sum_vectors
from tagweave.operators import blocks as B
from tagweave.operators.filters import training_rows
from tagweave.operators.sample import strata_sizes, stratum_shares
from tagweave.schema import ID, class_columns

# The settings a trial can have and what holds where its table lacks one.
DEFAULTS = {"lam": 0.0, "learning_rate": 0.3, "lr_decay": "none", "optimizer": "adam", "sampling": "class", "extractor": None}
MODES = ("class", "instance", "squareroot")
OPTIMIZERS = ("adam", "momentum", "lbfgs")
_PARTIAL = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("g", T.ArrayType(T.DoubleType()))])
_SCORES = T.StructType([T.StructField("trial", T.LongType()), T.StructField("class", T.StringType()), T.StructField("y", T.DoubleType()),
                        T.StructField("p", T.DoubleType())])


@dataclass
class Fits:
    """Heads of every trial: weights[t] is d × C, bias[t] is C, and history holds (trial, step, loss)."""

    trials: list[dict]
    classes: list[str]
    weights: list[np.ndarray]
    bias: list[np.ndarray]
    history: list[tuple[int, int, float]]

    def table(self, spark) -> DataFrame:
        """(trial, class, weights, bias)."""
        rows = [(int(t["trial"]), c, w[:, i].tolist(), float(b[i])) for t, w, b in zip(self.trials, self.weights, self.bias)
                for i, c in enumerate(self.classes)]
        return spark.createDataFrame(rows, "trial long, class string, weights array<double>, bias double")

    def log(self, spark, run_id: str) -> DataFrame:
        """(run_id, step, name, value) for `store.log_metrics`: the loss of each trial before every step."""
        rows = [(run_id, s, f"trial_{t}_loss", float(v)) for t, s, v in self.history]
        return spark.createDataFrame(rows, "run_id string, step long, name string, value double")


def read_trials(trials: DataFrame) -> list[dict]:
    """The rows of a trial table, which is small by nature, with defaults for missing settings."""
    found = []
    for r in trials.orderBy("trial").collect():
        t = {"trial": r["trial"], **{k: (r[k] if k in trials.columns and r[k] is not None else v) for k, v in DEFAULTS.items()}}
        if t["optimizer"] not in OPTIMIZERS or t["sampling"] not in MODES or t["lr_decay"] not in ("none", "cosine"):
            raise ValueError(f"unknown setting in trial {t}")
        found.append(t)
    return found


def mode_weights(labels: DataFrame, classes, id_col: str = ID) -> list[Column]:
    """Per sampling mode the expected draw weight of a row, scaled to mean about 1. One scan gives all the counts."""
    sizes = strata_sizes(labels, classes, id_col)
    total = sum(n for *_, n in sizes)
    out = []
    for mode in MODES:
        parts = [F.when(F.col(c) == v, F.lit(p / n * total)).otherwise(0.0) for (c, v, n), p in zip(sizes, stratum_shares(sizes, mode))]
        out.append(sum(parts, F.lit(0.0)))
    return out


def training_cells(labels: DataFrame, vectors: dict[str | None, DataFrame], classes, id_col: str = ID, vec: str = "embedding") -> DataFrame:
    """One row per training row: x_<n> (the vector of extractor n), y per class, the weight per mode, `known` 0/1 per class."""
    rows = training_rows(labels).select(id_col, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in classes]).alias("y"),
                                        F.array(*[F.col(c).isin(0, 1).cast("double") for c in classes]).alias("known"),
                                        F.array(*mode_weights(labels, classes, id_col)).alias("w"))
    rows = rows.withColumn("known", F.transform("known", lambda k: F.coalesce(k, F.lit(0.0))))
    for n, table in enumerate(vectors.values()):
        rows = rows.join(table.select(id_col, as_double(vec).alias(f"x_{n}")), id_col)
    return rows


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


class Kernel:
    """Loss and gradient of all trials on a batch. Trials of one extractor share a matrix product."""

    def __init__(self, trials: list[dict], extractors: list, n_classes: int):
        self.of = [[i for i, t in enumerate(trials) if t["extractor"] == e or (t["extractor"] is None and n == 0)] for n, e in enumerate(extractors)]
        self.mode = np.array([MODES.index(t["sampling"]) for t in trials])
        self.n_classes = n_classes

    def cells(self, batch, members: list[int]):
        """Targets and weights (rows × trials × classes). `part` holds per trial 0 (row not used), 1 or -1 (used, labels flipped)."""
        y, known, w = (B.matrix_of(batch.column(c)) for c in ("y", "known", "w"))
        weight = w[:, self.mode[members], None] * known[:, None, :]
        target = np.broadcast_to(y[:, None, :], weight.shape)
        if "part" in batch.schema.names:
            part = B.matrix_of(batch.column("part"))[:, members, None]
            weight, target = weight * np.abs(part), np.where(part < 0, 1 - target, target)
        return target, weight

    def add(self, batch, theta: list[np.ndarray], sums: dict[int, np.ndarray]) -> None:
        """Add (gradient by d + 1 lines, loss, weight) per trial to `sums`."""
        for n, members in enumerate(self.of):
            if not members:
                continue
            x = B.matrix_of(batch.column(f"x_{n}"))
            y, w = self.cells(batch, members)
            stacked = np.concatenate([theta[i] for i in members], axis=1)
            p = _sigmoid(x @ stacked[:-1] + stacked[-1]).reshape(y.shape)
            q = np.clip(p, 1e-12, 1 - 1e-12)
            slope = ((p - y) * w).reshape(len(x), -1)
            grad = (x.T @ slope).reshape(x.shape[1], len(members), -1)
            bias = slope.sum(0).reshape(len(members), -1)
            loss, total = -(w * (y * np.log(q) + (1 - y) * np.log(1 - q))).sum((0, 2)), w.sum((0, 2))
            for at, i in enumerate(members):
                new = np.concatenate([grad[:, at].ravel(), bias[at], [loss[at], total[at]]])
                sums[i] = sums[i] + new if i in sums else new


class Descent:
    """Steps of one trial. `point` is where the next pass evaluates loss and gradient; `feed` takes them in."""

    def __init__(self, settings: dict, shape: tuple[int, int], steps: int):
        self.s, self.steps, self.step = settings, steps, 0
        self.point = np.zeros(shape)
        self.m, self.v = np.zeros(shape), np.zeros(shape)
        self.best, self.pairs, self.length, self.done = None, [], 1.0, False

    def penalty(self, theta):
        free = theta.copy()
        free[-1] = 0.0
        return 0.5 * self.s["lam"] * (free ** 2).sum(), self.s["lam"] * free

    def feed(self, loss: float, grad: np.ndarray) -> None:
        extra, slope = self.penalty(self.point)
        loss, grad = loss + extra, grad + slope
        if self.s["optimizer"] == "lbfgs":
            self._line_search(loss, grad)
            return
        rate = self.s["learning_rate"]
        if self.s["lr_decay"] == "cosine":
            rate *= 0.5 * (1 + math.cos(math.pi * self.step / self.steps))
        self.step += 1
        if self.s["optimizer"] == "momentum":
            self.m = 0.9 * self.m + grad
            self.point = self.point - rate * self.m
        else:
            self.m, self.v = 0.9 * self.m + 0.1 * grad, 0.999 * self.v + 0.001 * grad ** 2
            self.point = self.point - rate * (self.m / (1 - 0.9 ** self.step)) / (np.sqrt(self.v / (1 - 0.999 ** self.step)) + 1e-8)

    def _line_search(self, loss, grad) -> None:
        """Halve the step until the loss falls enough; then a new direction from the last ten differences."""
        self.step += 1
        if self.best is not None:
            x, f, g, d = self.best
            if not loss <= f + 1e-4 * self.length * (g * d).sum():
                self.length *= 0.5
                self.done = self.length < 1e-10
                self.point = x if self.done else x + self.length * d
                return
            s, y = self.point - x, grad - g
            if (s * y).sum() > 1e-12:
                self.pairs = [*self.pairs, (s, y)][-10:]
        self.done = np.abs(grad).max() < 1e-7
        if self.done:
            return
        d = -grad
        used = []
        for s, y in reversed(self.pairs):
            a = (s * d).sum() / (s * y).sum()
            used.append(a)
            d = d - a * y
        if self.pairs:
            s, y = self.pairs[-1]
            d = d * (s * y).sum() / (y * y).sum()
        for (s, y), a in zip(self.pairs, reversed(used)):
            d = d + s * (a - (y * d).sum() / (s * y).sum())
        if (grad * d).sum() >= 0:
            d, self.pairs = -grad, []
        self.length = 1.0 if self.pairs else min(1.0, 1.0 / np.abs(grad).sum())
        self.best = (self.point, loss, grad, d)
        self.point = self.point + self.length * d

    def result(self) -> np.ndarray:
        return self.best[0] if self.best is not None and not self.done else self.point


def fit_trials(cells: DataFrame, trials: list[dict], classes, steps: int, extractors=(None,), scalers=None) -> Fits:
    """Fit all trials on `cells` (see `training_cells`; with a column `part`, each on its own rows). One job per step.

    With `scalers`, a (mean, scale) per trial, a trial descends on its standardised vectors; the data stay as they are, as
    weights on standardised vectors are other weights on the given ones. The returned weights fit the given vectors.
    """
    def outer(i, theta):
        if scalers is None:
            return theta
        mean, scale = scalers[i]
        inner = theta[:-1] / scale[:, None]
        return np.concatenate([inner, theta[-1:] - mean @ inner])

    def inner_gradient(i, grad):
        if scalers is None:
            return grad
        mean, scale = scalers[i]
        return np.concatenate([(grad[:-1] - np.outer(mean, grad[-1])) / scale[:, None], grad[-1:]])

    rows = cells.persist()
    try:
        dims = rows.agg(*[F.max(F.size(f"x_{n}")).alias(f"d{n}") for n in range(len(extractors))]).first()
        kernel = Kernel(trials, list(extractors), len(classes))
        where = {i: n for n, members in enumerate(kernel.of) for i in members}
        if len(where) < len(trials):
            raise ValueError("a trial names an unknown extractor")
        if any(d is None for d in dims):
            raise ValueError("no training row has a vector")
        fits = [Descent(t, (dims[where[i]] + 1, len(classes)), steps) for i, t in enumerate(trials)]
        history = []
        for step in range(steps):
            theta = [outer(i, f.point) for i, f in enumerate(fits)]

            def partial(batches, theta=theta):
                sums: dict[int, np.ndarray] = {}
                for batch in batches:
                    if batch.num_rows:
                        kernel.add(batch, theta, sums)
                for i, g in sums.items():
                    yield B.to_batch({"i": np.array([i], np.int32), "g": B.list_array(g[None, :])}, _PARTIAL)

            for r in sum_vectors(rows.mapInArrow(partial, _PARTIAL), "i", "g").collect():
                i, g = r["i"], np.array(r["g"])
                if fits[i].done or g[-1] <= 0:
                    continue
                history.append((trials[i]["trial"], step, float(g[-2] / g[-1])))
                fits[i].feed(g[-2] / g[-1], inner_gradient(i, g[:-2].reshape(fits[i].point.shape) / g[-1]))
            if all(f.done for f in fits):
                break
    finally:
        rows.unpersist()
    final = [outer(i, f.result()) for i, f in enumerate(fits)]
    return Fits(trials, list(classes), [t[:-1] for t in final], [t[-1] for t in final], sorted(history))


def score_trials(fits: Fits, rows: DataFrame, n: int = 0, members=None) -> DataFrame:
    """(trial, class, y, p) for every known cell of `rows` (x_<n>, y, known) and every trial, in one pass."""
    members = list(range(len(fits.trials))) if members is None else members
    weights = np.concatenate([fits.weights[i] for i in members], axis=1)
    bias = np.concatenate([fits.bias[i] for i in members])
    names, n_cls = [fits.trials[i]["trial"] for i in members], len(fits.classes)

    def score(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, y, known = (B.matrix_of(batch.column(c)) for c in (f"x_{n}", "y", "known"))
            p = _sigmoid(x @ weights + bias)
            for at, name in enumerate(names):
                for c, cls in enumerate(fits.classes):
                    ok = known[:, c] > 0
                    yield B.to_batch({"trial": np.full(ok.sum(), name), "class": [cls] * int(ok.sum()), "y": y[ok, c], "p": p[ok, at * n_cls + c]}, _SCORES)

    return rows.mapInArrow(score, _SCORES)


def validation_cells(labels: DataFrame, vectors: DataFrame, classes, id_col: str = ID, vec: str = "embedding") -> DataFrame:
    from tagweave.operators.filters import validation_rows

    known = [F.coalesce(F.col(c).isin(0, 1).cast("double"), F.lit(0.0)) for c in classes]
    rows = validation_rows(labels).select(id_col, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in classes]).alias("y"),
                                          F.array(*known).alias("known"))
    return rows.join(vectors.select(id_col, as_double(vec).alias("x_0")), id_col)


def search(vectors: DataFrame, labels: DataFrame, trials: DataFrame, classes=None, steps: int = 20, id_col: str = ID,
           vec: str = "embedding") -> tuple[DataFrame, Fits]:
    """Fit every trial and report AUC and accuracy per class on the validation rows: (report by trial and class, fits)."""
    from tagweave.operators.metrics import auc_by_group

    classes = class_columns(labels, classes, id_col)
    fits = fit_trials(training_cells(labels, {None: vectors}, classes, id_col, vec), read_trials(trials), classes, steps)
    scores = score_trials(fits, validation_cells(labels, vectors, classes, id_col, vec))
    return auc_by_group(scores, ["trial", "class"]), fits
