"""Clustering of embeddings: k-means on whitened components, epochs of it, self-organising maps."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.vectors import as_double, l2_normalize, sum_vectors
from tagweave.operators import blocks as B
from tagweave.operators.features import PcaModel, fit_pca, to_ml_vector
from tagweave.operators.metrics import cluster_sizes, nmi
from tagweave.operators.sample import cluster_stratified
from tagweave.schema import ID


@dataclass
class ClusterModel:
    """Fitted transforms and k centres; assigns any vectors, held-out ones included."""

    pca: PcaModel
    centres: np.ndarray

    def assign(self, df: DataFrame, id_col: str = ID, vec: str = "embedding") -> DataFrame:
        reduced = self.pca.transform(df.select(id_col, vec), vec, whiten=True).withColumn(vec, l2_normalize(vec))
        return nearest_unit(reduced, self.centres, id_col, vec)


def nearest_unit(df: DataFrame, centres: np.ndarray, id_col: str = ID, vec: str = "embedding",
                 out: str = "cluster") -> DataFrame:
    """Index of the closest of a few centres per row (squared distance, ties to the smaller index)."""
    centres = np.asarray(centres, float)
    id_field = df.schema[id_col]
    schema = T.StructType([id_field, T.StructField(out, T.IntegerType())])

    def kernel(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = B.matrix_of(batch.column("_v"))
            d = (centres * centres).sum(1)[None, :] - 2.0 * (x @ centres.T)
            yield B.to_batch({id_col: batch.column(id_col), out: np.round(d, 12).argmin(1).astype(np.int32)}, schema)

    return df.select(id_col, as_double(vec).alias("_v")).mapInArrow(kernel, schema)


def deepcluster_fit(df: DataFrame, pca_dim: int = 256, k: int = 100, restarts: int = 3, max_iter: int = 100, seed: int = 0,
                    id_col: str = ID, vec: str = "embedding") -> ClusterModel:
    """Standardise, whitened PCA, unit rows, k-means with restarts; empty clusters restart next to an occupied centre."""
    pca = fit_pca(df, pca_dim, vec)
    reduced = pca.transform(df.select(id_col, vec), vec, whiten=True).withColumn(vec, l2_normalize(vec))
    points = to_ml_vector(reduced, vec).select(id_col, vec, "features").persist()
    try:
        fits = [KMeans(k=k, seed=seed + r, maxIter=max_iter, initMode="k-means||", predictionCol="cluster").fit(points)
                for r in range(restarts)]
        best = min(fits, key=lambda m: m.summary.trainingCost)
        found = np.asarray(best.clusterCenters())
        # MLlib returns fewer centres when the data has fewer distinct points than k.
        centres = np.zeros((k, found.shape[1]))
        centres[:len(found)] = found
        used = {r["cluster"] for r in nearest_unit(points, found, id_col, vec).select("cluster").distinct().collect()}
        rng = np.random.default_rng(seed)
        for i in range(k):
            if i not in used:
                centres[i] = centres[rng.choice(sorted(used))] + rng.normal(0, 0.1, centres.shape[1])
    finally:
        points.unpersist()
    return ClusterModel(pca, centres)


def deepcluster_assign(df: DataFrame, pca_dim: int = 256, k: int = 100, restarts: int = 3, seed: int = 0,
                       held_out: DataFrame | None = None, id_col: str = ID, vec: str = "embedding"):
    """(assignment, centres, assignment of the held-out vectors or None)."""
    model = deepcluster_fit(df, pca_dim, k, restarts, seed=seed, id_col=id_col, vec=vec)
    test = None if held_out is None else model.assign(held_out, id_col, vec)
    return model.assign(df, id_col, vec), model.centres, test


def cluster_epochs(snapshots, pca_dim: int = 256, k: int = 100, mult: int = 1, restarts: int = 1, seed: int = 0,
                   id_col: str = ID, vec: str = "embedding"):
    """For each embedding snapshot: assignment, sizes, NMI with the previous epoch and a stratified feed."""
    previous, out = None, []
    for epoch, snapshot in enumerate(snapshots):
        assigned, _, _ = deepcluster_assign(snapshot, pca_dim, k, restarts, seed + epoch, None, id_col, vec)
        change = None
        if previous is not None:
            both = assigned.join(previous.withColumnRenamed("cluster", "before"), id_col)
            change = nmi(both, "cluster", "before")
        out.append({"epoch": epoch, "assignment": assigned, "sizes": cluster_sizes(assigned, k), "nmi": change,
                    "feed": cluster_stratified(assigned, mult, "cluster", id_col, f"{seed}:{epoch}")})
        previous = assigned
    return out


def som_assign(df: DataFrame, grid: np.ndarray, id_col: str = ID, vec: str = "embedding") -> DataFrame:
    """Best unit (gi, gj) of an m × n × d grid per row; ties go to the first unit in row order."""
    m, n, d = grid.shape
    flat = nearest_unit(df, grid.reshape(m * n, d), id_col, vec, "unit")
    return flat.select(id_col, F.floor(F.col("unit") / n).cast("int").alias("gi"), F.pmod("unit", F.lit(n)).cast("int").alias("gj"))


_SUMS = T.StructType([T.StructField("unit", T.IntegerType()), T.StructField("s", T.ArrayType(T.DoubleType()))])


WINDOW = range(-3, 3)   # fixed value: rows and columns of the map, counted from the best unit, that an update reaches


def som_train(df: DataFrame, grid: np.ndarray, learn_rate: float = 0.1, radius_sq: float = 1.0, lr_decay: float = 0.1,
              radius_decay: float = 0.1, epochs: int = 10, vec: str = "embedding") -> np.ndarray:
    """Batch self-organising map: an epoch adds all rows up per best unit in the tasks, then moves the whole grid at once.

    A unit whose window of best units holds c_k rows at neighbourhood weight h_k moves to their weighted mean by the share
    1 - prod (1 - rate * h_k) ** c_k, which is what single updates towards one point would do.
    """
    units = np.array(grid, float)
    shape = units.shape
    rows = df.select(as_double(vec).alias("_v")).persist()
    try:
        for epoch in range(epochs):
            faded = max(epoch - 1, 0)
            sums, counts = _som_sums(rows, units.reshape(-1, shape[2]))
            units = _moved(units, sums.reshape(shape), counts.reshape(shape[:2]), learn_rate * np.exp(-faded * lr_decay),
                           radius_sq * np.exp(-faded * radius_decay))
    finally:
        rows.unpersist()
    return units


def _moved(units: np.ndarray, sums: np.ndarray, counts: np.ndarray, rate: float, radius: float) -> np.ndarray:
    """The grid after one epoch. Every offset of the window is one operation on the whole grid."""
    stays, pull, weight = np.zeros(counts.shape), np.zeros(units.shape), np.zeros(counts.shape)
    for down in WINDOW:
        for across in WINDOW:
            apart = down * down + across * across
            h = 1.0 if apart == 0 else (np.exp(-apart / (2.0 * radius)) if radius > 0 else 0.0)
            to, of = _overlap(counts.shape, down, across)
            here = counts[of]
            pull[to] += h * sums[of]
            weight[to] += h * here
            with np.errstate(divide="ignore", invalid="ignore"):
                stays[to] += np.where(here > 0, here * np.log1p(-min(rate * h, 1.0)), 0.0)
    share = -np.expm1(stays)[..., None]
    mean = pull / np.where(weight > 0, weight, 1.0)[..., None]
    return np.where(weight[..., None] > 0, units + share * (mean - units), units)


def _overlap(shape, down: int, across: int):
    """Slices (units, best units) of all places that lie `down` rows and `across` columns after a best unit."""
    to, of = [], []
    for length, step in zip(shape, (down, across)):
        to.append(slice(max(0, step), length + min(0, step)))
        of.append(slice(max(0, -step), length + min(0, -step)))
    return tuple(to), tuple(of)


def _som_sums(rows: DataFrame, units: np.ndarray):
    k, d = units.shape

    def partial(batches):
        acc = np.zeros((k, d + 1))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = B.matrix_of(batch.column("_v"))
            best = np.round((units * units).sum(1)[None, :] - 2.0 * (x @ units.T), 12).argmin(1)
            one = np.zeros((len(best), k))
            one[np.arange(len(best)), best] = 1.0
            acc[:, :d] += one.T @ x
            acc[:, d] += one.sum(0)
        yield B.to_batch({"unit": np.arange(k, dtype=np.int32), "s": B.list_array(acc)}, _SUMS)

    out = np.zeros((k, d + 1))
    for r in sum_vectors(rows.mapInArrow(partial, _SUMS), "unit", "s").collect():
        out[r["unit"]] = r["s"]
    return out[:, :d], out[:, d]


def init_grid(df: DataFrame, m: int, n: int, seed=0, id_col: str = ID, vec: str = "embedding") -> np.ndarray:
    """Grid of m·n rows drawn from the data."""
    from tagweave.functions.hashing import hash_uniform

    rows = df.orderBy(hash_uniform(f"{seed}:grid", id_col), id_col).limit(m * n).select(id_col, vec)
    _, points = B.collect_vectors(rows, id_col, vec)
    return np.resize(points, (m * n, points.shape[1])).reshape(m, n, -1)
