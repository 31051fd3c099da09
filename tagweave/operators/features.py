"""Feature vectors: pooling, scaling, projection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.vectors import as_double, l2_normalize, literal_vector, vector_moments



def pool(cells, how: str) -> Column:
    """ARRAY<ARRAY<…>> (cells × channels) to one vector: `max`, `average` or `flatten`."""
    cells = (F.col(cells) if isinstance(cells, str) else cells).cast("array<array<double>>")
    if how == "flatten":
        return F.flatten(cells)
    if how not in ("max", "average"):
        raise ValueError(f"how must be max, average or flatten, not {how!r}")
    rest, first = F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), F.element_at(cells, 1)
    if how == "max":
        return F.aggregate(rest, first, lambda acc, c: F.zip_with(acc, c, lambda x, y: F.greatest(x, y)))
    total = F.aggregate(rest, first, lambda acc, c: F.zip_with(acc, c, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(cells))


def pool_layers(layers, how: str) -> Column:
    """Pool several layers and concatenate them."""
    return F.concat(*[pool(c, how) for c in layers])


def reshape_cells(vec, channels: int) -> Column:
    """Cut a flat vector into cells of `channels` numbers."""
    vec = as_double(vec)
    starts = F.sequence(F.lit(0), (F.size(vec) / channels).cast("int") - 1)
    return F.transform(starts, lambda i: F.slice(vec, i * channels + 1, channels))


def fit_scaler(df: DataFrame, vec: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """Mean and population standard deviation per dimension (1 where constant): 2·d numbers from one aggregate."""
    stats = vector_moments(df, vec).first()
    scale = np.sqrt(np.asarray(stats["var"]))
    scale[scale == 0] = 1.0
    return np.asarray(stats["mean"]), scale


def apply_scaler(df: DataFrame, scaler, vec: str = "embedding") -> DataFrame:
    mean, scale = scaler
    centred = F.zip_with(as_double(vec), literal_vector(mean), lambda x, m: x - m)
    return df.withColumn(vec, F.zip_with(centred, literal_vector(scale), lambda x, s: x / s))


def standardize(df: DataFrame, fit_on: DataFrame, vec: str = "embedding") -> DataFrame:
    """Zero mean and unit population variance per dimension, fitted on `fit_on`; a constant dimension is only centred."""
    return apply_scaler(df, fit_scaler(fit_on, vec), vec)


def multiply(df: DataFrame, matrix: np.ndarray, vec: str = "embedding", out: str | None = None) -> DataFrame:
    """Row vectors times a small d × d' matrix, one matrix product per Arrow batch."""
    out = out or vec
    others = [c for c in df.columns if c not in (vec, out)]
    matrix = np.ascontiguousarray(matrix, dtype=np.float64)

    def kernel(batches):
        for batch in batches:
            column = batch.column("_v")
            flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), matrix.shape[0])
            prod = flat @ matrix
            offsets = pa.array(np.arange(len(column) + 1, dtype=np.int32) * matrix.shape[1])
            arrays = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays(arrays + [pa.ListArray.from_arrays(offsets, pa.array(prod.ravel()))],
                                             names=others + [out])

    source = df.select(*others, as_double(vec).alias("_v"))
    schema = df.select(*others, as_double(vec).alias(out)).schema
    return source.mapInArrow(kernel, schema)


def random_projection(df: DataFrame, d_out: int, seed: int = 0, vec: str = "embedding") -> DataFrame:
    """Normalise, then multiply by a seeded Gaussian matrix."""
    dim = len(df.select(vec).first()[0])
    matrix = np.random.default_rng(seed).normal(size=(dim, d_out))
    return multiply(df.withColumn(vec, l2_normalize(vec)), matrix, vec)


class PcaModel:
    """Mean, scale and components of a fitted projection (d and d × k numbers)."""

    def __init__(self, mean, scale, components, spread):
        self.mean, self.scale, self.components, self.spread = mean, scale, components, spread

    def transform(self, df: DataFrame, vec: str = "embedding", whiten: bool = False) -> DataFrame:
        centred = F.zip_with(as_double(vec), literal_vector(self.mean), lambda x, m: x - m)
        scaled = df.withColumn(vec, F.zip_with(centred, literal_vector(self.scale), lambda x, s: x / s))
        matrix = self.components / self.spread if whiten else self.components
        return multiply(scaled, matrix, vec)


def fit_pca(df: DataFrame, k: int, vec: str = "embedding") -> PcaModel:
    """Standardise, then principal components. The fit aggregates a d × d covariance; k is capped to d and n."""
    stats = vector_moments(df, vec).first()
    n, dim = stats["n"], len(stats["mean"])
    scale = np.sqrt(np.asarray(stats["var"]))
    scale[scale == 0] = 1.0
    k = max(1, min(k, dim, n))
    data = df.select(array_to_vector(as_double(vec)).alias("raw"))
    sample_scaler = StandardScaler(withMean=True, withStd=True, inputCol="raw", outputCol="x").fit(data)
    fitted = PCA(k=k, inputCol="x", outputCol="y").fit(sample_scaler.transform(data))
    components = np.asarray(fitted.pc.toArray())
    # The eigenvalues belong to data with unit sample variance; explained shares carry over to the total d·n/(n-1).
    total = float(np.sum(np.asarray(stats["var"]) > 0)) * (n / max(n - 1, 1))
    spread = np.sqrt(np.maximum(np.asarray(fitted.explainedVariance.toArray()) * total, 1e-12))
    return PcaModel(np.asarray(stats["mean"]), scale, components, spread)


def pca_project(df: DataFrame, k: int, whiten: bool = False, vec: str = "embedding") -> DataFrame:
    return fit_pca(df, k, vec).transform(df, vec, whiten)


def to_ml_vector(df: DataFrame, vec: str = "embedding", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(as_double(vec)))


def from_ml_vector(col: str) -> Column:
    return vector_to_array(F.col(col))


