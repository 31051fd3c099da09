"""Inference of a cosine output layer."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions.scoring import sigmoid
from tagweave.functions.vectors import dot, literal_vector
from tagweave.schema import ID


def cosine_score(df: DataFrame, kernel, class_vectors, classes, id_col: str = ID, vec: str = "embedding") -> DataFrame:
    """Per class: project to two dimensions, normalise, dot with the normalised class vector, sigmoid.

    kernel is d × 2C, class_vectors C × 2.
    """
    kernel, class_vectors = np.asarray(kernel, float), np.asarray(class_vectors, float)
    unit = class_vectors / np.linalg.norm(class_vectors, axis=1, keepdims=True)

    def weights(column):
        return literal_vector(kernel[:, column])

    projected = df.select(id_col, *[dot(vec, weights(j)).alias(f"_p{j}") for j in range(2 * len(classes))])
    cols = []
    for i, c in enumerate(classes):
        a, b = F.col(f"_p{2 * i}"), F.col(f"_p{2 * i + 1}")
        cols.append(sigmoid((a * float(unit[i, 0]) + b * float(unit[i, 1])) / F.sqrt(a * a + b * b)).alias(c))
    return projected.select(id_col, *cols)
