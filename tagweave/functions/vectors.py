"""Vector functions on ARRAY<DOUBLE|FLOAT> columns.

The array forms run inside the JVM and suit per-row work. Work on pairs of rows uses the blocked
kernels of `operators.blocks`.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(vec) -> Column:
    return _c(vec).cast("array<double>")


def literal_vector(values) -> Column:
    """A constant ARRAY<DOUBLE>, built by one expression instead of a call per number."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def lookup(values, index: Column) -> Column:
    """The integer at a 0-based position of a small constant table."""
    return F.element_at(F.expr("array(" + ", ".join(str(int(v)) for v in values) + ")"), index + 1)


def array_sum(vec) -> Column:
    return F.aggregate(_c(vec), F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return array_sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def squared_norm(a) -> Column:
    return F.aggregate(as_double(a), F.lit(0.0), lambda acc, x: acc + x * x)


def norm(a) -> Column:
    return F.sqrt(squared_norm(a))


def sq_euclid(a, b) -> Column:
    return array_sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def cosine_distance(a, b) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def bind(value: Column, body) -> Column:
    """Evaluate `value` once per row and hand it to `body` (a let-expression)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_normalize(vec) -> Column:
    """Row divided by its norm; a zero row stays zero."""
    pair = F.struct(as_double(vec).alias("v"), norm(vec).alias("n"))
    return bind(pair, lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(x)))


def vector_moments(df: DataFrame, vec: str, by=()) -> DataFrame:
    """Per group: n, mean, population variance, per dimension. Partial aggregates are combined
    map-side, so a group of any size stays spread over the tasks."""
    stats = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(as_double(vec)))
    out = df.groupBy(*by).agg(stats.alias("_s"))
    n = F.col("_s.count").cast("double")
    shrink = F.when(n > 1, (n - 1) / n).otherwise(F.lit(0.0))
    return (out.withColumn("n", F.col("_s.count")).withColumn("_shrink", shrink)
               .withColumn("mean", vector_to_array("_s.mean"))
               .withColumn("var", F.transform(vector_to_array("_s.variance"), lambda v: v * F.col("_shrink")))
               .drop("_s", "_shrink"))


def sum_vectors(partials: DataFrame, key: str, vec: str) -> DataFrame:
    """Element-wise sum of the vectors of each key, combined map-side."""
    total = Summarizer.metrics("sum").summary(array_to_vector(F.col(vec)))
    return partials.groupBy(key).agg(total.alias("_t")).select(key, vector_to_array("_t.sum").alias(vec))
