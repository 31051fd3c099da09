import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tagweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", 4, spark__ui__enabled="false", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Fixed input, so that filters can be compared by eye: a has no label, b and c have both, d and e have one."""
    rows = [(0, "a.jpg", True, False, "0", None, None), (1, "b.jpg", False, False, "0", 1.0, 0.0),
            (2, "c.jpg", False, False, "1", 0.0, 1.0), (3, "d.jpg", False, False, "1", 1.0, None),
            (4, "e.jpg", False, False, "1", 1.0, None)]
    return spark.createDataFrame(rows, "item_id long, filepath string, exclude boolean, validation boolean, subset string, "
                                       "class1 double, class2 double")


@pytest.fixture(scope="session")
def half(spark):
    """100 rows, the first 50 have foo=1, bar is unknown; scores foo = id/99, bar = 1."""
    from pyspark.sql import functions as F

    labels = spark.range(100).select(F.col("id").alias("item_id"), F.lit("").alias("filepath"), F.lit(False).alias("exclude"),
                                     F.lit(False).alias("validation"), F.when(F.col("id") < 50, 1.0).alias("foo"),
                                     F.lit(None).cast("double").alias("bar"))
    preds = spark.range(100).select(F.col("id").alias("item_id"), (F.col("id") / 99.0).alias("foo"), F.lit(1.0).alias("bar"))
    return labels, preds


@pytest.fixture(scope="session")
def cloud(spark):
    """200 seeded vectors of 8 numbers as (numpy matrix, DataFrame)."""
    import numpy as np

    x = np.random.default_rng(5).normal(size=(200, 8))
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "item_id long, embedding array<double>")
