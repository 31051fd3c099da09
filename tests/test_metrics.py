import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.operators import metrics as M


def table(spark, y, p):
    labels = spark.createDataFrame([(i, None if v == -1 else float(v), True) for i, v in enumerate(y)], "item_id long, a double, validation boolean")
    return labels, spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "item_id long, a double")


def test_masked_losses(spark):
    t = table(spark, [-1, -1, 0, 1], [1, 0, 0, 1])
    assert M.masked_bce(*t, ["a"]).first()["loss"] < 1e-5
    t = table(spark, [-1, -1, 0, 1], [1, 0, 0.25, 0.75])
    bce, flat, focal = (f.first()["loss"] for f in (M.masked_bce(*t, ["a"]), M.masked_focal(*t, ["a"], 0), M.masked_focal(*t, ["a"], 2)))
    assert abs(bce - flat) < 1e-5 and focal < bce
    assert M.masked_mae(*table(spark, [-1, -1, 0, 1], [1, 0, 0.5, 0.5]), ["a"]).first()["loss"] == 0.5


def test_sparse_and_distillation(spark):
    df = spark.createDataFrame([(0, [0.9, 0.1]), (-1, [0.5, 0.5]), (None, [0.5, 0.5]), (1, [0.4, 0.6])], "y int, p array<double>")
    r = M.masked_sparse_ce(df, "y", "p").first()
    assert r["n_known"] == 2 and abs(r["loss"] + (math.log(0.9) + math.log(0.6)) / 2) < 1e-9
    teacher, student = (spark.createDataFrame([(0, v)], "item_id long, a double") for v in (0.5, 0.2))
    good = M.distillation_loss(teacher, teacher, ["a"]).first()[0]
    assert M.distillation_loss(teacher, student, ["a"]).first()[0] > good


@pytest.mark.parametrize("ties", [False, True])
def test_auc_exact(spark, ties):
    rng = np.random.default_rng(0)
    y, p = rng.integers(0, 2, 400), rng.random(400)
    p = np.round(p, 1) if ties else p
    wins = (p[y == 1][:, None] > p[y == 0][None]).mean() + 0.5 * (p[y == 1][:, None] == p[y == 0][None]).mean()
    r = M.auc(*table(spark, y, p), ["a"]).first()
    assert abs(r["auc"] - wins) < 1e-12 and abs(r["accuracy"] - ((p >= 0.5) == y).mean()) < 1e-12


def test_auc_one_sided_is_zero(spark):
    r = M.auc(*table(spark, [1, 1, -1], [0.1, 0.9, 0.2]), ["a"]).first()
    assert (r["auc"], r["accuracy"]) == (0.0, 0.0)
    labels, preds = table(spark, [1, 0], [0.9, 0.1])
    none = M.auc(labels.withColumn("validation", F.lit(False)), preds, ["a"])
    assert none.first()["auc"] == 0.0


def test_confusion_skips_one_sided_classes(spark):
    labels, preds = table(spark, [1, 1, -1], [0.1, 0.9, 0.2])
    assert M.confusion_counts(labels, preds, 0.5, ["a"]).count() == 0


def beta_cdf_by_sum(x, a, b, n=200000):
    t = (np.arange(n) + 0.5) / n * x
    return float(np.sum(np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a - 1) * np.log(t) + (b - 1) * np.log1p(-t))) * x / n)


def test_accuracy_estimate(spark):
    counts = spark.createDataFrame([("a", 5, 5, 1, 1)], "class string, tp long, tn long, fp long, fn long")
    text = M.accuracy_estimate(counts, as_text=True).first()
    assert text["base_rate"] == "0.500" and text["accuracy"].startswith("0.682 (")
    r = M.accuracy_estimate(counts).first()
    assert abs(beta_cdf_by_sum(r["interval_low"], 15, 7) - 0.05) < 1e-5
    assert abs(beta_cdf_by_sum(r["interval_high"], 15, 7) - 0.95) < 1e-5
    assert abs(1 - beta_cdf_by_sum(0.5, 15, 7) - r["prob_above_base_rate"]) < 1e-5


def test_nmi(spark):
    df = spark.createDataFrame([(i % 3, (i % 3) * 7, i % 2, 0) for i in range(60)], "a int, b int, c int, d int")
    assert abs(M.nmi(df, "a", "b").first()[0] - 1) < 1e-9
    assert M.nmi(df, "a", "c").first()[0] < 1e-9
    assert M.nmi(df, "d", "d").first()[0] == 1.0


def test_histogram_last_bin_closed(spark):
    labels, preds = table(spark, [1, 1, 0, -1], [1.0, 0.99, 0.0, 0.5])
    rows = {(r["group"], r["bin"]): r for r in M.score_histogram(labels, preds, ["a"]).collect()}
    assert rows[("validation_positive", 13)]["n"] == 2 and rows[("validation_positive", 13)]["density"] == 14.0
    assert rows[("unlabeled", 7)]["n"] == 1


def test_fixmatch_and_worst(spark):
    weak = spark.createDataFrame([(0, 0.99), (1, 0.6), (2, 0.01)], "item_id long, a double")
    strong = spark.createDataFrame([(0, 0.8), (1, 0.2), (2, 0.3)], "item_id long, a double")
    r = M.fixmatch_stats(weak, strong, ["a"], 0.95).first()
    assert abs(r["mask_fraction"] - 2 / 3) < 1e-12 and abs(r["agreement"] - 2 / 3) < 1e-12
    assert abs(r["loss"] + (math.log(0.8) + math.log(0.7)) / 3) < 1e-6
    w = M.worst_cases(*table(spark, [0, 0, 1, 1], [0.2, 0.9, 0.4, 0.8]), ["a"]).first()
    assert (w["worst_negative"], w["worst_positive"]) == (1, 2)


def test_cluster_sizes_include_empty(spark):
    a = spark.createDataFrame([(0,), (2,), (2,)], "cluster int")
    assert sorted(map(tuple, M.cluster_sizes(a, 4).collect())) == [(0, 1), (1, 0), (2, 2), (3, 0)]


def exact_tail(x, a, b):
    """P(share <= x) for whole parameters in 60 digits, by the terms of the binomial sum around its largest one."""
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    x, n = Decimal(x), a + b - 1
    odds = x / (1 - x)
    # Ratios of neighbouring terms need no factorials; the whole sum normalises them.
    middle = int(n * x)
    up, term, total_up, j = [], Decimal(1), Decimal(0), middle
    above, below = Decimal(0), Decimal(0)
    while term > Decimal(10) ** -30:
        above, below = (above + term, below) if j >= a else (above, below + term)
        term, j = term * (n - j) / (j + 1) * odds, j + 1
    term, j = Decimal(1), middle
    while term > Decimal(10) ** -30 and j > 0:
        term, j = term * j / (n - j + 1) / odds, j - 1
        above, below = (above + term, below) if j >= a else (above, below + term)
    return float(above / (above + below))


def test_beta_for_large_counts():
    """Against sums in 60 digits where they have few enough terms, and the median and symmetry beyond."""
    from tagweave.functions.beta import beta_cdf, beta_quantile

    for a, b in ((15, 7), (500_003, 500_001), (900_000, 100_000), (2_000_000, 3_000_000), (1_000_000_000, 1_000)):
        mean = a / (a + b)
        for z in (-2.5, -0.7, 0.0, 1.3):
            x = mean + z * math.sqrt(mean * (1 - mean) / (a + b))
            if 0 < x < 1:
                assert abs(beta_cdf(x, a, b) - exact_tail(x, a, b)) < (2e-8 if b < 1e5 < a else 1e-9)
    for n in (1e6, 1e9, 1e11, 1e12):
        assert abs(beta_cdf(0.5, n / 2, n / 2) - 0.5) < 1e-9
        for q in (0.05, 0.95):
            x = beta_quantile(q, 0.7 * n, 0.3 * n)
            assert abs(beta_cdf(x, 0.7 * n, 0.3 * n) - q) < 1e-9
            # The normal law is the limit; its first correction is of order 1 / sqrt(n).
            z = (x - 0.7) / math.sqrt(0.21 / n)
            assert abs(abs(z) - 1.6448536269514722) < 3 / math.sqrt(n) + 1e-6
