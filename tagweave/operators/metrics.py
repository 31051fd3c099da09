"""Label counts, classifier metrics and masked losses. Losses are one map-side combined aggregate over the scan."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.functions.beta import beta_cdf, beta_quantile
from tagweave.functions.scoring import binary_crossentropy, label_smoothing, sigmoid
from tagweave.functions.vectors import array_sum, as_double
from tagweave.operators.filters import align, is_unlabeled
from tagweave.operators.ranking import running_total
from tagweave.schema import ID, class_columns, is_true

LOSS_EPS = 1e-7
BINS = 14


# ---- label accounting -------------------------------------------------------------------------------------------

def _counts_to_rows(one_row: DataFrame, entries, names) -> DataFrame:
    """Turn a one-row aggregate into rows: entries are tuples of (literal | aggregated column name)."""
    structs = [F.struct(*[(F.col(v[1:]) if isinstance(v, str) and v.startswith("@") else F.lit(v)).alias(n)
                          for n, v in zip(names, entry)]) for entry in entries]
    return one_row.select(F.explode(F.array(*structs)).alias("_e")).select("_e.*")


def label_summary(df: DataFrame, classes=None, id_col: str = ID) -> DataFrame:
    """Per class and split the number of 0s and 1s (exclude is ignored)."""
    classes = class_columns(df, classes, id_col)
    val = is_true("validation")
    aggs, entries = [], []
    for i, c in enumerate(classes):
        for split, cond in (("training", ~val), ("validation", val)):
            neg, pos = f"n_{i}_{split}", f"p_{i}_{split}"
            aggs += [F.count_if(cond & (F.col(c) == 0)).alias(neg), F.count_if(cond & (F.col(c) == 1)).alias(pos)]
            entries.append((c, split, "@" + neg, "@" + pos))
    return _counts_to_rows(df.agg(*aggs), entries, ["class", "split", "neg", "pos"])


def tag_summary(df: DataFrame, classes=None, id_col: str = ID) -> DataFrame:
    """Per class the number of NULLs, 0s and 1s."""
    classes = class_columns(df, classes, id_col)
    aggs, entries = [], []
    for i, c in enumerate(classes):
        aggs += [F.count_if(F.col(c).isNull()).alias(f"u_{i}"), F.count_if(F.col(c) == 0).alias(f"n_{i}"),
                 F.count_if(F.col(c) == 1).alias(f"p_{i}")]
        entries.append((c, f"@u_{i}", f"@n_{i}", f"@p_{i}"))
    return _counts_to_rows(df.agg(*aggs), entries, ["class", "n_unknown", "n_neg", "n_pos"])


# ---- accuracy and AUC -------------------------------------------------------------------------------------------

def confusion_counts(labels: DataFrame, preds: DataFrame, threshold: float = 0.5, classes=None,
                     id_col: str = ID) -> DataFrame:
    """tp, tn, fp, fn per class on validation rows, for classes with both values there."""
    classes = class_columns(labels, classes, id_col)
    both = align(labels.where(is_true("validation")).select(id_col, *classes), preds, classes, id_col)
    aggs, entries = [], []
    for i, c in enumerate(classes):
        said = F.col(f"pred_{c}") >= threshold
        cells = {"tp": (F.col(c) == 1) & said, "tn": (F.col(c) == 0) & ~said,
                 "fp": (F.col(c) == 0) & said, "fn": (F.col(c) == 1) & ~said}
        aggs += [F.count_if(cond).alias(f"{n}_{i}") for n, cond in cells.items()]
        entries.append((c, *[f"@{n}_{i}" for n in cells]))
    out = _counts_to_rows(both.agg(*aggs), entries, ["class", "tp", "tn", "fp", "fn"])
    return out.where((F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0))


def accuracy_estimate(counts: DataFrame, alpha: float = 5, beta: float = 5, as_text: bool = False) -> DataFrame:
    """Beta-binomial view of tp, fp, tn, fn: posterior mean accuracy, its 90 % interval, base rate, P(accuracy > base).

    One row per class reaches the pandas function.
    """
    right, wrong = F.col("tp") + F.col("tn"), F.col("fp") + F.col("fn")
    n = (right + wrong).cast("double")
    share = (F.col("tp") + F.col("fn")) / n

    @F.pandas_udf("struct<low double, high double, above double>")
    def interval(a: pd.Series, b: pd.Series, base: pd.Series) -> pd.DataFrame:
        rows = [(beta_quantile(0.05, x, y), beta_quantile(0.95, x, y), beta_cdf(1.0 - r, y, x))
                for x, y, r in zip(a, b, base)]
        return pd.DataFrame(rows, columns=["low", "high", "above"])

    out = (counts.withColumn("accuracy", (F.lit(float(alpha)) + right) / (F.lit(float(alpha + beta)) + n))
                 .withColumn("base_rate", F.greatest(share, F.lit(1.0) - share))
                 .withColumn("_i", interval((right + alpha).cast("double"), (wrong + beta).cast("double"),
                                            F.col("base_rate")))
                 .select(*counts.columns, "accuracy", F.col("_i.low").alias("interval_low"),
                         F.col("_i.high").alias("interval_high"), "base_rate",
                         F.col("_i.above").alias("prob_above_base_rate")))
    if not as_text:
        return out
    return out.select(*counts.columns,
                      F.format_string("%.3f (%.3f-%.3f)", "accuracy", "interval_low", "interval_high").alias("accuracy"),
                      F.format_string("%.3f", "base_rate").alias("base_rate"),
                      F.format_string("%.3f", "prob_above_base_rate").alias("prob_above_base_rate"))


def long_scores(labels: DataFrame, preds: DataFrame, classes, id_col: str = ID) -> DataFrame:
    """(id, class, y, p) of known labels."""
    both = align(labels.select(id_col, *classes), preds, classes, id_col)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).cast("double").alias("y"),
                                        F.col(f"pred_{c}").alias("p")) for c in classes]))
    return both.select(id_col, each.alias("_e")).select(id_col, "_e.*").where(F.col("y").isNotNull())


def auc_by_group(scores: DataFrame, group, y: str = "y", p: str = "p") -> DataFrame:
    """Exact ROC AUC (ties averaged) and accuracy at 0.5 per group; both 0 where a group lacks positives or negatives.

    Equal scores are combined first; the number of negatives below each score is a distributed running total, so a group
    may hold the whole table.
    """
    group = list(group)
    hit = F.count_if((F.col(p) >= 0.5) == (F.col(y) == 1)).cast("double")
    per_score = scores.groupBy(*group, p).agg(F.count_if(F.col(y) == 1).alias("_pos"),
                                              F.count_if(F.col(y) == 0).alias("_neg"), hit.alias("_hit"))
    ranked = running_total(per_score, [p], {"_neg": "_below"}, group)
    wins = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0))
    sums = ranked.groupBy(*group).agg(F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"), wins.alias("_w"),
                                      F.sum("_hit").alias("_h"))
    usable = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return sums.select(*group, "n_pos", "n_neg",
                       F.when(usable, F.col("_w") / (F.col("n_pos").cast("double") * F.col("n_neg"))).otherwise(0.0).alias("auc"),
                       F.when(usable, F.col("_h") / (F.col("n_pos") + F.col("n_neg"))).otherwise(0.0).alias("accuracy"))


def auc(labels: DataFrame, preds: DataFrame, classes=None, validation: bool | None = True, digits: int | None = None,
        id_col: str = ID) -> DataFrame:
    """AUC and accuracy per class over validation rows, training rows or all rows (None)."""
    classes = class_columns(labels, classes, id_col)
    rows = labels
    if validation is not None:
        rows = labels.where(is_true("validation") if validation else ~is_true("validation"))
    found = auc_by_group(long_scores(rows, preds, classes, id_col), ["class"])
    every = labels.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    out = every.join(found, "class", "left").na.fill(0, ["n_pos", "n_neg", "auc", "accuracy"])
    if digits is not None:
        out = out.withColumn("auc", F.round("auc", digits)).withColumn("accuracy", F.round("accuracy", digits))
    return out


def run_summary(labels: DataFrame, preds: DataFrame, classes=None, id_col: str = ID) -> DataFrame:
    """Per class AUC and accuracy on validation rows (8 decimals) with the numbers of validation and training points."""
    classes = class_columns(labels, classes, id_col)
    n, n_open, n_val = labels.agg(F.count(F.lit(1)), F.count_if(is_unlabeled(classes)),
                                  F.count_if(is_true("validation"))).first()
    return auc(labels, preds, classes, True, 8, id_col).select(
        "class", F.lit(n_val).cast("long").alias("num_validation_points"),
        F.lit(n - n_open - n_val).cast("long").alias("num_training_points"),
        F.col("auc").alias("val_auc"), F.col("accuracy").alias("val_acc"))


def _group_of(c: str) -> Column:
    known = F.when(F.col(c) == 1, "positive").otherwise("negative")
    side = F.when(is_true("validation"), "validation_").otherwise("training_")
    return F.when(F.col(c).isNull(), "unlabeled").otherwise(F.concat(side, known))


def raw_scores_by_group(labels: DataFrame, preds: DataFrame, classes=None, id_col: str = ID) -> DataFrame:
    """Long table (class, group, id, score): validation/training × positive/negative, and unlabeled."""
    classes = class_columns(labels, classes, id_col)
    both = align(labels.select(id_col, "validation", *classes), preds, classes, id_col)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), _group_of(c).alias("group"),
                                        F.col(f"pred_{c}").alias("score")) for c in classes]))
    return both.select(id_col, each.alias("_e")).select("_e.class", "_e.group", id_col, "_e.score")


def _density(counts: DataFrame, keys) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("density", F.col("n") * F.lit(float(BINS)) / total)


def unit_bin(p) -> Column:
    return F.least(F.floor(F.col(p) * BINS), F.lit(BINS - 1)).cast("int")


def score_histogram(labels: DataFrame, preds: DataFrame, classes=None, id_col: str = ID) -> DataFrame:
    """Scores in 14 equal bins per class and group, with density (a probability per unit of score)."""
    raw = raw_scores_by_group(labels, preds, classes, id_col)
    counts = raw.groupBy("class", "group", unit_bin("score").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return _density(counts, ["class", "group"])


def scores_by_class_hist(labels: DataFrame, preds: DataFrame, classes=None, id_col: str = ID) -> DataFrame:
    """Histogram of the scores of positives and negatives per class over all known rows."""
    long = long_scores(labels, preds, class_columns(labels, classes, id_col), id_col)
    side = F.when(F.col("y") == 1, "positive").otherwise("negative")
    counts = long.groupBy("class", side.alias("group"), unit_bin("p").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return _density(counts, ["class", "group"])


# ---- losses over label ⋈ score tables ---------------------------------------------------------------------------

def _mean_over_classes(both: DataFrame, classes, term, name: str) -> DataFrame:
    """Mean of term(class) over the known cells of all classes."""
    terms = [term(c) for c in classes]
    total = sum([F.coalesce(t, F.lit(0.0)) for t in terms[1:]], F.coalesce(terms[0], F.lit(0.0)))
    known = sum([t.isNotNull().cast("long") for t in terms[1:]], terms[0].isNotNull().cast("long"))
    return both.agg(F.sum(total).alias("_t"), F.sum(known).alias("n_known")).select(
        (F.col("_t") / F.col("n_known")).alias(name), "n_known")


def masked_bce(labels, preds, classes=None, smoothing: float = 0.0, id_col: str = ID) -> DataFrame:
    classes = class_columns(labels, classes, id_col)
    both = align(labels, preds, classes, id_col)

    def term(c):
        y = label_smoothing(c, smoothing) if smoothing else F.col(c)
        return binary_crossentropy(y, f"pred_{c}")

    return _mean_over_classes(both, classes, term, "loss")


def masked_focal(labels, preds, classes=None, gamma: float = 2.0, id_col: str = ID) -> DataFrame:
    classes = class_columns(labels, classes, id_col)
    both = align(labels, preds, classes, id_col)

    def term(c):
        p, eps = F.col(f"pred_{c}"), F.lit(LOSS_EPS)
        hit = -F.log(p + eps) * F.pow(1.0 - p, gamma)
        miss = -F.log(1.0 - p + eps) * F.pow(p, gamma)
        return F.when(F.col(c) == 1, hit).when(F.col(c) == 0, miss)

    return _mean_over_classes(both, classes, term, "loss")


def masked_mae(labels, preds, classes=None, id_col: str = ID) -> DataFrame:
    classes = class_columns(labels, classes, id_col)
    return _mean_over_classes(align(labels, preds, classes, id_col), classes,
                              lambda c: F.abs(F.col(c) - F.col(f"pred_{c}")), "loss")


def masked_sparse_ce(df: DataFrame, label: str, probs: str) -> DataFrame:
    """Mean of -log probs[label] over rows with a label (NULL or -1 is missing)."""
    known = F.col(label).isNotNull() & (F.col(label) >= 0)
    p = F.element_at(as_double(probs), F.when(known, F.col(label).cast("int") + 1).otherwise(1))
    clipped = F.least(F.greatest(p, F.lit(LOSS_EPS)), F.lit(1.0 - LOSS_EPS))
    return df.agg(F.avg(F.when(known, -F.log(clipped))).alias("loss"), F.count_if(known).alias("n_known"))


def entropy_loss(preds: DataFrame, classes) -> DataFrame:
    """Mean natural-log entropy over all scores."""
    terms = [binary_crossentropy(c, c) for c in classes]
    return preds.agg(F.avg(sum(terms[1:], terms[0]) / len(terms)).alias("loss"))


def distillation_loss(teacher: DataFrame, student: DataFrame, classes, temp: float = 1.0, id_col: str = ID) -> DataFrame:
    """Cross-entropy of softened student scores against softened teacher scores."""
    both = align(teacher.select(id_col, *classes), student, classes, id_col)

    def soften(c):
        return sigmoid((F.lit(2.0) * F.col(c) - 1.0) / temp)

    terms = []
    for c in classes:
        t, s = soften(c), soften(f"pred_{c}")
        terms.append(-(t * F.log(s + LOSS_EPS) + (1.0 - t) * F.log(1.0 - s + LOSS_EPS)))
    return both.agg(F.avg(sum(terms[1:], terms[0]) / len(terms)).alias("loss"))


def kl_divergence(teacher: DataFrame, student: DataFrame, heads, id_col: str = ID) -> DataFrame:
    """Σ t·ln(t/s) per row and head, averaged over rows, summed over heads. Heads are array columns."""
    t = teacher.select(id_col, *heads)
    s = student.select(id_col, *[F.col(h).alias(f"_s_{h}") for h in heads])

    def unit(x):
        return F.least(F.greatest(x, F.lit(LOSS_EPS)), F.lit(1.0))

    per_head = [array_sum(F.zip_with(as_double(h), as_double(f"_s_{h}"),
                                     lambda a, b: unit(a) * F.log(unit(a) / unit(b)))) for h in heads]
    return t.join(s, id_col).agg(*[F.avg(x).alias(f"_{i}") for i, x in enumerate(per_head)]).select(
        sum([F.col(f"_{i}") for i in range(1, len(heads))], F.col("_0")).alias("kl"))


# ---- clusters and multiclass ------------------------------------------------------------------------------------

def nmi(df: DataFrame, a: str, b: str) -> DataFrame:
    """Normalised mutual information (arithmetic mean) of two assignments; identical one-cluster cases give 1."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    def spread(counts):
        """Σ n·ln n and Σ n of a count table."""
        return counts.agg(F.sum(F.col("n") * F.log("n")).alias("s"), F.sum("n").alias("t"))

    rows = spread(cells.groupBy(a).agg(F.sum("n").alias("n"))).select(F.col("s").alias("sa"), "t")
    cols = spread(cells.groupBy(b).agg(F.sum("n").alias("n"))).select(F.col("s").alias("sb"), F.col("t").alias("t_b"))
    both = spread(cells).select(F.col("s").alias("sab"), F.col("t").alias("t_ab"))
    # Three one-row tables, matched on the total they share.
    one = both.join(rows, F.col("t_ab") == F.col("t")).join(cols, F.col("t_ab") == F.col("t_b"))
    n = F.col("t")
    h_a, h_b, h_ab = (F.log(n) - F.col(s) / n for s in ("sa", "sb", "sab"))
    mean = (h_a + h_b) / 2.0
    return one.select(F.when(mean > 1e-12, (h_a + h_b - h_ab) / mean).otherwise(1.0).alias("nmi"))


def confusion_matrix(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))


def multiclass_accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def argmax(vec) -> Column:
    """0-based position of the first largest entry."""
    v = as_double(vec)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def task_accuracy(df: DataFrame, tasks) -> DataFrame:
    """Per task the share of rows whose argmax equals the code; tasks maps name -> (code column, probability column).
    Missing codes are NULL or -1."""
    aggs, entries = [], []
    for i, (name, (label, probs)) in enumerate(tasks.items()):
        known = F.col(label).isNotNull() & (F.col(label) >= 0)
        hit = (argmax(probs) == F.col(label)).cast("double")
        aggs += [F.avg(F.when(known, hit)).alias(f"a_{i}"), F.count_if(known).alias(f"k_{i}")]
        entries.append((name, f"@a_{i}", f"@k_{i}"))
    return _counts_to_rows(df.agg(*aggs), entries, ["task", "accuracy", "n_known"])


def worst_cases(labels: DataFrame, preds: DataFrame, classes=None, id_col: str = ID) -> DataFrame:
    """Per class the highest-scored negative and the lowest-scored positive; ties go to the smaller id."""
    long = long_scores(labels, preds, class_columns(labels, classes, id_col), id_col)
    high = F.max_by(F.struct(F.col(id_col).alias("i"), F.col("p").alias("s")),
                    F.when(F.col("y") == 0, F.struct(F.col("p"), -F.col(id_col))))
    low = F.min_by(F.struct(F.col(id_col).alias("i"), F.col("p").alias("s")),
                   F.when(F.col("y") == 1, F.struct(F.col("p"), F.col(id_col))))
    return long.groupBy("class").agg(high.alias("h"), low.alias("l")).select(
        "class", F.col("h.i").alias("worst_negative"), F.col("h.s").alias("worst_negative_score"),
        F.col("l.i").alias("worst_positive"), F.col("l.s").alias("worst_positive_score"))


def fixmatch_stats(weak: DataFrame, strong: DataFrame, classes, tau: float, id_col: str = ID) -> DataFrame:
    """Mean confidence mask, agreement of strong-view rounding with the pseudo-label, masked loss over all entries."""
    both = align(weak.select(id_col, *classes), strong, classes, id_col)
    n = float(len(classes))

    def mean(term):
        parts = [term(F.col(c).cast("double"), F.col(f"pred_{c}")) for c in classes]
        return F.avg(sum(parts[1:], parts[0]) / n)

    def pseudo(w):
        return F.when(w > 0.5, 1.0).otherwise(0.0)

    def mask(w):
        return F.when((w >= tau) | (w <= 1.0 - tau), 1.0).otherwise(0.0)

    return both.agg(mean(lambda w, s: mask(w)).alias("mask_fraction"),
                    mean(lambda w, s: (pseudo(w) == pseudo(s)).cast("double")).alias("agreement"),
                    mean(lambda w, s: mask(w) * binary_crossentropy(pseudo(w), s)).alias("loss"))


def cluster_sizes(assignment: DataFrame, k: int, cluster: str = "cluster") -> DataFrame:
    """Rows per cluster 0..k-1, empty clusters included."""
    every = assignment.sparkSession.range(k).select(F.col("id").cast("int").alias(cluster))
    sizes = assignment.groupBy(F.col(cluster).cast("int").alias(cluster)).agg(F.count(F.lit(1)).alias("n"))
    return every.join(sizes, cluster, "left").na.fill(0, ["n"])
