"""Linear heads on embeddings: missing labels, focal loss, soft targets, several tasks, probes."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.scoring import label_smoothing
from tagweave.functions.vectors import as_double, l2_normalize, sum_vectors
from tagweave.operators import blocks as B
from tagweave.operators.features import multiply, standardize
from tagweave.operators.filters import training_rows
from tagweave.operators.metrics import confusion_matrix, multiclass_accuracy
from tagweave.operators.ranking import ordered_index
from tagweave.operators.sample import strata_sizes, stratum_shares
from tagweave.schema import ID, class_columns


@dataclass
class LinearHeads:
    """One sigmoid unit per class: weights d × C and bias C."""

    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray
    normalize: bool = False
    loss: list[float] = field(default_factory=list)

    def predict(self, vectors: DataFrame, id_col: str = ID, vec: str = "embedding") -> DataFrame:
        x = vectors.select(id_col, (l2_normalize(vec) if self.normalize else as_double(vec)).alias(vec))
        logits = multiply(x, self.weights, vec, "_z")
        return logits.select(id_col, *[(F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.element_at("_z", i + 1) + float(b))))).alias(c)
                                       for i, (c, b) in enumerate(zip(self.classes, self.bias))])


def _class_weights(labels: DataFrame, classes, mode: str, id_col: str):
    """Per class an expression for the expected draw weight of a known cell, scaled to mean about 1.

    A draw takes a whole row, so each known class of a row has the row's weight: the sum over all its strata.
    """
    sizes = strata_sizes(labels, classes, id_col)
    total = sum(n for *_, n in sizes)
    parts = [F.when(F.col(c) == v, F.lit(p / n * total)).otherwise(0.0) for (c, v, n), p in zip(sizes, stratum_shares(sizes, mode))]
    row = sum(parts, F.lit(0.0))
    return {c: F.when(F.col(c).isin(0, 1), row) for c in classes}, {c: sum(n for d, _, n in sizes if d == c) for c in classes}


def train_heads(vectors: DataFrame, labels: DataFrame, classes=None, loss: str = "bce", mode: str = "class",
                smoothing: float = 0.0, gamma: float = 2.0, weight_decay: float = 0.0, normalize: bool = False,
                steps: int = 60, learning_rate: float = 0.3, id_col: str = ID, vec: str = "embedding") -> LinearHeads:
    """Multi-label linear classifier over training rows with missing labels.

    `bce` fits one MLlib logistic regression per class with the stratified draw weights; smoothing turns a label into
    two weighted rows. `focal` runs full-batch gradient steps (see `descend`).
    """
    classes = class_columns(labels, classes, id_col)
    weights, known = _class_weights(labels, classes, mode, id_col)
    feature = (l2_normalize(vec) if normalize else as_double(vec)).alias(vec)
    train = training_rows(labels).select(id_col, *classes, *[w.alias(f"_w_{c}") for c, w in weights.items()])
    data = train.join(vectors.select(id_col, feature), id_col)
    if loss == "focal":
        return descend(data, classes, "focal", {"gamma": gamma}, steps, learning_rate, weight_decay, vec, normalize)
    if loss != "bce":
        raise ValueError(f"loss must be 'bce' or 'focal', not {loss!r}")
    data = data.withColumn("features", array_to_vector(as_double(vec))).drop(vec).persist()
    try:
        coefs, bias, history = [], [], []
        for c in classes:
            rows = data.where(F.col(c).isNotNull())
            target = label_smoothing(c, smoothing) if smoothing else F.col(c)
            sides = F.array(F.struct(F.lit(1.0).alias("y"), (target * F.col(f"_w_{c}")).alias("w")),
                            F.struct(F.lit(0.0).alias("y"), ((1.0 - target) * F.col(f"_w_{c}")).alias("w")))
            rows = rows.select("features", F.explode(sides).alias("_s")).select("features", "_s.*").where(F.col("w") > 0)
            if known[c] == 0:
                raise ValueError(f"class {c!r} has no known training label")
            model = LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", regParam=weight_decay,
                                       maxIter=steps, family="binomial").fit(rows)
            coefs.append(model.coefficients.toArray())
            bias.append(model.intercept)
            history.append(list(model.summary.objectiveHistory))
    finally:
        data.unpersist()
    longest = max(len(h) for h in history)
    mean = [float(np.mean([h[min(i, len(h) - 1)] for h in history])) for i in range(longest)]
    return LinearHeads(list(classes), np.stack(coefs, 1), np.asarray(bias), normalize, mean)


_PARTIAL = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("g", T.ArrayType(T.DoubleType()))])


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def _loss_and_slope(kind: str, p, y, w, opts):
    """Loss per cell and its derivative with respect to the logit; cells with weight 0 are missing."""
    eps = 1e-7
    q = np.clip(p, eps, 1 - eps)
    if kind == "soft":
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)) * w, (p - y) * w
    if kind == "focal":
        g = opts["gamma"]
        hit = -np.log(q) * (1 - q) ** g
        miss = -np.log(1 - q) * q ** g
        d_hit = -((1 - q) ** (g + 1)) + g * q * (1 - q) ** g * np.log(q)
        d_miss = q ** (g + 1) - g * (1 - q) * q ** g * np.log(1 - q)
        return np.where(y > 0.5, hit, miss) * w, np.where(y > 0.5, d_hit, d_miss) * w
    if kind == "distill":
        t = opts["temp"]
        target, s = _sigmoid((2 * y - 1) / t), _sigmoid((2 * p - 1) / t)
        value = -(target * np.log(s + eps) + (1 - target) * np.log(1 - s + eps))
        return value * w, (s - target) * (2.0 / t) * p * (1 - p) * w
    raise ValueError(kind)


def descend(data: DataFrame, classes, kind: str, opts: dict, steps: int, learning_rate: float, weight_decay: float,
            vec: str = "embedding", normalize: bool = False, divisor: float | None = None) -> LinearHeads:
    """Full-batch Adam steps on a linear head. `data` holds the vector, targets <class> and weights _w_<class>.

    The summed loss is divided by the sum of the weights, or by `divisor`, before the penalty is added.

    Each step is one job: a task adds its rows up to one vector per class (gradient, then loss), the vectors are summed by a
    shuffle, and only the C sums come back.
    """
    rows = data.select(as_double(vec).alias("x"),
                       F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in classes]).alias("y"),
                       F.array(*[F.when(F.col(c).isNotNull(), F.coalesce(f"_w_{c}", F.lit(0.0))).otherwise(0.0)
                                 for c in classes]).alias("w")).persist()
    try:
        dim, total = rows.agg(F.max(F.size("x")), F.sum(F.aggregate("w", F.lit(0.0), lambda a, b: a + b))).first()
        total = divisor or total
        n_cls = len(classes)
        theta = np.zeros((dim + 1, n_cls))
        m, v, history = np.zeros_like(theta), np.zeros_like(theta), []
        for step in range(1, steps + 1):
            def partial(batches, theta=theta):
                acc = np.zeros((theta.shape[0] + 1, theta.shape[1]))
                for batch in batches:
                    if batch.num_rows == 0:
                        continue
                    x, y, w = (B.matrix_of(batch.column(c)) for c in ("x", "y", "w"))
                    cell, slope = _loss_and_slope(kind, _sigmoid(x @ theta[:-1] + theta[-1]), y, w, opts)
                    acc[:-2] += x.T @ slope
                    acc[-2] += slope.sum(0)
                    acc[-1] += cell.sum(0)
                yield B.to_batch({"i": np.arange(acc.shape[1], dtype=np.int32), "g": B.list_array(acc.T)}, _PARTIAL)

            sums = np.zeros((dim + 2, n_cls))
            for r in sum_vectors(rows.mapInArrow(partial, _PARTIAL), "i", "g").collect():
                sums[:, r["i"]] = r["g"]
            grad = sums[:-1] / total
            grad[:-1] += weight_decay * theta[:-1]
            history.append(float(sums[-1].sum() / total))
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
            theta = theta - learning_rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    finally:
        rows.unpersist()
    return LinearHeads(list(classes), theta[:-1], theta[-1], normalize, history)


def train_mlp_head(vectors: DataFrame, labels: DataFrame, classes=None, hidden=(128,), steps: int = 100, seed: int = 0,
                   id_col: str = ID, vec: str = "embedding") -> dict:
    """One multilayer perceptron per class over its known training rows (sigmoid hidden units, no dropout)."""
    classes = class_columns(labels, classes, id_col)
    data = training_rows(labels).select(id_col, *classes).join(
        vectors.select(id_col, array_to_vector(as_double(vec)).alias("features")), id_col).persist()
    try:
        dim = data.select("features").first()[0].size
        return {c: MultilayerPerceptronClassifier(layers=[dim, *hidden, 2], labelCol=c, maxIter=steps, seed=seed).fit(
            data.where(F.col(c).isNotNull()).select("features", c)) for c in classes}
    finally:
        data.unpersist()


def predict_mlp(models: dict, vectors: DataFrame, id_col: str = ID, vec: str = "embedding") -> DataFrame:
    out = vectors.select(id_col, array_to_vector(as_double(vec)).alias("features"))
    for c, model in models.items():
        model = model.copy().setProbabilityCol("_pr").setPredictionCol("_pd").setRawPredictionCol("_rw")
        out = model.transform(out).withColumn(c, F.element_at(vector_to_array("_pr"), 2)).drop("_pr", "_pd", "_rw")
    return out.drop("features")


def linear_probe(df: DataFrame, label: str = "label", is_test=None, id_col: str = ID, vec: str = "embedding",
                 max_iter: int = 50, reg: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """Every third row in the order of ids is test; standardise on train, multinomial classifier: (accuracy table, confusion
    matrix)."""
    rows = df.where(F.col(label).isNotNull())
    if is_test is None:
        rows = rows.join(ordered_index(rows.select(id_col), [id_col], out="_no"), id_col)
    rows = rows.withColumn("_test", is_test if is_test is not None else F.col("_no") % 3 == 0)
    scaled = standardize(rows, rows.where(~F.col("_test")), vec)
    data = scaled.select(id_col, "_test", F.col(label).cast("double").alias("y"),
                         array_to_vector(as_double(vec)).alias("features")).persist()
    try:
        model = LogisticRegression(labelCol="y", family="multinomial", maxIter=max_iter, regParam=reg).fit(
            data.where(~F.col("_test")))
    finally:
        data.unpersist()
    scored = model.transform(data.where("_test")).select(F.col("y").cast("int").alias("label"),
                                                         F.col("prediction").cast("int").alias("pred"))
    return multiclass_accuracy(scored, "label", "pred"), confusion_matrix(scored, "label", "pred")


def self_train(labels: DataFrame, weak: DataFrame, strong: DataFrame, tau: float = 0.95, lam: float = 1.0, mu: float = 5,
               rounds: int = 3, steps: int = 30, classes=None, weight_decay: float = 0.0, id_col: str = ID,
               vec: str = "embedding", learning_rate: float = 0.3) -> tuple[LinearHeads, list[dict]]:
    """Rounds of: fit on known labels plus confident pseudo-labels, score the weak view of the unlabelled rows, keep
    confident cells as targets for the strong view with weight lam.

    The masked term averages over all unlabelled cells and the supervised one over all known cells, so the weights are
    lam / unlabelled cells and 1 / known cells; mu only set batch sizes and cancels out of the full-batch means.
    """
    classes = class_columns(labels, classes, id_col)
    rows = training_rows(labels)
    known = rows.join(weak.select(id_col, vec), id_col).select(
        vec, *classes, *[F.lit(1.0).alias(f"_w_{c}") for c in classes])
    n_known = rows.agg(*[F.count(c).alias(c) for c in classes]).first()
    cells = sum(n_known[c] for c in classes)
    from tagweave.operators.filters import is_unlabeled, pseudo_label

    open_ids = rows.where(is_unlabeled(classes)).select(id_col)
    n_open = open_ids.count()
    head = descend(known, classes, "soft", {}, steps, learning_rate, weight_decay, vec)
    report = []
    for r in range(rounds):
        scores = head.predict(weak.join(open_ids, id_col, "left_semi"), id_col, vec)
        pseudo = pseudo_label(scores, tau, classes, id_col)
        scale = lam * cells / max(n_open * len(classes), 1)
        extra = pseudo.join(strong.select(id_col, vec), id_col).select(
            vec, *[F.col(f"y_{c}").alias(c) for c in classes], *[(F.col(f"mask_{c}") * scale).alias(f"_w_{c}") for c in classes])
        share = pseudo.agg(F.avg(sum([F.col(f"mask_{c}") for c in classes[1:]], F.col(f"mask_{classes[0]}"))
                                 / len(classes))).first()[0]
        head = descend(known.unionByName(extra), classes, "soft", {}, steps, learning_rate, weight_decay, vec, divisor=cells)
        report.append({"round": r, "mask_fraction": share, "loss": head.loss[-1]})
    return head, report


def distill(teacher: DataFrame, vectors: DataFrame, classes, temp: float = 1.0, steps: int = 60, learning_rate: float = 0.3,
            weight_decay: float = 0.0, id_col: str = ID, vec: str = "embedding") -> LinearHeads:
    """Student head fitted to soft teacher scores with the softened cross-entropy."""
    data = teacher.select(id_col, *classes, *[F.lit(1.0).alias(f"_w_{c}") for c in classes]).join(
        vectors.select(id_col, vec), id_col)
    return descend(data, classes, "distill", {"temp": temp}, steps, learning_rate, weight_decay, vec)


def train_multitask(vectors: DataFrame, codes: DataFrame, tasks, task_weights=None, steps: int = 50, reg: float = 0.0,
                    id_col: str = ID, vec: str = "embedding") -> tuple[dict, list[dict]]:
    """One softmax head per task over its known rows. `codes` has <task>_code with -1 for missing.

    Rows carry the balanced draw weight. The report gives loss and weight per task: equal, given, or `adaptive`
    (loss·e^-w + w/2, minimised at w = ln(2·loss)).
    """
    from tagweave.operators.sample import missingness_weights

    masked = codes.select(id_col, *[F.when(F.col(f"{t}_code") >= 0, F.col(f"{t}_code")).alias(t) for t in tasks])
    weighted = masked.join(missingness_weights(masked, tasks, id_col), id_col)
    data = weighted.join(vectors.select(id_col, array_to_vector(as_double(vec)).alias("features")), id_col).persist()
    models, report = {}, []
    try:
        for t in tasks:
            known = data.where(F.col(t).isNotNull()).select("features", F.col(t).cast("double").alias("y"),
                                                            (F.col("weight") * 1e6).alias("w"))
            models[t] = LogisticRegression(labelCol="y", weightCol="w", family="multinomial", maxIter=steps,
                                           regParam=reg).fit(known)
            loss = float(models[t].summary.objectiveHistory[-1])
            if task_weights == "adaptive":
                w = float(np.log(max(2.0 * loss, 1e-9)))
                report.append({"task": t, "loss": loss, "weight": w, "total": loss * float(np.exp(-w)) + w / 2.0})
            else:
                w = 1.0 if task_weights is None else float(task_weights[t])
                report.append({"task": t, "loss": loss, "weight": w, "total": w * loss})
    finally:
        data.unpersist()
    return models, report


def predict_multitask(models: dict, vectors: DataFrame, id_col: str = ID, vec: str = "embedding") -> DataFrame:
    """Per task the class probabilities as an array column <task>_probs."""
    out = vectors.select(id_col, array_to_vector(as_double(vec)).alias("features"))
    for t, model in models.items():
        model = model.copy().setProbabilityCol("_pr").setPredictionCol("_pd").setRawPredictionCol("_rw")
        out = model.transform(out).withColumn(f"{t}_probs", vector_to_array("_pr")).drop("_pr", "_pd", "_rw")
    return out.drop("features")
