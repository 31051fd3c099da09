"""Random search, representation reports and labelling rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.operators.contrast import alignment, avg_cosine, uniformity
from tagweave.operators.edits import apply_label_events
from tagweave.operators.filters import predict_join
from tagweave.operators.metrics import (accuracy_estimate, auc, auc_by_group, confusion_counts, masked_bce,
                                        run_summary)
from tagweave.operators.select import pick
from tagweave.plans import trials
from tagweave.plans.experiments import sample_and_evaluate  # noqa: F401
from tagweave.plans.training import LinearHeads, linear_probe, train_heads
from tagweave.schema import ID, class_columns
from tagweave.session import cut_lineage
from tagweave.sources.store import log_metrics


def train_and_report(vectors: DataFrame, labels: DataFrame, classes=None, id_col: str = ID, vec: str = "embedding",
                     **options) -> tuple[LinearHeads, DataFrame, DataFrame]:
    """Fit heads, score every row, and give the accuracy estimate with AUC per class: (heads, scores, metrics)."""
    classes = class_columns(labels, classes, id_col)
    heads = train_heads(vectors, labels, classes, id_col=id_col, vec=vec, **options)
    scores = heads.predict(vectors, id_col, vec)
    estimate = accuracy_estimate(confusion_counts(labels, scores, 0.5, classes, id_col))
    areas = auc(labels, scores, classes, True, None, id_col).select("class", "auc")
    return heads, scores, estimate.join(areas, "class")


def random_search(vectors: DataFrame, labels: DataFrame, table: DataFrame, classes=None, steps: int = 20, id_col: str = ID,
                  vec: str = "embedding", log_path: str | None = None, run_id: str = "search") -> DataFrame:
    """Train the heads of every trial row, all in the same scans, and report AUC and accuracy per trial and class on the
    validation rows.

    Of a trial its weight decay (`lam`), learning_rate, lr_decay, optimizer and sampling hold; `finetune` names the epoch from which
    a feature network is trained and means nothing for fixed vectors. With `log_path`, the loss of each trial by step and the final
    numbers are appended there by `log_metrics`.
    """
    report, fits = trials.search(vectors, labels, table, classes, steps, id_col, vec)
    if log_path is not None:
        spark = vectors.sparkSession
        report = cut_lineage(report)
        final = report.unpivot(["trial", "class"], ["auc", "accuracy"], "metric", "value")
        log_metrics(fits.log(spark, run_id).unionByName(final.select(
            F.lit(run_id).alias("run_id"), F.lit(steps).cast("long").alias("step"),
            F.concat(F.lit("trial_"), F.col("trial"), F.lit("_"), F.col("class"), F.lit("_"), F.col("metric")).alias("name"), "value")), log_path)
    return report


def run_this_epoch(every, epoch: int) -> bool:
    """True: each epoch; False: never; an integer n: every n-th, not at epoch 0."""
    if isinstance(every, bool):
        return every
    return epoch > 0 and epoch % every == 0


def representation_report(embeddings: DataFrame, views: DataFrame, label: str = "label", id_col: str = ID,
                          vec: str = "embedding") -> DataFrame:
    """(name, value): alignment and uniformity on view pairs, average cosine, accuracy of the linear probe."""
    unit = views.select(F.col("z1").alias("z"))
    accuracy, _ = linear_probe(embeddings, label, id_col=id_col, vec=vec)
    parts = [alignment(views).select(F.lit("alignment").alias("name"), F.col("alignment").alias("value")),
             uniformity(unit, vec="z").select(F.lit("uniformity").alias("name"), F.col("uniformity").alias("value")),
             avg_cosine(unit, "z").select(F.lit("avg_cosine").alias("name"), F.col("avg_cosine").alias("value")),
             accuracy.select(F.lit("linear_probe_accuracy").alias("name"), F.col("accuracy").alias("value"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def active_round(labels: DataFrame, preds: DataFrame, vectors: DataFrame, annotate, m: int, classes=None,
                 sort_by: str = "max entropy", id_col: str = ID, vec: str = "embedding", seed=0, **options) -> dict:
    """One labelling round. `annotate(picked)` returns edit events for the picked rows; they are applied, heads are
    trained, every row is scored and the run summary and validation loss are reported."""
    classes = class_columns(labels, classes, id_col)
    picked = pick(labels, preds, m, "unlabeled", "not excluded", sort_by, "all", classes, id_col, seed, vectors)
    updated = apply_label_events(labels, annotate(picked), classes, id_col)
    heads = train_heads(vectors, updated, classes, id_col=id_col, vec=vec, **options)
    scores = predict_join(preds, heads.predict(vectors, id_col, vec), classes, id_col)
    val = updated.where(F.col("validation"))
    return {"picked": picked, "labels": updated, "preds": scores, "heads": heads,
            "summary": run_summary(updated, scores, classes, id_col), "val_loss": masked_bce(val, scores, classes, id_col=id_col)}


def should_stop(val_losses, patience: int) -> bool:
    """No improvement of the best validation loss within the last `patience` rounds."""
    if len(val_losses) <= patience:
        return False
    return int(np.argmin(val_losses)) < len(val_losses) - patience
