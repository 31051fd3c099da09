"""Labelling rounds with state: every round is written as a whole, an interrupted one is done again, and a run stops early."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.operators.edits import apply_label_events
from tagweave.operators.filters import predict_join
from tagweave.operators.metrics import masked_bce, run_summary
from tagweave.operators.select import pick
from tagweave.plans.evaluate import should_stop
from tagweave.plans.training import LinearHeads, train_heads
from tagweave.schema import ID, class_columns


class RoundLog:
    """Tables of numbered rounds below one folder that all executors share.

    A round's tables go to a folder of their own attempt (`round=3/attempt=…/<table>`). The round exists from the moment its
    marker (`done/round-000003.json`, with the attempt and facts about the round) is renamed into place, which is one atomic
    step; until then readers see the round before. Attempts without a marker are removed when the round is begun again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def rounds(self) -> dict[int, dict]:
        """Facts of every whole round, by number."""
        folder = self._path(f"{self.path}/done")
        if not self._fs.exists(folder):
            return {}
        files = [f.getPath() for f in self._fs.listStatus(folder) if f.getPath().getName().startswith("round-")]
        return {int(p.getName()[6:-5]): self._read(p) for p in sorted(files, key=lambda p: p.getName())}

    def _read(self, path) -> dict:
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def begin(self, no: int) -> Attempt:
        if no in self.rounds():
            raise ValueError(f"round {no} of {self.path} is already whole")
        self._fs.delete(self._path(f"{self.path}/round={no}"), True)
        return Attempt(self, no, uuid.uuid4().hex)

    def read(self, table: str, no: int | None = None) -> DataFrame:
        """A table as of one round, by default the newest whole one."""
        facts = self.rounds()
        no = max(facts) if no is None else no
        return self.spark.read.parquet(f"{self.path}/round={no}/attempt={facts[no]['attempt']}/{table}")

    def history(self, table: str) -> DataFrame:
        """The rows of a table in all whole rounds that have it, with `round`."""
        parts = [self.read(table, no).withColumn("round", F.lit(no)) for no, f in self.rounds().items() if table in f["tables"]]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def forget(self, table: str, before: int) -> None:
        """Remove a large table of rounds that no later round reads any more."""
        for no, facts in self.rounds().items():
            if no < before:
                self._fs.delete(self._path(f"{self.path}/round={no}/attempt={facts['attempt']}/{table}"), True)


class Attempt:
    """One try at a round."""

    def __init__(self, log: RoundLog, no: int, name: str):
        self.log, self.no, self.name, self.tables = log, no, name, []

    def write(self, df: DataFrame, table: str) -> DataFrame:
        path = f"{self.log.path}/round={self.no}/attempt={self.name}/{table}"
        df.write.parquet(path)
        self.tables.append(table)
        return self.log.spark.read.schema(df.schema).parquet(path)

    def commit(self, **facts) -> dict:
        """Make the round exist. Fails if another run has made it in the meantime."""
        log, facts = self.log, {"attempt": self.name, "tables": self.tables, **facts}
        draft = log._path(f"{log.path}/done/draft-{self.name}")
        stream = log._fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(facts).encode()))
        finally:
            stream.close()
        marker = log._path(f"{log.path}/done/round-{self.no:06d}.json")
        if log._fs.exists(marker) or not log._fs.rename(draft, marker):
            raise ValueError(f"round {self.no} of {log.path} was made by another run")
        return facts


def heads_table(spark: SparkSession, heads: LinearHeads) -> DataFrame:
    rows = [(c, heads.weights[:, i].tolist(), float(heads.bias[i]), heads.normalize) for i, c in enumerate(heads.classes)]
    return spark.createDataFrame(rows, "class string, weights array<double>, bias double, normalize boolean")


def load_heads(table: DataFrame, classes) -> LinearHeads:
    """Heads from a table of a round: one row per class."""
    rows = {r["class"]: r for r in table.collect()}
    return LinearHeads(list(classes), np.array([rows[c]["weights"] for c in classes]).T, np.array([rows[c]["bias"] for c in classes]),
                       any(r["normalize"] for r in rows.values()))


def label_rounds(path: str, labels: DataFrame, preds: DataFrame, vectors: DataFrame, annotate, m: int, rounds: int,
                 patience: int | None = None, classes=None, sort_by: str = "max entropy", keep_tables: bool = True,
                 id_col: str = ID, vec: str = "embedding", seed=0, **options) -> RoundLog:
    """Labelling rounds 1 to `rounds`, continued after the last whole round that `path` holds.

    A round picks m rows, asks `annotate(picked, round)` for edit events, applies them, trains heads, scores every row and
    reports the run summary and the validation loss. Picked rows and events are written once and everything after them reads the
    written tables, so an answer is never asked twice within a round and every consumer sees the same rows. Draws depend on the
    seed and the number of the round only: a resumed run equals one that was never interrupted, if annotate gives the same answers.

    Round 0 holds the given labels and scores. The run ends before `rounds` when nothing is left to pick, or when the best
    validation loss is more than `patience` rounds old; the newest round's facts then say why (`stopped`). Settings of an earlier
    run in the same folder must agree. With keep_tables=False, labels and scores of rounds that are no longer needed are removed.
    """
    spark = labels.sparkSession
    classes = class_columns(labels, classes, id_col)
    log = RoundLog(spark, path)
    settings = {"m": m, "classes": list(classes), "sort_by": sort_by, "seed": str(seed)}
    done = log.rounds()
    if not done:
        attempt = log.begin(0)
        attempt.write(labels, "labels")
        attempt.write(preds.select(id_col, *classes), "preds")
        done = {0: attempt.commit(settings=settings)}
    if done[0]["settings"] != settings:
        raise ValueError(f"{path} holds rounds with other settings: {done[0]['settings']}")
    for no in range(max(done) + 1, rounds + 1):
        losses = [f["val_loss"] for n, f in sorted(done.items()) if n > 0]
        if done[max(done)].get("stopped") or (patience is not None and should_stop(losses, patience)):
            break
        before, scores = log.read("labels", no - 1), log.read("preds", no - 1)
        attempt = log.begin(no)
        picked = attempt.write(pick(before, scores, m, "unlabeled", "not excluded", sort_by, "all", classes, id_col,
                                    f"{seed}:{no}", vectors), "picked")
        if picked.isEmpty():
            for table, df in (("labels", before), ("preds", scores)):
                attempt.write(df, table)
            done[no] = attempt.commit(val_loss=losses[-1] if losses else None, picked=0, stopped="nothing left to pick")
            break
        events = attempt.write(annotate(picked, no), "events")
        updated = attempt.write(apply_label_events(before, events, classes, id_col), "labels")
        heads = train_heads(vectors, updated, classes, id_col=id_col, vec=vec, **options)
        attempt.write(heads_table(spark, heads), "heads")
        scored = attempt.write(predict_join(scores, heads.predict(vectors, id_col, vec), classes, id_col), "preds")
        summary = attempt.write(run_summary(updated, scored, classes, id_col), "summary")
        loss = masked_bce(updated.where("validation"), scored, classes, id_col=id_col).agg(F.avg("loss")).first()[0]
        loss = float("inf") if loss is None or loss != loss else float(loss)
        numbers = summary.unpivot(["class"], ["val_auc", "val_acc"], "metric", "value")
        attempt.write(numbers.select(F.lit(f"{path}").alias("run_id"), F.lit(no).cast("long").alias("step"),
                                     F.concat_ws("_", "class", "metric").alias("name"), "value"), "metrics")
        late = patience is not None and should_stop([*losses, loss], patience)
        done[no] = attempt.commit(val_loss=loss, picked=picked.count(), stopped="no better validation loss" if late else None)
        if not keep_tables:
            for table in ("labels", "preds"):
                log.forget(table, no)
    return log
