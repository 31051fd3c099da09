"""Running state over label-event streams.

Sinks write one folder per micro-batch and replace it when the batch is retried, so a restart changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagweave.functions.scoring import shannon_entropy
from tagweave.operators.edits import BOOLEAN_FIELDS, apply_latest, latest_edits, merge_latest
from tagweave.operators.select import latest_k
from tagweave.schema import ID, class_columns


def event_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_trigger: int = 100) -> DataFrame:
    """File-source stream; NTZ timestamps become instants so that watermarks work."""
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
              .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def label_event_stream(events: DataFrame, log: str, checkpoint: str, fields, id_col: str = ID, once: bool = True) -> StreamingQuery:
    """Append the last write per item of each micro-batch to `log`, however late its events are.

    An event that comes late or twice changes nothing wrongly: the log is read by the largest (timestamp, event id).
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        latest_edits(batch, fields, id_col).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    return _start(events.writeStream.foreachBatch(write), checkpoint, once)


def current_labels(labels: DataFrame, log: str, classes=None, id_col: str = ID) -> DataFrame:
    """The label table with the whole edit log applied."""
    fields = [f for f in (*BOOLEAN_FIELDS, *class_columns(labels, classes, id_col)) if f in labels.columns]
    edits = labels.sparkSession.read.parquet(log).drop("batch")
    return apply_latest(labels, merge_latest(edits, fields, id_col), fields, id_col)


def compact_log(spark: SparkSession, log: str, target: str, fields, id_col: str = ID) -> None:
    """Fold all micro-batches of a log into one batch of a new log."""
    merge_latest(spark.read.parquet(log).drop("batch"), fields, id_col).write.mode("overwrite").parquet(f"{target}/batch=0")


def _rewritten(counts: DataFrame, path: str, checkpoint: str, once: bool) -> StreamingQuery:
    """Every micro-batch writes the whole small result; the one before the last is removed.

    The rows are shuffled into one file: coalesced, all partitions of the state would be one task that holds all their tables."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.repartition(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        _forget(batch.sparkSession, f"{path}/batch={batch_id - 2}")

    return _start(counts.writeStream.outputMode("complete").foreachBatch(write), checkpoint, once)


def _forget(spark: SparkSession, path: str) -> None:
    """Remove a folder that later micro-batches do not need, also not on a retry of the last one."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def running_label_counts(events: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Number of events per field and value so far."""
    return _rewritten(events.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")), path, checkpoint, once)


def newest_batch(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last micro-batch below `path`."""
    every = spark.read.parquet(path)
    newest = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == newest).drop("batch")


def windowed_label_counts(events: DataFrame, path: str, checkpoint: str, width: str = "1 day", once: bool = True) -> StreamingQuery:
    """Counts per tumbling window and field so far, with open windows and late events."""
    counts = (events.groupBy(F.window("ts", width).alias("w"), "field").agg(F.count(F.lit(1)).alias("n"))
              .select(F.col("w.start").alias("window_start"), "field", "n"))
    return _rewritten(counts, path, checkpoint, once)


def stream_latest_k(vectors: DataFrame, k: int, seq: str, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the newest k rows: the k kept before plus the k newest of the micro-batch, cut to k. Read with `newest_batch`."""
    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = latest_k(batch, k, seq)
        if batch_id > 0:
            before = batch.sparkSession.read.schema(fresh.schema).parquet(f"{path}/batch={batch_id - 1}")
            fresh = latest_k(fresh.unionByName(before), k, seq)
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        _forget(batch.sparkSession, f"{path}/batch={batch_id - 2}")

    return _start(vectors.writeStream.foreachBatch(write), checkpoint, once)


def stream_score(items: DataFrame, score, classes, threshold: float, path: str, checkpoint: str, id_col: str = ID,
                 once: bool = True) -> StreamingQuery:
    """Score arriving items with `score(df) -> df` and keep those whose entropy is at least `threshold`."""
    scored = score(items).withColumn("entropy", shannon_entropy(classes)).where(F.col("entropy") >= threshold)
    return _start(scored.select(id_col, *classes, "entropy").writeStream.format("parquet").option("path", path), checkpoint, once)
