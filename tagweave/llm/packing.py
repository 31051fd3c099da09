"""Packing of documents into padded batches with optimal length buckets.

The global histogram of sequence lengths (at most `max_len` counts, whatever the number of documents) goes to the driver.
Dynamic programming over it finds the bucket boundaries with the least padding. Every bucket is filled into batches of at
most `budget` tokens; rows are numbered in hashed order over salted parts, so no task sees a whole bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.common import WORDS, Scratch

PART_ROWS = 50_000


def best_buckets(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most `buckets` lengths, the last the longest, such that rounding every length up to the next costs least.

    Of several best choices the one with the fewest buckets and the smaller boundaries is taken. Time is
    buckets * len(lengths) ** 2, on arrays.
    """
    if not len(lengths):
        return []
    lengths, counts = np.asarray(lengths, np.float64), np.asarray(counts, np.float64)
    before = np.r_[0.0, np.cumsum(counts)]
    total = lengths * before[1:]  # one bucket for all up to j
    choice, best = [], total
    for _ in range(1, min(buckets, len(lengths))):
        back = np.zeros(len(lengths), int)
        now = best.copy()
        for j in range(1, len(lengths)):
            cost = best[:j] + lengths[j] * (before[j + 1] - before[1:j + 1])
            i = int(np.argmin(cost))
            back[j], now[j] = (i + 1, cost[i]) if cost[i] < best[j] else (0, best[j])
        choice.append(back)
        best = now
    out, j = [int(lengths[-1])], len(lengths) - 1
    for back in reversed(choice):  # 0: this level does no better than the one below
        if back[j]:
            j = back[j] - 1
            out.append(int(lengths[j]))
    return out[::-1]


def pack(docs: DataFrame, length: Column | None = None, buckets: int = 8, max_len: int = 2048, budget: int = 16_384,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A padded place for every sequence.

    `length` is a document's number of tokens; without it, words of `text_col` are counted. Documents over `max_len` are cut
    into pieces of max_len and a rest. Returns per piece: doc_id, piece (from 0), start (first token), length, bucket_len
    (padded length), batch (number inside the bucket) and place (row inside the batch). A batch holds budget // bucket_len
    rows, at least one; only the last batch of a bucket can hold fewer.

    Documents without tokens, or a null text or length, give one row of length 0 without bucket, batch and place. Null or
    repeated ids are kept as they are, each row packed on its own. Other columns are ignored; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    n = F.coalesce(F.regexp_count(text_col, F.lit(WORDS)) if length is None else length, F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n"))
    pieces = F.greatest(F.ceil(F.col("n") / max_len), F.lit(1)).cast("int")
    rows = (sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
            .withColumn("start", F.col("piece").cast("long") * max_len)
            .select("doc_id", "piece", "start", F.least(F.col("n") - F.col("start"), F.lit(max_len)).alias("length")))
    rows = scratch.write(rows, "rows")
    histogram = rows.where("length > 0").groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect()
    edges = best_buckets(np.array([r["length"] for r in histogram]), np.array([r["n"] for r in histogram]), buckets)
    bucket = F.coalesce(*[F.when((F.col("length") > 0) & (F.col("length") <= e), F.lit(e).cast("long")) for e in edges],
                        F.lit(None).cast("long"))
    parts = max(16, sum(r["n"] for r in histogram) // PART_ROWS)
    order = F.xxhash64("doc_id", "piece", "length")
    keyed = rows.withColumns({"bucket_len": bucket, "_part": F.pmod(order, F.lit(parts))})
    filled = keyed.where("bucket_len IS NOT NULL")
    inside = Window.partitionBy("bucket_len", "_part").orderBy(order, "doc_id", "piece", "length")
    sizes = filled.groupBy("bucket_len", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("bucket_len").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket_len", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    number = F.col("_off") + F.row_number().over(inside) - 1
    per_batch = F.greatest(F.floor(F.lit(budget) / F.col("bucket_len")), F.lit(1)).cast("long")
    placed = (filled.join(offsets, ["bucket_len", "_part"]).withColumn("_no", number)
              .withColumns({"batch": F.floor(F.col("_no") / per_batch).cast("long"), "place": (F.col("_no") % per_batch).cast("int")}))
    none = keyed.where("bucket_len IS NULL").withColumns({"batch": F.lit(None).cast("long"), "place": F.lit(None).cast("int")})
    columns = ["doc_id", "piece", "start", "length", "bucket_len", "batch", "place"]
    return placed.select(columns).unionByName(none.select(columns))
