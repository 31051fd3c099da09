"""Ranked lexical search: the best documents for every item of a query table, term at a time with limited accumulators.

1. One pass over the texts keeps, per document with terms, its length and the counts of the terms that some item asks for.
   Document frequencies, the number of documents and their total length are sums over this table.
2. Each task takes its documents in blocks. A block is turned into postings, one run per term, with every posting's integer
   contribution and every term's largest one. An item's terms are processed by falling weight, rarest first. A document gets an
   accumulator when a posting reaches it, until the largest contributions of all remaining terms together cannot reach the
   kth best partial score of the item any more (or the kth best of earlier blocks): a document first met later could
   neither win nor tie. Documents with accumulators are still updated by every remaining term, so their scores are exact.
3. A task returns the k best per item, and the k best of those are the result.

Cost: texts are read once and never shuffled; what is shuffled is k rows per item and task. Items come in groups of at most
`GROUP_TERMS` different terms, each a pass over the texts, so the vocabulary sent to the tasks has a bound.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.common import Scratch

GROUP_TERMS = 200_000
GROUP_ITEMS = 20_000
BLOCK_POSTINGS = 4_000_000
# Bytes outside terms become blanks and A-Z become a-z; all bytes from 128 on belong to terms.
_TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TERM_BYTES).split(b" ") if text else []


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, b: int = 75, id_col: str = "doc_id",
                   text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The k documents of highest score above 0 for every row of `items`: `item_col`, rank from 1, `id_col`, score.

    Terms are runs of ASCII letters, digits and all characters beyond ASCII, with A-Z lower-cased. With N documents that have
    terms, L terms in them, and a term in df of them, its weight is w = floor(1000 * ln((2 N + 2) / (2 df + 1))). A document with n
    terms has m = 100 - b + b n N div L, and its score is the sum over the item's terms, repeats included, of
    w * ((10**9 tf) div (1000 tf + 8 m)), in integers.

    Equal scores go by ascending id, null ids last. Null texts and texts without terms match nothing and do not count. Every
    row of `docs` is a document and every row of `items` an item, so repeated rows give repeated results. Other columns are
    ignored. Empty tables give no rows.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item"), F.col("text").cast("binary").alias("text"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    item_type = asked.schema["item"].dataType.simpleString()
    result = None
    for group in _groups(asked):
        vocabulary, queries = {}, []
        for row in group:
            counts: dict[int, int] = {}
            for t in terms_of(bytes(row["text"]) if row["text"] is not None else None):
                if t:
                    code = vocabulary.setdefault(t, len(vocabulary))
                    counts[code] = counts.get(code, 0) + 1
            queries.append((row["item"], counts))
        best = _search(texts, vocabulary, queries, k, b)
        names = spark.createDataFrame([(i, q[0]) for i, q in enumerate(queries)], f"at int, item {item_type}")
        ranked = best.join(F.broadcast(names), "at").select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
        result = ranked if result is None else result.unionByName(ranked)
    if result is None:
        return spark.createDataFrame([], f"`{item_col}` {item_type}, rank int, `{id_col}` long, score long")
    return result


def _groups(asked: DataFrame):
    """The items in lists of bounded numbers of terms. Only one list is on the driver at a time."""
    held, size = [], 0
    for row in asked.toLocalIterator():
        n = len(set(terms_of(bytes(row["text"])))) if row["text"] is not None else 0
        if held and (size + n > GROUP_TERMS or len(held) >= GROUP_ITEMS):
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held


def _search(texts: DataFrame, vocabulary: dict[bytes, int], queries: list[tuple], k: int, b: int) -> DataFrame:
    spark = texts.sparkSession
    scratch = Scratch(spark, "lexical")
    shared = spark.sparkContext.broadcast(vocabulary)
    counted = scratch.write(texts.mapInArrow(_count(shared), "doc long, n long, codes array<int>, counts array<int>"), "counted")
    size = counted.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("length")).first()
    df = {r["code"]: r["df"] for r in counted.select("codes").mapInArrow(_frequencies(len(vocabulary)), "code int, df long")
          .groupBy("code").agg(F.sum("df").alias("df")).collect()}  # at most GROUP_TERMS rows
    weight = np.zeros(len(vocabulary), np.int64)
    for code, n in df.items():
        weight[code] = math.floor(1000 * math.log((2 * size["docs"] + 2) / (2 * n + 1)))
    plans = [sorted(((int(weight[c]), q, c) for c, q in counts.items() if c in df), reverse=True) for _, counts in queries]
    plan = spark.sparkContext.broadcast((weight, plans))
    found = scratch.write(counted.mapInArrow(_best(plan, size["docs"], size["length"], k, b), "at int, doc long, score long"), "found")
    scratch.drop("counted")
    order = Window.partitionBy("at").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _count(shared):
    def run(batches):
        code_of = shared.value.get
        for batch in batches:
            ids, lengths, codes, counts, ends = [], [], [], [], [0]
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text")):
                words = terms_of(text.as_py())
                n = len(words) - words.count(b"")
                if not n:
                    continue
                known = np.fromiter(map(code_of, words, repeat(-1)), np.int32, len(words))
                code, count = np.unique(known[known >= 0], return_counts=True)
                ids.append(doc)
                lengths.append(n)
                codes.append(code)
                counts.append(count.astype(np.int32))
                ends.append(ends[-1] + len(code))
            if ids:
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(codes), pa.int32())),
                     pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(counts), pa.int32()))],
                    names=["doc", "n", "codes", "counts"])
    return run


def _frequencies(size: int):
    def run(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("codes").flatten().to_numpy(), minlength=size)
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(df[found], pa.int64())], names=["code", "df"])
    return run


def contributions(weight, code, tf, n, docs: int, length: int, b: int):
    """What each posting adds to a score; in Python integers where b * n * docs could leave 64 bits."""
    if b * int(n.max(initial=0)) * docs >= 1 << 63:
        n = n.astype(object)
    m = (100 - b + (b * n * docs) // length).astype(np.int64)
    tf = tf.astype(np.int64)
    return weight[code] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def score_block(plan: list[tuple[int, int, int]], start, rows, value, top, size: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, exact scores) of all documents of a block that can be among the k best of one item.

    `plan` holds (weight, repeats, term) with the rarest term first; postings of term t are rows[start[t]:start[t + 1]].
    """
    score = np.zeros(size, np.int64)
    has = np.zeros(size, bool)
    left = sum(q * int(top[t]) for _, q, t in plan)
    creating, held, limit = True, 0, floor
    for _, q, t in plan:
        at = slice(start[t], start[t + 1])
        where, add = rows[at], value[at] * q
        if creating and held >= k:
            partial = score[has]
            limit = max(limit, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
        if creating and left < limit:
            creating = False
        if not creating:
            known = has[where]
            where, add = where[known], add[known]
        else:
            has[where] = True
            held = int(has.sum())
        score[where] += add
        left -= q * int(top[t])
    found = np.flatnonzero(has & (score > 0))
    return found, score[found]


def _best(plan, docs: int, length: int, k: int, b: int):
    def blocks(batches):
        for batch in batches:
            ends = np.r_[0, np.cumsum(pa.compute.list_value_length(batch.column("codes")).to_numpy())]
            at = 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK_POSTINGS, "right")) - 1)
                yield batch.slice(at, to - at)
                at = to

    def run(batches):
        weight, plans = plan.value
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(plans)
        for batch in blocks(batches):
            size, doc = len(batch), batch.column("doc")
            none = doc.is_null().to_numpy(zero_copy_only=False)
            doc = doc.fill_null(0).to_numpy()
            n = batch.column("n").to_numpy()
            per_doc = pa.compute.list_value_length(batch.column("codes")).to_numpy()
            row = np.repeat(np.arange(size), per_doc)
            code, tf = batch.column("codes").flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
            by_term = np.argsort(code, kind="stable")
            row, code = row[by_term], code[by_term]
            value = contributions(weight, code, tf[by_term], n[row], docs, length, b)
            start = np.searchsorted(code, np.arange(len(weight) + 1))
            top = np.zeros(len(weight), np.int64)
            np.maximum.at(top, code, value)
            for i, item in enumerate(plans):
                score0, doc0, none0 = kept[i]
                found, score = score_block(item, start, row, value, top, size, k, int(score0[-1]) if len(score0) >= k else 0)
                score, ids, null = np.r_[score0, score], np.r_[doc0, doc[found]], np.r_[none0, none[found]]
                order = np.lexsort((ids, null, -score))[:k]
                kept[i] = score[order], ids[order], null[order]
        for i, (score, ids, null) in enumerate(kept):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i), pa.int32()), pa.array(ids, pa.int64(), mask=null),
                                                  pa.array(score, pa.int64())], names=["at", "doc", "score"])
    return run
