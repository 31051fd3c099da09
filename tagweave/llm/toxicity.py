"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learned from document labels.

A document is toxic if any of its sentences is: P = 1 - product over sentences of (1 - p). A sentence's p is a logistic
score of hashed features: its words and their stems (prefixes of 3 to 6 letters). Only documents are labelled; the
noisy-or gradient finds the sentences to blame. The fit sees a bounded sample of labelled documents, scoring is one pass
over all texts with the weights (`DIM` numbers) in the task.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import Cache, arrow_rows

DIM = 1 << 18
SENTENCE = re.compile(r"[.!?\n]+")
STEMS = range(3, 7)


def word_features(word: str) -> list[int]:
    """Hashed features of a word: its letters in lower case and their prefixes."""
    core = "".join(filter(str.isalpha, word)).lower()
    if not core:
        return []
    parts = ["=" + core] + [core[:k] for k in STEMS if len(core) >= k]
    return [zlib.crc32(p.encode()) & (DIM - 1) for p in parts]


def sentences(text: str | None) -> list[list[str]]:
    return [words for part in SENTENCE.split(text or "") if (words := part.split())]


def fit(flat: np.ndarray, per_sentence: np.ndarray, per_doc: np.ndarray, labels: np.ndarray, weights: np.ndarray,
        steps: int = 80, rate: float = 0.15, shrink: float = 2e-4, min_docs: int = 5) -> tuple[np.ndarray, float]:
    """Feature weights and bias. `flat` holds the feature ids of all sentences in a row, `per_sentence` and `per_doc` the
    number of ids of each sentence and of sentences of each document. Features of fewer than min_docs documents stay 0."""
    seen = np.zeros(DIM, np.int64)
    ends = np.cumsum(np.bincount(np.repeat(np.arange(len(per_doc)), per_doc), per_sentence, minlength=len(per_doc))).astype(int)
    for lo, hi in zip(np.r_[0, ends[:-1]], ends):
        seen[np.unique(flat[lo:hi])] += 1
    sentence = np.repeat(np.arange(len(per_sentence), dtype=np.int32), per_sentence)
    keep = (seen >= min_docs)[flat]
    flat, sentence = flat[keep], sentence[keep]
    of_doc = np.repeat(np.arange(len(per_doc)), per_doc)
    w, b = np.zeros(DIM), math.log(max(labels @ weights, 1e-9) / weights.sum() / max(1, len(per_sentence) / len(per_doc)))
    moment, second, mb, sb = np.zeros(DIM), np.zeros(DIM), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.clip(b + np.bincount(sentence, w[flat], minlength=len(per_sentence)), -30, 30)
        total = np.clip(np.bincount(of_doc, np.logaddexp(0, z), minlength=len(per_doc)), 1e-9, 500)
        outer = np.where(labels == 1, -1 / np.expm1(total), 1.0) * weights / weights.sum()
        gz = outer[of_doc] / (1 + np.exp(-z))
        g, gb = np.bincount(flat, gz[sentence], minlength=DIM), gz.sum()
        moment, second = 0.9 * moment + 0.1 * g, 0.99 * second + 0.01 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        up, low = 1 - 0.9 ** step, 1 - 0.99 ** step
        scale = rate / (np.sqrt(second / low) + 1e-5)
        w -= scale * moment / up
        w = np.sign(w) * np.maximum(np.abs(w) - scale * shrink, 0)
        b -= rate * (mb / up) / (math.sqrt(sb / low) + 1e-5)
    return w, b


def judge(w: np.ndarray, b: float, cache: Cache, text: str | None) -> tuple[float, list[float]]:
    """The document's score and its sentences' logits."""
    z = [b + sum(map(cache.__getitem__, words)) for words in sentences(text)]
    miss = sum(math.log1p(math.exp(x)) if x < 30 else x for x in z)
    return -math.expm1(-miss), z


def offending(z: list[float], p: float, threshold: float) -> list[tuple[float, int]]:
    """(minus logit, number) of the sentences to blame in a document of score p, the highest logits first."""
    bad, miss = [], 0.0
    for x, i in sorted((-x, i) for i, x in enumerate(z)):
        if x > 0 and (p < threshold or -math.expm1(-miss) >= threshold):
            break
        bad.append((x, i))
        miss += math.log1p(math.exp(-x)) if x > -30 else -x
    return bad


def bounded_sample(labelled: DataFrame, max_docs: int) -> tuple[DataFrame, dict[int, float]]:
    """About max_docs (id, toxic), up to half of them toxic, chosen by a hash of the id; and the weight of a row of each class."""
    n = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    take = {c: min(1.0, max_docs / 2 / n[c]) for c in n}
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*[F.when(F.col("toxic") == c, F.lit(s)) for c, s in take.items()], F.lit(0.0))
    return labelled.where(u < share), {c: 1 / s for c, s in take.items()}


def score(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_docs: int = 4000, threshold: float = 0.7,
          worst: int | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Toxicity of every row of `docs`: doc_id, score (0 to 1), predicted (1 from `threshold` on) and offending.

    `offending` lists all sentences (number, logit), the highest first, whose own score is 0.5 or more, and in a predicted
    document as many of the next as carry it over the threshold. `worst` cuts the list.
    Learned from at most about `max_docs` labelled documents that `learn` (a condition on the id column) admits.

    Null and empty texts have no sentences: score 0. Null labels or ids teach nothing; a document labelled twice has the
    larger label. If no document is labelled, all scores are those of the bias. Repeated rows get equal results, rows
    with a null doc_id are scored too. Other columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
             .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)))
    known = known.where(F.lit(True) if learn is None else learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample, class_weight = bounded_sample(known, max_docs)
    # The sample has at most about max_docs rows of two numbers, so it is broadcast.
    chosen = rows.join(F.broadcast(sample), "doc_id").mapInArrow(_features, "toxic int, features binary, sizes binary").toArrow()
    w, b = _fit_rows(chosen, class_weight)
    return rows.mapInArrow(_score(w, b, threshold, worst),
                           "doc_id long, score double, predicted int, offending array<struct<sentence:int,logit:double>>")


def _features(batches):
    schema = pa.schema([("toxic", pa.int32()), ("features", pa.binary()), ("sizes", pa.binary())])
    cache = Cache(word_features)

    def rows():
        for batch in batches:
            for toxic, text in zip(batch.column("toxic"), batch.column("text")):
                found = [[f for w in words for f in cache[w]] for words in sentences(text.as_py())]
                yield (toxic.as_py(), np.array([f for s in found for f in s], np.int32).tobytes(),
                       np.array([len(s) for s in found], np.int32).tobytes())
            cache.trim()

    return arrow_rows(schema, rows(), limit=256)


def _fit_rows(chosen: pa.Table, class_weight: dict[int, float]) -> tuple[np.ndarray, float]:
    labels = chosen.column("toxic").to_numpy().astype(int)
    if not len(labels):
        return np.zeros(DIM, np.float32), -10.0
    cells = {c: [np.frombuffer(x.as_py(), np.int32) for x in chosen.column(c)] for c in ("features", "sizes")}
    w, b = fit(np.concatenate(cells["features"]), np.concatenate(cells["sizes"]), np.array([len(x) for x in cells["sizes"]]),
               labels, np.array([class_weight[c] for c in labels]))
    return w.astype(np.float32), b


def _score(w: np.ndarray, b: float, threshold: float, worst: int | None):
    offence = pa.struct([("sentence", pa.int32()), ("logit", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("offending", pa.list_(offence))])

    def rows(batches):
        cache = Cache(lambda word: float(sum(w[f] for f in word_features(word))))
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                p, z = judge(w, b, cache, text.as_py())
                bad = offending(z, p, threshold)[:worst]
                yield doc.as_py(), p, int(p >= threshold), [{"sentence": i, "logit": -x} for x, i in bad]
            cache.trim()

    return lambda batches: arrow_rows(schema, rows(batches))
