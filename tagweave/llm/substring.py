"""Removal of passages that an earlier document holds, by suffix automata of reference shards.

1. Every window of 13 words has a seed: the smallest hash of the 5-word runs inside it. Equal windows have equal seeds.
   A seed that only one document has cannot repeat; the others carry the first document that has them.
2. A seed's shard follows from that first document (and from the seed too where a document's shard would get too large),
   so all windows with equal words meet in one shard. Neighbouring windows of one shard form a segment; equal segments are
   kept once, with the smallest doc_id. These segments are the reference text of the shard.
3. Per shard a suffix automaton over words is built, each state knowing the first document that ends there. Segments are
   streamed through it for matching statistics: at every position the longest match and, where it reaches the window
   length, the first document of the last 13 words.
4. Windows whose first document is smaller than their own document are removed, in maximal spans.

The automata are sent to the documents that share a seed with them and not to every task: the reference here is the
corpus itself, whose size has no bound. A shard holds about `SHARD_SEEDS` seed occurrences. A seed in more documents is
split by the hash of the whole window: its shards hold about SHARD_SEEDS distinct windows, if the documents have one run
of windows with that seed each (a seed that recurs in a document counts once).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import Cache, Scratch, arrow_rows

SEED_WORDS = 5
SHARD_SEEDS = 20_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_codes(cache: Cache, text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words of a text, in order."""
    words = text.split() if text else []
    return np.frombuffer(b"".join(map(cache.__getitem__, words)), ">u8").astype(np.uint64)


def runs_of(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k codes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = codes[:n] * _MIX
    for j in range(1, k):
        h = (h ^ (h >> np.uint64(29))) * _MIX + codes[j:n + j]
    return (h ^ (h >> np.uint64(32))) * _MIX


def window_seeds(codes: np.ndarray, window: int) -> np.ndarray:
    """The seed of every window."""
    low, width = runs_of(codes, SEED_WORDS), 1
    want = window - SEED_WORDS + 1
    if len(codes) < window:
        return np.zeros(0, np.int64)
    while width < want:
        step = min(width, want - width)
        low, width = np.minimum(low[:-step], low[step:]), width + step
    return low.view(np.int64)


class Automaton:
    """Suffix automaton of several word sequences; `first` is the smallest document among those a state occurs in."""

    def __init__(self):
        self.go, self.link, self.length, self.first = [{}], [-1], [0], [None]

    def _state(self, go: dict, link: int, length: int, doc: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.length.append(length)
        self.first.append(doc)
        return len(self.go) - 1

    def _split(self, p: int, c: int, q: int, doc: int) -> int:
        """A copy of q for the shorter strings that p reaches by c."""
        go, link = self.go, self.link
        copy = self._state(go[q].copy(), link[q], self.length[p] + 1, doc)
        while p >= 0 and go[p].get(c) == q:
            go[p][c] = copy
            p = link[p]
        link[q] = copy
        return copy

    def add(self, words: list[int], doc: int) -> None:
        go, link, length, first = self.go, self.link, self.length, self.first
        last = 0
        for c in words:
            q = go[last].get(c)
            if q is not None:
                if length[q] != length[last] + 1:
                    q = self._split(last, c, q, doc)
                elif doc < first[q]:
                    first[q] = doc
                last = q
                continue
            new, p = self._state({}, 0, length[last] + 1, doc), last
            while p >= 0 and c not in go[p]:
                go[p][c] = new
                p = link[p]
            if p >= 0:
                q = go[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q, doc)
            last = new

    def finish(self, window: int) -> None:
        """Spread first documents to shorter suffixes, and find for every state the one that holds its last `window` words."""
        link, length, first = self.link, self.length, self.first
        by_length = np.argsort(np.array(length), kind="stable").tolist()[1:]
        for s in reversed(by_length):
            p = link[s]
            if p > 0 and first[s] < first[p]:
                first[p] = first[s]
        self.tail = tail = [0] * len(length)
        for s in by_length:
            p = link[s]
            tail[s] = s if length[p] < window else tail[p]

    def match(self, words: list[int], window: int) -> list[int]:
        """Matching statistics, read as: the first document of each window of `words`, -1 where none has it."""
        go, link, length, first, tail = self.go, self.link, self.length, self.first, self.tail
        state, matched, out = 0, 0, []
        for c in words:
            while state and c not in go[state]:
                state = link[state]
                matched = length[state]
            if c in go[state]:
                state, matched = go[state][c], matched + 1
            out.append(first[tail[state]] if matched >= window else -1)
        return out[window - 1:]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Texts without the words that an earlier document has in the same run of `window` words.

    Returns per row of `docs`: doc_id, kept (the words left, joined by one space), n_words, n_removed and spans (removed
    word ranges, first word and word after the last). Words are runs of other than ASCII white space, unchanged. A word
    goes if a window that covers it also starts in a document with a smaller doc_id; windows are judged on the input.

    A null text has no words. Rows with a null doc_id neither remove nor lose words. Rows of one doc_id do not remove
    each other's words. Repeated rows give repeated results. Other columns are ignored; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"),
                       F.col(text_col).cast("binary").alias("text"))
    known = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")

    seeds = scratch.write(known.select("doc_id", "text").mapInArrow(_seeds(window), "seed long, doc_id long"), "seeds")
    shared = (seeds.groupBy("seed").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
              .where("first < last").select("seed", "first", _window_parts(window).alias("window_parts")))
    hits = scratch.write(seeds.join(shared, "seed"), "hits")
    scratch.drop("seeds")

    load = hits.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / SHARD_SEEDS).alias("parts"))
    n_shards = max(1, hits.count() // SHARD_SEEDS)
    large = scratch.write(load.where("parts > 1"), "large")
    shard = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("first"), F.lit(n_shards))) \
        .otherwise(n_shards + F.shiftrightunsigned(F.xxhash64("first", F.pmod(F.xxhash64("seed"), F.col("parts"))), 2))
    by_doc = (hits.join(large, "first", "left").select("doc_id", F.struct("seed", shard.cast("long").alias("shard"), "window_parts").alias("s"))
              .groupBy("doc_id").agg(F.collect_list("s").alias("s"))
              .select("doc_id", F.col("s.seed").alias("seeds"), F.col("s.shard").alias("shards"), F.col("s.window_parts").alias("parts")))
    segments = scratch.write(known.join(by_doc, "doc_id").mapInArrow(
        _segments(window), "shard long, content long, doc_id long, text_key long, start long, words binary"),
        "segments", "zstd")
    scratch.drop("hits", "large")

    contents = segments.groupBy("shard", "content").agg(F.min("doc_id").alias("doc_id"), F.first("words").alias("words"))
    judged = scratch.write(contents.groupBy("shard").applyInArrow(
        _judge(window), "shard long, content long, at array<int>, size array<int>, first array<long>"), "judged")
    earlier = F.filter(F.arrays_zip("at", "size", "first"), lambda r: r["first"] < F.col("doc_id"))
    spans = F.transform(earlier, lambda r: F.struct((F.col("start") + r["at"]).alias("lo"),
                                                    (F.col("start") + r["at"] + r["size"] + (window - 1)).alias("hi")))
    removed = scratch.write(
        segments.drop("words").join(judged, ["shard", "content"]).select("doc_id", "text_key", spans.alias("spans"))
        .where(F.size("spans") > 0).groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        .select("doc_id", "text_key", F.col("spans.lo").alias("lo"), F.col("spans.hi").alias("hi")), "removed")
    scratch.drop("segments", "judged")
    return rows.join(removed, ["doc_id", "text_key"], "left").mapInArrow(
        _cut, "doc_id long, kept string, n_words long, n_removed long, spans array<array<long>>")


def _rows(batch: pa.RecordBatch, *names: str):
    return zip(*[(x.as_py() for x in batch.column(n)) for n in names])


def _seeds(window: int):
    schema = pa.schema([("seed", pa.int64()), ("doc_id", pa.int64())])

    def run(batches):
        cache = Cache(xxhash.xxh3_64_digest)
        for batch in batches:
            seeds, docs = [], []
            for doc, text in _rows(batch, "doc_id", "text"):
                found = np.unique(window_seeds(word_codes(cache, text), window))
                seeds.append(found)
                docs.append(np.full(len(found), doc, np.int64))
            cache.trim()
            if seeds:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seeds)), pa.array(np.concatenate(docs))], schema=schema)
    return run


def _window_parts(window: int):
    """Parts of a seed of `n` documents, 1 up to SHARD_SEEDS of them. Neighbouring windows of a document share a seed."""
    windows = F.col("n") * (window - SEED_WORDS + 1)
    return F.when(F.col("n") > SHARD_SEEDS, F.ceil(windows / SHARD_SEEDS)).otherwise(1).cast("int")


def _segments(window: int):
    schema = pa.schema([("shard", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()),
                        ("start", pa.int64()), ("words", pa.binary())])

    def rows(batches):
        cache = Cache(xxhash.xxh3_64_digest)
        for batch in batches:
            for doc, key, text, seeds, shards, parts in zip(
                    *(batch.column(n) for n in ("doc_id", "text_key", "text", "seeds", "shards", "parts"))):
                codes = word_codes(cache, text.as_py())
                own = window_seeds(codes, window)
                if not len(own):
                    continue
                seeds, shards, parts = (x.values.to_numpy() for x in (seeds, shards, parts))
                order = np.argsort(seeds)
                at = np.minimum(np.searchsorted(seeds, own, sorter=order), len(seeds) - 1)
                shard = np.where(seeds[order[at]] == own, shards[order[at]], -1)
                n = np.where(shard >= 0, parts[order[at]], 1)
                if (n > 1).any():
                    part = runs_of(codes, window) % n.astype(np.uint64)
                    split = (((shard.view(np.uint64) + part * _MIX) * _MIX) >> np.uint64(2)).view(np.int64)
                    shard = np.where(n > 1, split, shard)
                cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
                for lo, hi in zip(cuts, np.r_[cuts[1:], len(shard)]):
                    if shard[lo] >= 0:
                        words = codes[lo:hi + window - 1].tobytes()
                        content = xxhash.xxh3_64_intdigest(words) - (1 << 63)
                        yield int(shard[lo]), content, doc.as_py(), key.as_py(), int(lo), words
            cache.trim()

    return lambda batches: arrow_rows(schema, rows(batches), weigh=lambda r: len(r[-1]))


def _judge(window: int):
    def run(group: pa.Table) -> pa.Table:
        docs = group.column("doc_id").to_pylist()
        codes = [np.frombuffer(w.as_py(), np.uint64) for w in group.column("words")]
        _, ids = np.unique(np.concatenate(codes), return_inverse=True)
        words = [x.tolist() for x in np.split(ids, np.cumsum([len(c) for c in codes])[:-1])]
        automaton = Automaton()
        for i in np.argsort(docs, kind="stable"):
            automaton.add(words[i], docs[i])
        automaton.finish(window)
        at, size, first = [], [], []
        for w in words:
            found = np.array(automaton.match(w, window), np.int64)
            cuts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
            at.append(cuts.astype(np.int32))
            size.append(np.diff(np.r_[cuts, len(found)]).astype(np.int32))
            first.append(found[cuts])
        return pa.table({"shard": group.column("shard"), "content": group.column("content"),
                         "at": pa.array(at, pa.list_(pa.int32())), "size": pa.array(size, pa.list_(pa.int32())),
                         "first": pa.array(first, pa.list_(pa.int64()))})
    return run


def _cut(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("spans", pa.list_(pa.list_(pa.int64())))])

    def rows():
        for batch in batches:
            for doc, text, lo, hi in _rows(batch, "doc_id", "text", "lo", "hi"):
                words, spans = text.split() if text else [], []
                for a, b in sorted(zip(lo or (), hi or ())):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(b, spans[-1][1])
                    else:
                        spans.append([a, b])
                kept, at = [], 0
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                yield doc, b" ".join(kept).decode("utf-8", "replace"), len(words), len(words) - len(kept), spans

    return arrow_rows(schema, rows(), weigh=lambda r: len(r[1]))
