"""Text quality from weak labels: heuristic labellers, expectation-maximisation, and a hashed linear scorer.

1. Heuristic labellers vote good, bad or nothing on every whole text. A document's votes are one number, its pattern.
2. The counts of the patterns (at most 3 ** labellers, whatever the number of documents) go to the driver, where
   expectation-maximisation estimates the prior and every labeller's accuracy, without any true label.
   This gives every pattern its posterior probability of good.
3. A bounded sample of documents, weighted by their posteriors, trains a logistic scorer on hashed words and word
   shapes; one pass scores all texts. The scorer also judges documents on which all labellers are silent.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import Cache, Scratch, arrow_rows

DIM = 1 << 17
BAD, GOOD, NONE = 0, 1, 2
# Each labeller votes bad outside the outer bounds of its statistic and good inside the inner ones: (outer low, inner low,
# inner high, outer high).
LABELLERS = {
    "symbols": (-1, -1, 0.05, 0.1),         # share of shown characters that are neither letters, digits nor , . '
    "capitals": (-1, -1, 0.15, 0.5),        # share of capitals among ASCII letters
    "decorated": (-1, -1, 0.05, 0.3),       # share of words that end in two symbols
    "commonest": (-1, -1, 0.12, 0.25),      # share of the commonest word, in texts of 20 words or more
    "digits": (-1, -1, 0.05, 0.2),          # share of digits
    "word_length": (2.0, 3.0, 9.0, 14.0),   # mean bytes of a word
    "echo": (-1, -1, 0.05, 0.2),            # share of words equal to the word before
    "bare_marks": (-1, -1, 0.05, 0.2),      # share of words without a letter or digit
}
_NAMES = list(LABELLERS)
_BOUNDS = np.array(list(LABELLERS.values()))
LETTER, CAPITAL, DIGIT, SPACE, MARK, SYMBOL = b"aA0 .#"
_KIND = bytearray([LETTER] * 256)  # bytes of letters beyond ASCII count as letters
for _codes, _kind in ((range(33, 127), SYMBOL), (range(97, 123), LETTER), (range(65, 91), CAPITAL), (range(48, 58), DIGIT),
                      ((32, *range(9, 14)), SPACE), (b",.'", MARK)):
    for _code in _codes:
        _KIND[_code] = _kind
_KIND = bytes(_KIND)
_DECORATED, _BARE, _RUN = re.compile(rb"##(?= |$)"), re.compile(rb"(?<![^ ])[.#]+(?![^ ])"), re.compile(rb"(.)\1*")


def statistics(text: bytes) -> list[float] | None:
    """One number per labeller; None for a text without words."""
    words, kinds = text.split(), text.translate(_KIND)
    if not words:
        return None
    n = {k: kinds.count(k) for k in (LETTER, CAPITAL, DIGIT, SPACE, SYMBOL)}
    shown, total = len(kinds) - n[SPACE], len(words)
    common = max(Counter(words).values()) / total if total >= 20 else 0.0
    return [n[SYMBOL] / shown, n[CAPITAL] / max(1, n[LETTER] + n[CAPITAL]), len(_DECORATED.findall(kinds)) / total, common,
            n[DIGIT] / shown, shown / total, sum(map(bytes.__eq__, words, words[1:])) / total, len(_BARE.findall(kinds)) / total]


def pattern(text: bytes | None) -> int:
    """The votes of all labellers as one number in base 3. A text without words is bad for all."""
    s = statistics(text or b"")
    if s is None:
        return 0
    s = np.array(s)
    low, inner_low, inner_high, high = _BOUNDS.T
    votes = np.where((s < low) | (s > high), BAD, np.where((s >= inner_low) & (s <= inner_high), GOOD, NONE))
    return int(votes @ 3 ** np.arange(len(votes)))


def votes_of(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(_NAMES)) % 3


def estimate(patterns: np.ndarray, counts: np.ndarray, steps: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """(posterior of good per pattern, prior of good, P(vote | class) as [class, labeller, vote]).

    Labellers are taken as independent given the class; what each votes on good and on bad documents, silence included, is its
    accuracy. Starts from whether any labeller votes bad.
    """
    votes, counts = votes_of(np.asarray(patterns)), np.asarray(counts, np.float64)
    post = np.where((votes == BAD).any(1), 0.2, 0.9)
    for _ in range(steps):
        by_class = np.stack([counts * (1 - post), counts * post])
        prior = (by_class[1].sum() + 1) / (counts.sum() + 2)
        table = np.stack([[by_class @ (votes[:, j] == v) for v in range(3)] for j in range(votes.shape[1])])  # [labeller, vote, class]
        table = ((table + 1) / (table.sum(1, keepdims=True) + 3)).transpose(2, 0, 1)
        ll = np.log(table)[:, np.arange(votes.shape[1]), votes].sum(2) + np.log([[1 - prior], [prior]])
        post = 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -50, 50)))
    return post, prior, table


def word_features(word: bytes) -> bytes:
    """Two hashed features: the word in lower case and its shape (kinds of bytes, runs as one)."""
    shape = _RUN.sub(rb"\1", word.translate(_KIND)) + bytes([min(2, word.translate(_KIND).count(SYMBOL))])
    return np.array([zlib.crc32(word.lower()) % (DIM // 2), DIM // 2 + zlib.crc32(shape) % (DIM // 2)], np.int32).tobytes()


def train(flat: np.ndarray, sizes: np.ndarray, target: np.ndarray, steps: int = 120, rate: float = 0.5,
          shrink: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer on mean features, for soft targets."""
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    share = (1 / np.maximum(sizes, 1))[doc]
    w, b, second, sb = np.zeros(DIM), 0.0, np.full(DIM, 1e-12), 1e-12
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(doc, w[flat] * share, minlength=len(sizes)), -40, 40)))
        error = (p - target) / len(sizes)
        g, gb = np.bincount(flat, error[doc] * share, minlength=DIM) + shrink * w, error.sum()
        second, sb = second + g * g, sb + gb * gb
        w, b = w - rate * g / np.sqrt(second), b - rate * gb / np.sqrt(sb)
    return w.astype(np.float32), float(b)


def classify(docs: DataFrame, max_docs: int = 4000, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Quality of every row: doc_id, votes (labeller to vote, 1 good and 0 bad), posterior, score and keep.

    `posterior` comes from the labellers alone, `score` is their mean with the hashed scorer, both 0 to 1; keep is
    score >= threshold. The scorer is trained on at most about `max_docs` rows chosen by a hash of text and id.

    Null, empty and blank texts count as bad for all labellers. Repeated rows get equal results; rows with a null doc_id are
    judged like others. Other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    counts = scratch.write(rows.select("text").mapInArrow(_patterns, "pattern int").groupBy("pattern").count(), "patterns").collect()
    if not counts:
        post, n = {}, 0
    else:
        found, _, _ = estimate(np.array([r["pattern"] for r in counts]), np.array([r["count"] for r in counts]))
        post, n = {r["pattern"]: float(p) for r, p in zip(counts, found)}, sum(r["count"] for r in counts)
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(u < min(1.0, max_docs / max(1, n))).select("text").mapInArrow(_features(post), "features binary, target double").toArrow()
    cells = [np.frombuffer(x.as_py(), np.int32) for x in sample.column("features")]
    w, b = (train(np.concatenate(cells), np.array([len(c) for c in cells]), sample.column("target").to_numpy())
            if cells else (np.zeros(DIM, np.float32), 0.0))
    judged = rows.mapInArrow(_judge(post, w, b), "doc_id long, pattern int, posterior double, score double")
    digit = [F.floor(F.col("pattern") / 3 ** j) % 3 for j in range(len(_NAMES))]
    votes = F.create_map(*[x for name, d in zip(_NAMES, digit) for x in (F.lit(name), F.when(d < 2, d.cast("int")))])
    return judged.select("doc_id", F.map_filter(votes, lambda k, v: v.isNotNull()).alias("votes"), "posterior", "score",
                         (F.col("score") >= threshold).alias("keep"))


def _patterns(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"pattern": pa.array([pattern(t.as_py()) for t in batch.column("text")], pa.int32())})


def _features(post: dict[int, float]):
    schema = pa.schema([("features", pa.binary()), ("target", pa.float64())])

    def rows(batches):
        cache = Cache(word_features)
        for batch in batches:
            for text in batch.column("text"):
                text = text.as_py() or b""
                yield b"".join(map(cache.__getitem__, text.split())), post[pattern(text)]
            cache.trim()

    return lambda batches: arrow_rows(schema, rows(batches), limit=256)


def _judge(post: dict[int, float], w: np.ndarray, b: float):
    schema = pa.schema([("doc_id", pa.int64()), ("pattern", pa.int32()), ("posterior", pa.float64()), ("score", pa.float64())])

    def rows(batches):
        cache = Cache(lambda word: float(w[np.frombuffer(word_features(word), np.int32)].sum()))
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                text = text.as_py() or b""
                words, votes = text.split(), pattern(text)
                # Each word has two features, so the mean over features is half the mean of the words' sums.
                z = b + sum(map(cache.__getitem__, words)) / max(1, 2 * len(words))
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40))) if words else 0.0
                yield doc.as_py(), votes, post[votes], float(post[votes] + p) / 2
            cache.trim()

    return lambda batches: arrow_rows(schema, rows(batches))
