"""Language identification of mixed-language text.

A word's script (by ranges of code points) narrows the candidate languages to those that use it. Within them the word is
scored by hashed character n-grams of 1 to 3 letters and the whole word. The best sequence of languages over the words of
a text, with a penalty for every switch, is found by Viterbi's method; equal neighbours form spans. Fitted on a bounded
sample of labelled texts: at most `GRAMS` + scripts counts per language go to the driver.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import arrow_rows

GRAMS = 1 << 16
CAP = 8.0
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
# The main ranges of code points of some scripts, as (first, last, script).
SCRIPTS = [
    (0x0041, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"),
    (0x0B80, 0x0BFF, "tamil"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"),
    (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x3040, 0x30FF, "kana"), (0x3400, 0x4DBF, "han"),
    (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"),
]
_STARTS = np.array([r[0] for r in SCRIPTS])
NAMES = sorted({r[2] for r in SCRIPTS}) + ["other"]


_SCRIPT_NO = np.array([NAMES.index(r[2]) for r in SCRIPTS])
_LAST = np.array([r[1] for r in SCRIPTS])
_MARKS = ".,;:!?\"'()[]{}|*#$%&-"


def letters(word: str) -> str:
    """The letters of a word in lower case."""
    bare = word.strip(_MARKS)
    return (bare if bare.isalpha() else "".join(filter(str.isalpha, word))).lower()


def scripts_of(codes: np.ndarray) -> np.ndarray:
    """Numbers in NAMES of the scripts of code points."""
    at = np.searchsorted(_STARTS, codes, side="right") - 1
    inside = (at >= 0) & (codes <= _LAST[at])
    return np.where(inside, _SCRIPT_NO[at], len(NAMES) - 1)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, number of its word, script per word) of words of letters, for all words at once.

    Grams are hashes of 1 to 3 neighbouring characters of the word between edge marks, and of the whole word.
    """
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))  # characters from here to the end of the word
    h, out, of = np.zeros(len(codes), np.uint64), [], []
    for k in (1, 2, 3):
        h = (h[:len(codes) - k + 1] + codes[k - 1:] + np.uint64(k)) * _A
        h ^= h >> np.uint64(29)
        inside = left[:len(h)] >= k
        out.append(h[inside])
        of.append(word[:len(h)][inside])
    start = np.cumsum(size) - size
    place = (np.arange(len(codes)) - start[word]).astype(np.uint64) + np.uint64(7)
    mixed = (codes + place * _B) * _A
    out.append(np.add.reduceat((mixed ^ (mixed >> np.uint64(31))) * _B, start))
    of.append(np.arange(len(words)))
    grams = ((np.concatenate(out) * _B) >> np.uint64(48)).astype(np.int64) & (GRAMS - 1)
    return grams, np.concatenate(of), scripts_of(codes[start + 1].astype(np.int64))


class Model:
    """Log probabilities of n-grams and the scripts of every language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        if langs:
            g, s = counts[:, :GRAMS], counts[:, GRAMS:]
            self.log = np.log((g + 0.1) / (g.sum(1, keepdims=True) + 0.1 * GRAMS))
            self.uses = s >= 0.005 * s.sum(1, keepdims=True).clip(1)

    def words(self, words: list[str]) -> list[bytes]:
        """Per word its scores by language, 0 for the best and at least -CAP, and a flag; all 0 for a word without letters."""
        table = np.zeros((len(words), len(self.langs) + 1), np.float32)
        cores = [letters(w) for w in words]
        have = [i for i, c in enumerate(cores) if c]
        if have and self.langs:
            gram, of, script = grams([cores[i] for i in have])
            ll = np.stack([np.bincount(of, row[gram], minlength=len(have)) for row in self.log], axis=1)
            able = self.uses[:, script].T
            ll = np.where(able | ~able.any(1, keepdims=True), ll, -np.inf)
            table[have, :-1] = np.maximum(ll - ll.max(1, keepdims=True), -CAP)
            table[have, -1] = 1
        return [row.tobytes() for row in table]


class Scores(dict):
    """Remembered scores of words; `learn` adds those of some texts and forgets all others when there are too many."""

    def __init__(self, model: Model, limit: int = 300_000):
        super().__init__()
        self.model, self.limit = model, limit

    def learn(self, texts: list[list[str]]) -> None:
        if len(self) > self.limit:
            self.clear()
        new = list(set().union(*texts) - self.keys())
        self.update(zip(new, self.model.words(new)))


def labelled(model: Model, known: Scores, texts: pa.Array, penalty: float):
    """label_text of every text of an Arrow column, some texts at a time."""
    for at in range(0, len(texts), 128):
        words = [(t.as_py() or "").split() for t in texts[at:at + 128]]
        known.learn(words)
        for w in words:
            yield label_text(model, known, w, penalty)


def best_path(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word that maximises the sum of scores less `penalty` a switch.

    If no stretch of words gains more than half a penalty over the best single language, no path with switches can
    win, and the search is skipped.
    """
    n, k = scores.shape
    single = int(np.argmax(scores.sum(0)))
    gain = np.vstack([np.zeros((1, k)), np.cumsum(scores - scores[:, [single]], axis=0)])
    if n == 0 or (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty / 2:
        return np.full(n, single)
    back, value, langs = [], [0.0] * k, range(k)
    for row in scores.tolist():
        top = max(langs, key=value.__getitem__)
        switch = value[top] - penalty
        back.append([l if value[l] >= switch else top for l in langs])
        value = [(value[l] if value[l] >= switch else switch) + row[l] for l in langs]
    state = max(langs, key=value.__getitem__)
    path = [state]
    for choice in reversed(back[1:]):
        state = choice[state]
        path.append(state)
    return np.array(path[::-1])


def quotas(n: dict[str, int], total: int) -> dict[str, float]:
    """Rows to take of each language, all of the small ones and equal parts of the others, `total` at most."""
    out, left = {}, total
    for done, lang in enumerate(sorted(n, key=lambda x: (n[x], x))):
        out[lang] = min(float(n[lang]), left / (len(n) - done))
        left -= out[lang]
    return out


def fit(docs: DataFrame, learn: Column | None = None, max_docs: int = 20_000, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Model:
    """Learn from at most about `max_docs` rows with text and language that `learn` admits, chosen by a hash of the id.

    Languages have equal parts of max_docs, and what one does not need goes to the others. Scores are by language, so the
    parts need no weights.
    """
    able = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.lit(True) if learn is None else learn))
    n = {r[0]: r["count"] for r in able.groupBy(lang_col).count().collect()}
    shares = [(lang, quota / n[lang]) for lang, quota in quotas(n, max_docs).items()]
    share = F.element_at(F.create_map(*[F.lit(x) for pair in shares for x in pair]), F.col(lang_col)) if shares else F.lit(0.0)
    u = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / float(1 << 30)
    rows = able.where(u < share).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counted = rows.mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counted.column("lang").to_pylist()))
    counts = np.zeros((len(langs), GRAMS + len(NAMES)))
    at = {x: i for i, x in enumerate(langs)}
    counts[[at[x] for x in counted.column("lang").to_pylist()], counted.column("gram").to_numpy()] = counted.column("n").to_numpy()
    return Model(langs, counts)


def identify(docs: DataFrame, model: Model, penalty: float = 24.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every row: doc_id, lang_pred, score and spans (lang, first word, word after the last).

    lang_pred has the most words with letters in the spans (of several, the first by name); score is its share of them.
    A null text, a text without letters, or a model without languages gives `und`, score 0 and no spans. Rows with a null
    doc_id are labelled too, repeated rows alike. Other columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_identify(model, penalty), "doc_id long, lang_pred string, score double, "
                                                      "spans array<struct<lang:string,first:int,after:int>>")


def keep_known(docs: DataFrame, model: Model, min_score: float = 0.0, penalty: float = 24.0, text_col: str = "text",
               lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` with a language of at least `min_score`, which is a share of words and no confidence: by default
    documents of several languages stay. A null language is filled with the one found.

    Rows pass through one scan with all their columns. Null texts and texts without letters go.
    """
    at_text, at_lang = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches):
        known = Scores(model)
        for batch in batches:
            found = [x[:2] for x in labelled(model, known, batch.column(at_text), penalty)]
            keep = pa.array([lang != "und" and score >= min_score for lang, score in found], pa.bool_())
            langs = pa.array([old.as_py() if old.is_valid else new for old, (new, _) in zip(batch.column(at_lang), found)],
                             batch.schema.field(at_lang).type)
            columns = batch.columns
            columns[at_lang] = langs
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(keep)

    return docs.mapInArrow(run, docs.schema)


def label_text(model: Model, known: Scores, words: list[str], penalty: float) -> tuple[str, float, list[dict]]:
    k = len(model.langs)
    table = np.frombuffer(b"".join(map(known.__getitem__, words)), np.float32).reshape(-1, k + 1) if k else np.zeros((0, 1))
    lettered = table[:, k] > 0
    if not lettered.any():
        return "und", 0.0, []
    path = best_path(table[:, :k].astype(np.float64), penalty)
    counts = np.bincount(path[lettered], minlength=k)
    cuts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
    spans = [{"lang": model.langs[path[a]], "first": int(a), "after": int(b)} for a, b in zip(cuts, np.r_[cuts[1:], len(path)])]
    return model.langs[int(counts.argmax())], float(counts.max() / counts.sum()), spans


def _count(batches):
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int32()), ("n", pa.int64())])
    words: dict[str, Counter] = {}
    totals: dict[str, np.ndarray] = {}

    def settle() -> None:
        for lang, counter in words.items():
            cores: Counter = Counter()
            for word, n in counter.items():
                if core := letters(word):
                    cores[core] += n
            if cores:
                n = np.array(list(cores.values()), np.float64)
                gram, of, script = grams(list(cores))
                to = totals.setdefault(lang, np.zeros(GRAMS + len(NAMES), np.int64))
                to += np.r_[np.bincount(gram, n[of], minlength=GRAMS), np.bincount(script, n, minlength=len(NAMES))].astype(np.int64)
        words.clear()

    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang")):
            words.setdefault(lang.as_py(), Counter()).update(text.as_py().split())
        settle()
    for lang, to in totals.items():
        used = np.flatnonzero(to)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used.astype(np.int32)), pa.array(to[used])], schema=schema)


def _identify(model: Model, penalty: float):
    span = pa.struct([("lang", pa.string()), ("first", pa.int32()), ("after", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])

    def rows(batches):
        known = Scores(model)
        for batch in batches:
            for doc, found in zip(batch.column("doc_id"), labelled(model, known, batch.column("text"), penalty)):
                yield doc.as_py(), *found

    return lambda batches: arrow_rows(schema, rows(batches))
