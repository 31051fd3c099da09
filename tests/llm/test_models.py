"""Models, neighbour search and shard files: held-out accuracy, brute force, exact round trips."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import documents
from tagweave.llm import langid, nearest, quality, slots, toxicity

EN = "the of and that with house from have this water other people".split()
FR = "le la les est dans une pour avec cette maison eau qui".split()


def test_nearest_finds_neighbours(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 24))
    v[200:230] = v[7]  # copies, with ties by id
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)]
    rows += [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] * 24, 0), (903, [1.0, None], 0), (None, rows[0][1], 0),
             (904, [1.0, 2.0], 0), (100, rows[100][1], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int")
    got = {}
    for r in nearest.search(table, F.col("vec_id") % 100 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 300}
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        want = sorted((x, i) for i, x in enumerate(d) if i != q)[:10]
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 11))
        assert all(abs(d[i] - s) < 1e-12 for _, i, s in found)
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in want})
    assert hits >= 0.9 * 40
    assert [i for _, i, _ in got[200]] == [7] + list(range(201, 210))
    assert nearest.search(table.limit(0), F.lit(True)).count() == 0


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 100, 1000, 4097):
        for key in (1, 2):
            assert sorted(slots.feistel(np.arange(n), n, key).tolist()) == list(range(n))
    assert (slots.feistel(np.arange(1000), 1000, 1) != slots.feistel(np.arange(1000), 1000, 2)).any()


def test_a_text_is_encoded_at_once_and_gives_the_tokens_of_its_words(monkeypatch):
    calls = []

    class Counted:
        def encode_ordinary(self, text):
            calls.append(text)
            return slots_encoder.encode_ordinary(text)

    slots_encoder = slots.encoder(slots.TOKENIZER)
    monkeypatch.setattr(slots, "encoder", lambda path: Counted())
    tokens, rng = slots.Tokens(slots.TOKENIZER), np.random.default_rng(7)
    tokens("Never seen,\nbut encoded in one call")
    assert len(calls) == 1
    pieces = [" ", " ", "\n", "\t", "\r\n", "\x85", "\xa0", "\u3000", "\x1c", "a", "b'", "'s", "12", "é", "中", ".", "the"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces, rng.integers(1, 14)))
        words = [(" " if i else "") + w for i, w in enumerate(text.split(" "))]
        assert tokens(text) == np.array([t for w in words for t in slots_encoder.encode_ordinary(w)], "<u2").tobytes()


def test_shards_round_trip_and_resume(spark, messy, tmp_path):
    path = f"file://{tmp_path}/out"
    docs = documents(spark, messy)
    rows = slots.materialise(docs, path, seq_len=16, per_shard=50, passes=3).collect()
    n = len(rows)
    assert sorted(r.slot for r in rows) == list(range(n))
    texts, seen = {}, []
    for shard in range(-(-n // 50)):
        records = list(slots.read_shard(path, shard, 16))
        assert len(records) == min(50, n - 50 * shard)
        assert list(slots.read_shard(path, shard, 16, start=20)) == records[20:]
        seen += records
    by_slot = {r.slot: r for r in rows}
    for slot, (doc, piece, ids) in enumerate(seen):
        r = by_slot[slot]
        assert (doc, piece, len(ids) // 2) == (-(1 << 63) if r.doc_id is None else r.doc_id, r.piece, r.n_tokens)
        texts.setdefault(doc, {}).setdefault(piece, []).append(ids)
    want = Counter(d for d, t in messy if t)
    for d, t in messy:
        if t and want[d] == 1:
            parts = texts[-(1 << 63) if d is None else d]
            assert slots.decode(b"".join(parts[i][0] for i in range(len(parts)))) == t
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "shards").iterdir()}
    again = slots.materialise(docs, path, seq_len=16, per_shard=50, passes=3)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, rows))
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "shards").iterdir()} == before
    assert slots.materialise(documents(spark, []), f"file://{tmp_path}/none").count() == 0


def test_a_lost_run_is_resumed_and_another_one_refused(spark, messy, tmp_path, monkeypatch):
    docs, path = documents(spark, messy), f"file://{tmp_path}/out"
    go = dict(seq_len=16, per_shard=50, passes=3)
    whole = slots.materialise(docs, f"file://{tmp_path}/whole", **go)
    real = slots.Scratch.write

    def lost(at, marker):
        """Fail at one table, leaving some of its files without the mark of completeness."""
        def write(self, df, name, *a, **k):
            out = real(self, df, name, *a, **k)
            if name.startswith(at):
                (tmp_path / "out" / marker / "_SUCCESS").unlink()
                raise InterruptedError
            return out
        return write

    second = sorted(p.name for p in (tmp_path / "whole" / "manifest").iterdir())[1]
    for at, marker in (("tokens", "tokens"), (f"manifest/{second}", f"manifest/{second}")):
        monkeypatch.setattr(slots.Scratch, "write", lost(at, marker))
        with pytest.raises(InterruptedError):
            slots.materialise(docs, path, **go)
    monkeypatch.setattr(slots.Scratch, "write", real)
    assert Counter(map(tuple, slots.materialise(docs, path, **go).collect())) == Counter(map(tuple, whole.collect()))
    for shard in range(-(-whole.count() // 50)):
        assert list(slots.read_shard(path, shard, 16)) == list(slots.read_shard(f"file://{tmp_path}/whole", shard, 16))
    more = documents(spark, [*messy, (999, "new words")])
    for other, rows in (({"key": 2}, docs), ({"passes": 2}, docs), ({"per_shard": 60}, docs), ({"seq_len": 8}, docs), ({}, more)):
        with pytest.raises(ValueError, match="was begun with"):
            slots.materialise(rows, path, **{**go, **other})


def _talk(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_language_spans(spark):
    rng = random.Random(1)
    learn = [(i, _talk(rng, EN if i % 2 else FR, 30)) for i in range(60)]
    rows = documents(spark, learn).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("fr"))
    model = langid.fit(rows)
    mixed = _talk(rng, EN, 40) + " " + _talk(rng, FR, 25)
    asked = documents(spark, [(1, _talk(rng, FR, 20)), (2, mixed), (3, None), (4, "12 34 !"), (5, ""), (None, _talk(rng, EN, 9)),
                              (2, mixed), (6, _talk(rng, EN, 20000)), (7, "мир вода")])
    got = {r.doc_id: r for r in langid.identify(asked, model).collect()}
    assert got[1].lang_pred == "fr" and got[None].lang_pred == "en" and got[6].lang_pred == "en"
    assert [s.lang for s in got[2].spans] == ["en", "fr"] and abs(got[2].spans[0].after - 40) <= 2 and abs(got[2].score - 40 / 65) < 0.05
    assert all((got[i].lang_pred, got[i].score, got[i].spans) == ("und", 0.0, []) for i in (3, 4, 5))
    kept = langid.keep_known(asked.withColumn("lang", F.lit(None).cast("string")), model, 0.5)
    assert {r.lang for r in kept.where("doc_id = 1").collect()} == {"fr"} and kept.where("doc_id IN (3, 4, 5)").count() == 0
    empty = langid.fit(rows.limit(0))
    assert langid.identify(asked, empty).where("lang_pred <> 'und'").count() == 0


def test_best_path_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(40):
        s, penalty = rng.normal(size=(6, 3)) * 2, float(rng.uniform(0.5, 6))

        def value(path):
            return sum(s[i, p] for i, p in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))
        best = max(map(value, itertools.product(range(3), repeat=6)))
        assert abs(value(langid.best_path(s, penalty).tolist()) - best) < 1e-9


def test_toxicity_learns_and_locates(spark):
    rng = random.Random(2)
    bad = ["vile", "vilely", "vileness", "rotten", "rottenest"]

    def doc(i):
        parts = [_talk(rng, EN, 8) for _ in range(6)]
        if i % 4 == 0:
            parts[i % 6] += " " + rng.choice(bad) + " " + rng.choice(bad)
        return ". ".join(parts)
    pairs = [(i, doc(i)) for i in range(400)] + [(1000, None), (1001, ""), (None, "vile rotten vile. fine")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(400)] + [(0, 0, 1), (None, 1, 1), (5, None, 1)],
                                   "doc_id long, toxic int, text int")
    rows = {r.doc_id: r for r in toxicity.score(documents(spark, pairs), labels, F.col("doc_id") < 250).collect()}
    assert np.mean([rows[i].predicted == (i % 4 == 0) for i in range(250, 400)]) > 0.95
    found = [rows[i] for i in range(252, 400, 4) if rows[i].predicted]
    assert np.mean([r.offending[0].sentence == r.doc_id % 6 for r in found if r.offending]) > 0.9
    assert rows[1000].score == rows[1001].score == 0.0 and 0 <= rows[None].score <= 1
    none = toxicity.score(documents(spark, pairs), labels.limit(0))
    assert none.where("predicted = 1").count() == 0


def test_all_offending_sentences():
    assert [i for _, i in toxicity.offending([-9.0] + [2.0] * 10, 1.0, 0.7)] == list(range(1, 11))
    weak = [-0.5, -9.0, -0.4, -0.6, -8.0]
    p = 1 - np.prod([1 / (1 + np.exp(x)) for x in weak])
    assert p >= 0.7 and [i for _, i in toxicity.offending(weak, p, 0.7)] == [2, 0, 3]
    assert toxicity.offending([-0.5, -9.0], 0.38, 0.7) == [] == toxicity.offending([], 0.0, 0.7)


def test_clean_mixed_document_stays(spark):
    import corpus_pipeline

    rng = random.Random(7)
    third = "kaksi yksi kolme talo vesi metsä järvi kala lintu puu".split()
    learn = [(i, _talk(rng, (EN, FR, third)[i % 3], 30)) for i in range(90)] + [
        (100, " ".join([_talk(rng, EN, 45), _talk(rng, FR, 35), _talk(rng, third, 20)])), (101, "12 34"), (102, None)]
    lang = F.when(F.col("doc_id") < 90, F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("fi")), (F.col("doc_id") % 3 + 1).cast("int")))
    docs = documents(spark, learn).withColumn("lang", lang)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert kept == set(range(90)) | {100}


def test_rare_language_is_learned(spark):
    rng = random.Random(9)
    rows = documents(spark, [(i, _talk(rng, FR if i < 8 else EN, 12)) for i in range(4000)]).withColumn(
        "lang", F.when(F.col("doc_id") < 8, "fr").otherwise("en"))
    assert langid.fit(rows, max_docs=40).langs == ["en", "fr"]
    assert langid.quotas({"a": 8, "b": 4000, "c": 3000}, 40) == {"a": 8, "b": 16, "c": 16}
    assert langid.quotas({"a": 8, "b": 4}, 40) == {"a": 8, "b": 4}


def test_quality_separates_junk(spark):
    rng = random.Random(5)
    pairs = [(i, _talk(rng, EN, 60)) for i in range(150)]
    pairs += [(i, " ".join(w.upper() + "!!##" for w in _talk(rng, EN, 40).split())) for i in range(150, 180)]
    pairs += [(500, None), (501, " \n"), (None, _talk(rng, EN, 50)), (0, pairs[0][1])]
    got = [(r.doc_id, r.keep, r.posterior) for r in quality.classify(documents(spark, pairs)).collect()]
    assert len(got) == len(pairs)
    assert all(keep == (d is None or d < 150) for d, keep, _ in got)
    assert quality.classify(documents(spark, [])).count() == 0


def test_estimate_recovers_accuracies():
    rng = np.random.default_rng(6)
    truth = rng.random(20000) < 0.8
    n = len(quality.LABELLERS)
    right = np.linspace(0.75, 0.95, n)
    votes = np.where(rng.random((20000, n)) < right, truth[:, None], ~truth[:, None]).astype(int)
    patterns, counts = np.unique(votes @ 3 ** np.arange(n), return_counts=True)
    post, prior, table = quality.estimate(patterns, counts)
    assert abs(prior - 0.8) < 0.03
    assert np.abs(table[1, :, quality.GOOD] - right).max() < 0.05 and np.abs(table[0, :, quality.BAD] - right).max() < 0.08
