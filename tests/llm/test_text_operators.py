"""Operators on texts against plain brute force, on rows with nulls, blanks, copies, ties and clashing columns."""

import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import documents, words_of  # noqa: I001
from tagweave.llm import decontaminate, linejoin, neardup, packing, substring


def test_passages(spark, messy):
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest())
                  for r in substring.remove_repeats(documents(spark, messy)).collect())
    first = defaultdict(lambda: float("inf"))
    for d, t in messy:
        w = words_of(t)
        for j in range(len(w) - 12):
            if d is not None:
                first[tuple(w[j:j + 13])] = min(d, first[tuple(w[j:j + 13])])
    want = Counter()
    for d, t in messy:
        w = words_of(t)
        gone = set()
        for j in range(len(w) - 12):
            if d is not None and first[tuple(w[j:j + 13])] < d:
                gone.update(range(j, j + 13))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want[(d, len(w), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    assert got == want


def test_passages_with_hot_seeds(spark, messy, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_SEEDS", 3)
    test_passages(spark, messy)


def test_hot_seed_is_split_by_window():
    cache = substring.Cache(substring.xxhash.xxh3_64_digest)
    # A phrase of small hash, so that it is the seed of most windows over it.
    h, phrase = min((int(substring.runs_of(substring.word_codes(cache, f"five words all share {i}".encode()), 5)[0]),
                     f"five words all share {i}".split()) for i in range(500))
    shared = int(np.uint64(h).view(np.int64))
    texts = [" ".join([f"a{i}x{j}" for j in range(8)] + phrase + [f"b{i}x{j}" for j in range(8)]) for i in range(60)]
    rows = [{"doc_id": d, "text_key": d, "text": t.encode(), "seeds": [shared], "shards": [7], "parts": [4]}
            for d, t in enumerate(texts + texts[:5])]
    batch = substring.pa.RecordBatch.from_pylist(rows)
    place = defaultdict(set)
    for part in substring._segments(13)([batch]):
        for r in part.to_pylist():
            w = r["words"]
            for j in range(len(w) // 8 - 12):
                place[w[8 * j:8 * j + 104]].add(r["shard"])
    assert all(len(s) == 1 for s in place.values()) and len(set.union(*place.values())) == 4


def test_automaton_finds_first_documents():
    rng = np.random.default_rng(1)
    for window in (1, 3, 5):
        docs = [rng.integers(0, 3, rng.integers(window, 40)).tolist() for _ in range(15)]
        automaton, first = substring.Automaton(), {}
        for i, d in enumerate(docs):
            automaton.add(d, i)
            for j in range(len(d) - window + 1):
                first.setdefault(tuple(d[j:j + window]), i)
        automaton.finish(window)
        for d in docs:
            assert automaton.match(d, window) == [first[tuple(d[j:j + window])] for j in range(len(d) - window + 1)]


def _components(rows, shingle, percent):
    sets = []
    for d, t in rows:
        w = [x.lower() for x in words_of(t)]
        sets.append({tuple(w[i:i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set()))
    parent = {d: d for d, _ in rows if d is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, _) in enumerate(rows):
        for j, (e, _) in enumerate(rows[:i]):
            if d is not None and e is not None and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = top(d), top(e)
                    parent[max(a, b)] = min(a, b)
    return Counter((d, len(s), None if d is None else top(d), d is None or top(d) == d) for (d, _), s in zip(rows, sets))


def test_near_duplicates(spark, messy):
    for shingle in (2, 5):
        got = Counter(map(tuple, neardup.near_duplicates(documents(spark, messy), shingle).collect()))
        assert got == _components(messy, shingle, 80)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    b = np.union1d(a[:360], np.unique(rng.integers(0, 1 << 63, 40, dtype=np.uint64)))
    assert abs((neardup.signature(a) == neardup.signature(b)).mean() - 360 / 440) < 0.1
    one = neardup.signature(a[:1])
    assert (one == a[0]).all() and len(one) == neardup.BINS


def _lines_left(rows, percent=80):
    numbered = sorted({(d, k, p, frozenset(line.encode().split())) for d, t in rows if d is not None and t is not None
                       for k in [t] for p, line in enumerate(t.split("\n"))}, key=lambda r: (r[0], r[1], r[2]))
    return numbered


def test_similar_lines(spark, messy):
    rows = [(d, t) for d, t in messy if Counter(x for x, _ in messy)[d] == 1 or d is None or d == 10]
    got = Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in linejoin.dedup_lines(documents(spark, rows)).collect())
    lines, want = _lines_left(rows), Counter()
    for d, t in rows:
        if t is None or d is None:
            want[(d, 0 if t is None else len(t.split("\n")), 0, t)] += 1
            continue
        kept = []
        for p, line in enumerate(t.split("\n")):
            s = frozenset(line.encode().split())
            hit = s and any((e, q) < (d, p) and 100 * len(s & o) >= 80 * len(s | o) for e, _, q, o in lines if o)
            kept += [] if hit else [line]
        want[(d, len(t.split("\n")), len(t.split("\n")) - len(kept), "\n".join(kept))] += 1
    assert got == want


def test_templates_catch_changed_questions(spark):
    item = "On monday Alice Smith bought 12 red apples and 7 kg of flour before Alice Smith walked 3 miles to the old market"
    other = item.replace("Alice", "Bob").replace("Smith", "Jones").replace("12", "45").replace("7", "9").replace("3", "8")
    mixed = item.replace("Alice Smith bought", "Bob Jones bought").replace("Alice Smith walked", "Carol White walked")
    docs = documents(spark, [(1, f"Some text. {item} and more"), (2, f"{other}."), (3, mixed), (4, "nothing to see " * 20), (5, None),
                             (None, item), (6, ""), (7, " ".join(item.split()[:6])), (2, f"{other}."), (8, "word " * 9000 + item)])
    items = spark.createDataFrame([(7, item, 1), (8, None, 1), (None, item, 1), (9, "too short", 1), (7, item, 2)], "item_id long, text string, h long")
    got = {(r.doc_id, r.item_id, r.changed) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 7, False), (2, 7, True), (8, 7, False)}
    assert decontaminate.contaminated(documents(spark, []), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_templates_find_every_kind_of_item(spark):
    texts = {1: "12 plus 35 is 47 minus 8 is 39 plus 61 is 100", 2: "What is the capital of France", 3: "paris",
             4: "Who Wrote The Famous Old Novel About The Great Whale", 5: "every one of these eight words is literal",
             6: "5 kg 7 kg 9 kg", 7: "?!", 8: "", 9: "Alice met 12 men, Bob met 13 and Carol 14 there"}
    pairs = [(10 * i + odd, "lead in. " + "more " * odd + f"here: {t} . and then some other words follow")
             for i, t in texts.items() for odd in (0, 1) if i < 7 or i == 9]
    pairs += [(3, "paris"), (200, "What is the capital of Spain"), (201, "5 kg 7 kg 8 kg"), (202, "What is the capital"), (203, ""), (204, "!")]
    items = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.changed) for r in decontaminate.contaminated(documents(spark, pairs), items).collect()}
    want = {(10 * i + odd, i, False) for i in texts for odd in (0, 1) if i < 7 or i == 9} | {(3, 3, False)}
    assert {g for g in got if g[0] != 200} == want and {g for g in got if g[0] == 200} <= {(200, 2, True)}


def test_templates_find_excerpts_and_names_that_begin_sentences(spark):
    rng = random.Random(4)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(59))
    told = ("Alice has 5 apples. Every day Alice eats 2. Alice buys 3 more and gives Bob 1. Bob eats it. How many "
            "apples does Alice have after 4 days? Then Carol came.")
    other = told.replace("Alice", "Dora").replace("Bob", "Emil").replace("5", "9").replace("Carol", "Zoe")
    torn = other.replace("Dora buys", "Fritz buys")
    pairs = [(1, "x y. " + " ".join(long.split()[10:40]) + " and so on"), (2, "x y. " + " ".join(long.split()[10:22]) + " and so on"),
             (3, f"Read this. {other} Then go."), (4, f"read this {told.lower()}"), (5, torn), (6, f"so read {other}")]
    items = spark.createDataFrame([(1, long), (2, told)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.changed) for r in decontaminate.contaminated(documents(spark, pairs), items).collect()}
    assert got == {(1, 1, False), (3, 2, True), (4, 2, False), (6, 2, True)}


def test_templates_agree_over_shifts(spark):
    item = ("every monday the teacher Alice counts all of the red apples in the big garden while the teacher Alice also "
            "counts all of the green pears near the wall")
    head, tail = item.split(" while ")
    one, two = (lambda name: head.replace("Alice", name)), (lambda name: "while " + tail.replace("Alice", name))
    pairs = [(1, f"so {one('Bob')} and yet {two('Bob')} today"), (2, f"so {one('Bob')} and yet {two('Carol')} today"),
             (3, f"so {one('Bob')} x {two('Carol')} y {two('Bob')} z"), (4, f"so {item.replace('Alice', 'Bob')} and {item.replace('Alice', 'Carol')}")]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    # By coverage only: no half is as long as RUN words would need.
    old, decontaminate.RUN = decontaminate.RUN, 40
    try:
        got = {r.doc_id: (r.covered, r.changed) for r in decontaminate.contaminated(documents(spark, pairs), items).collect()}
    finally:
        decontaminate.RUN = old
    n = len(item.split())
    assert got == {1: (n, True), 3: (n, True), 4: (n, True)}


def test_templates_in_a_very_long_repeat(spark):
    items = spark.createDataFrame([(1, "again " * 30), (2, "a b c d e f g")], "item_id long, text string")
    docs = documents(spark, [(1, "again " * 20000), (2, "again " * 20), (3, "again " * 7), (4, "z a b c d e f g"), (5, "a b c d e f z g")])
    got = {(r.doc_id, r.item_id, r.covered) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1, 30), (2, 1, 30), (4, 2, 7)}


@pytest.mark.parametrize("width", range(1, 9))
def test_window_hashes_of_every_width(spark, width):
    rng = random.Random(width)
    words = [[rng.choice(["a", "b", "\x01Eve", "\x021", "\x044x", "\x04Bo", "c"]) for _ in range(rng.randrange(1, 14))] for _ in range(60)]
    rows = decontaminate.window_hashes(spark.createDataFrame(list(enumerate(words)), "i int, words array<string>"), [width], True).collect()

    def parts(w):
        code = [ord(x[0]) if x[0] < "\x04" else x.replace("\x04", "") for x in w]
        slots = sum(isinstance(c, int) for c in code)
        own = slots and width - slots < decontaminate.LITERAL
        named = [1 if x[0] == "\x04" else c for x, c in zip(w, code)]
        own = ("own", *[x.strip("\x01\x02\x03\x04") for x in w]) if own else None
        return own or tuple(code), None if named == code else own or tuple(named)

    seen = {}
    for r in rows:
        n = len(r.words)
        for j in range(n):
            first, second = parts(r.words[j:j + width]) if j + width <= n else (None, None)
            for value, h in ((first, r.windows[j]), (second, r.windows[n + j])):
                assert (value is None) == (h is None)
                assert value is None or seen.setdefault(value, h) == h
    assert len(set(seen.values())) == len(seen)


def test_best_buckets_is_optimal():
    from itertools import combinations

    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 40, 9))
        counts = rng.integers(1, 20, len(lengths))

        def padded(edges):
            return sum(c * min(e for e in edges if e >= n) for n, c in zip(lengths, counts))
        for k in (1, 2, 3, 20):
            best = min(padded(list(e) + [lengths[-1]]) for m in range(k) for e in combinations(lengths[:-1], m))
            found = packing.best_buckets(lengths, counts, k)
            assert len(found) <= k and padded(found) == best
    assert packing.best_buckets(np.array([]), np.array([]), 4) == []


def test_packing(spark, messy):
    rows = packing.pack(documents(spark, messy), buckets=3, max_len=40, budget=200).collect()
    assert sorted(map(str, {(r.doc_id) for r in rows})) == sorted(map(str, {d for d, _ in messy}))
    lengths = Counter()
    for d, t in messy:
        n = len(words_of(t))
        for p in range(max(1, -(-n // 40))):
            lengths[(d, p, p * 40, min(40, n - 40 * p))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in rows) == lengths
    places, sizes = set(), defaultdict(int)
    for r in rows:
        if not r.length:
            assert r.bucket_len is None and r.batch is None and r.place is None
            continue
        assert r.length <= r.bucket_len and r.place < max(1, 200 // r.bucket_len)
        places.add((r.bucket_len, r.batch, r.place))
        sizes[(r.bucket_len, r.batch)] += 1
    assert len(places) == sum(1 for r in rows if r.length)
    for bucket in {b for b, _ in sizes}:
        full = [sizes[(bucket, i)] for i in range(sum(b == bucket for b, _ in sizes))]
        assert all(n == max(1, 200 // bucket) for n in full[:-1])


def test_no_rows(spark):
    empty = documents(spark, [])
    assert substring.remove_repeats(empty).count() == 0
    assert neardup.near_duplicates(empty).count() == 0
    assert linejoin.dedup_lines(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert "source" in linejoin.dedup_lines(empty.select("*", F.lit(1).alias("n_lines"))).columns


def test_marks_of_a_text_with_a_long_gap(spark):
    """Trimming by a pattern took time by the square of a gap: minutes for this one."""
    gap = " " * 300_000
    texts = spark.createDataFrame([(f"\n\tAnna paid Bob 5 kg, 'Eve{gap}of 3 milesx.\x0b ",)], "text string")
    start = time.monotonic()
    (marked,), = texts.select(decontaminate.annotated(F.col("text"))).collect()
    assert marked.replace(gap, " ") == "\x04anna paid \x01bob \x025 \x03kg \x04eve of \x023 milesx"
    assert time.monotonic() - start < 20


def test_lines_store_no_rows_of_words(spark, monkeypatch):
    rng, real, stored = random.Random(8), linejoin.Scratch.write, {}
    rows = [(i, " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 9)) for _ in range(40))) for i in range(60)]
    rows += [(100 + i, t + " more") for i, t in rows[:5]]

    def write(self, df, name, *more, **options):
        out = real(self, df, name, *more, **options)
        stored[name] = out.count()
        return out

    monkeypatch.setattr(linejoin.Scratch, "write", write)
    got = {r.doc_id: r.n_removed for r in linejoin.dedup_lines(documents(spark, rows)).collect()}
    assert got == {i: int(i >= 100) for i, _ in rows}
    assert max(n for name, n in stored.items() if not name.startswith(("star", "rest"))) == len(rows)


def test_few_pairs_of_long_lines_carry_whole_sets(spark, monkeypatch):
    """64 parities tell little of long lines; the wide sets of all pairs that they let through filled the disk."""
    rng, real, stored = random.Random(4), linejoin.Scratch.write, {}
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.sample(words, 150))) for i in range(80)]
    rows += [(200 + i, t.rsplit(" ", 20)[0]) for i, t in rows[:3]]

    def write(self, df, name, *more, **options):
        out = real(self, df, name, *more, **options)
        stored[name] = out.count()
        return out

    monkeypatch.setattr(linejoin.Scratch, "write", write)
    got = {r.doc_id: r.n_removed for r in linejoin.dedup_lines(documents(spark, rows)).collect()}
    assert got == {i: int(i >= 200) for i, _ in rows}
    assert stored["star"] + stored["rest"] > 300
    assert stored.get("star_sets_near", stored["star"]) + stored.get("rest_sets_near", stored["rest"]) < 30


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_similar_lines_of_all_lengths(spark, percent):
    rng, rows = random.Random(percent), []
    for base in range(30):
        words = [rng.choice("abcdefgh") * rng.randint(1, 40) + str(rng.randint(0, 20)) for _ in range(rng.choice((1, 2, 5, 9, 10, 11, 12, 13, 20, 60, 130)))]
        for i in range(5):
            kept = [w for w in words if rng.random() > rng.choice((0.02, 0.1, 0.3))] + [f"new{rng.randint(0, 99)}"] * rng.randint(0, 1)
            rows.append((base + 100 * i, " ".join(rng.sample(kept, len(kept)))))
    sets = [(d, frozenset(t.split())) for d, t in rows]
    want = {d: int(any(e < d and s and 100 * len(s & o) >= percent * len(s | o) for e, o in sets)) for d, s in sets}
    assert {r.doc_id: r.n_removed for r in linejoin.dedup_lines(documents(spark, rows), percent).collect()} == want
    assert 0 < sum(want.values()) < len(rows)


def test_lines_keep_columns_with_clashing_names(spark):
    df = documents(spark, [(1, "one two three\nfour five six"), (2, "one two three\nother words here")])
    clash = df.withColumns({"_cut": F.lit(5), "_d": F.lit("x"), "_key": F.col("doc_id") * 2, "_KEY_": F.lit(7)})
    got = {r["doc_id"]: r for r in linejoin.dedup_lines(clash).collect()}
    assert got[1]["text"] == "one two three\nfour five six" and got[2]["text"] == "other words here"
    assert all((r["_cut"], r["_d"], r["_key"], r["_KEY_"]) == (5, "x", 2 * d, 7) for d, r in got.items())
