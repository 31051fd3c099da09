"""Tile join, part codes and lexical ranking against plain brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from conftest_llm import documents, words_of  # noqa: I001
from tagweave.llm import lexical, partcodes, queries, tilejoin


def shingles(text, k):
    w = [bytes(x).lower() for x in words_of(text)]
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_links(pairs, k, percent=80):
    """(doc_id, n_shingles, n_links, component_id) of every row."""
    sets = [shingles(t, k) for _, t in pairs]
    low = {d: d for d, _ in pairs if d is not None}

    def top(x):
        while low[x] != x:
            x = low[x]
        return x

    links = [0] * len(pairs)
    for i, (d, _) in enumerate(pairs):
        for j, (e, _) in enumerate(pairs):
            if i != j and d is not None and e is not None and sets[i] and sets[j]:
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    links[i] += 1
                    a, b = top(d), top(e)
                    low[max(a, b)] = min(a, b)
    return Counter((d, len(s), n, None if d is None else top(d)) for (d, _), s, n in zip(pairs, sets, links))


@pytest.mark.parametrize("rows, shingles_", [(tilejoin.BLOCK_ROWS, tilejoin.BLOCK_SHINGLES), (3, 10**9), (10**9, 200)])
def test_tile_join(spark, messy, monkeypatch, rows, shingles_):
    """Also where clouds are cut into many blocks and bands."""
    monkeypatch.setattr(tilejoin, "BLOCK_ROWS", rows)
    monkeypatch.setattr(tilejoin, "BLOCK_SHINGLES", shingles_)
    got = tilejoin.jaccard_join(documents(spark, messy)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in got) == brute_links(messy, 5)


@pytest.mark.parametrize("common", [64, 3])
def test_tile_join_of_common_passages(spark, monkeypatch, common):
    """A passage in every document, so that common shingles come last in the order; many links and near misses."""
    monkeypatch.setattr(tilejoin, "COMMON", common)
    rng = random.Random(4)
    word = [f"w{i}" for i in range(40)]
    passage = [rng.choice(word) for _ in range(30)]
    pairs = []
    for d in range(80):
        own = [rng.choice(word) for _ in range(rng.randint(0, 12))]
        text = list(passage)
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(30)] = rng.choice(word)
        pairs.append((d, " ".join(text + own)))
    df = documents(spark, pairs).repartition(6)
    got = tilejoin.jaccard_join(df, shingle_words=2, percent=70).collect()
    assert Counter((r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in got) == brute_links(pairs, 2, 70)


def test_tile_join_of_nothing(spark):
    assert tilejoin.jaccard_join(documents(spark, [])).collect() == []
    got = tilejoin.jaccard_join(documents(spark, [(1, None), (2, ""), (None, "a b")])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.n_links, r.component_id) for r in got) == [(0, 1, 0, None), (1, 0, 0, 1), (2, 0, 0, 2)]


def test_linked_sets_share_a_leading_shingle():
    rng = np.random.default_rng(2)
    seen = 0
    for _ in range(3000):
        base = rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)
        a, b = np.unique(base), np.unique(np.r_[base[rng.random(len(base)) < 0.95], rng.integers(0, 60, 2)].astype(np.uint64))
        common = np.unique(rng.integers(0, 60, 10).astype(np.uint64))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            seen += 1
            (a0, a1), (b0, b1) = tilejoin.leading_shingles(a, 80, common), tilejoin.leading_shingles(b, 80, common)
            assert len(np.intersect1d(a0, b0)) + len(np.intersect1d(a1, b1))
    assert seen > 200


def test_bitmaps_never_lose_a_link():
    """Sets far larger than the bitmap fill it; the bound must then let everything through."""
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**62, 3000))
    sets = [np.sort(np.r_[base[i * 40:], rng.integers(0, 2**62, i * 30)]) for i in range(12)]
    tilejoin_bits, tilejoin.MAX_BITS = tilejoin.MAX_BITS, 256
    try:
        n_links, _ = tilejoin.compare_sets(sets, None, np.ones(12, np.int64), 80)
    finally:
        tilejoin.MAX_BITS = tilejoin_bits
    want = [sum(100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for b in sets) - 1 for a in sets]
    assert n_links.tolist() == want


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """rows: (id, label, list of floats), all usable, sorted by id."""
    x = np.array([[math.floor(1024 * v) for v in r[2]] for r in rows], dtype=object)
    d = x.shape[1] // parts
    books = [[list(r[p * d:(p + 1) * d]) for r in x[:entries]] for p in range(parts)]
    for at in range(rounds + 1):
        codes, errors = [], []
        for r in x:
            dist = [[sum((a - b) ** 2 for a, b in zip(r[p * d:(p + 1) * d], c)) for c in books[p]] for p in range(parts)]
            codes.append([min(range(len(q)), key=lambda e: (q[e], e)) for q in dist])
            errors.append(sum(min(q) for q in dist))
        if at < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [r[p * d:(p + 1) * d] for r, c in zip(x, codes) if c[p] == e]
                    if mine:
                        books[p][e] = [sum(m) // len(mine) for m in zip(*mine)]
    total = defaultdict(int)
    for r, e in zip(rows, errors):
        total[r[1]] += e
    return [(r[0], "".join(f"{i:02x}" for i in c), e, total[r[1]]) for r, c, e in zip(rows, codes, errors)], books


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "x", 2.0) for i, lab, v in rows],
                                 "vec_id long, embedding array<double>, label int, id long, v string, error double")


def test_part_codes(spark):
    rng = random.Random(8)
    good = [(i * 3, rng.choice([None, 1, 2]), [rng.choice([-0.5, 0.001, 0.2]) + rng.gauss(0, 0.1 * (i % 3)) for _ in range(8)]) for i in range(70)]
    good += [(300, 1, [0.0] * 8), (301, 1, [0.0] * 8), (302, None, [-0.0001] * 8), (303, 2, [3e4, -3e4] * 4)]
    bad = [(400, 1, None), (401, 1, []), (402, 1, [1.0] * 7), (403, 1, [1.0] * 12), (404, 2, [float("nan")] + [0.0] * 7),
           (405, 2, [float("-inf")] + [0.0] * 7), (406, None, [None] + [0.0] * 7)]
    for entries in (256, 10):
        out, books = partcodes.encode_parts(embeddings(spark, good + bad).repartition(5), entries=entries)
        want, want_books = brute_codes(good, entries=entries)
        assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in out.collect()) == want
        assert [b.tolist() for b in books] == want_books


def test_part_codes_of_rows_with_one_id_and_null_ids(spark):
    rows = [(None, 1, [0.5, 0.25]), (7, 1, [0.1, 0.3]), (7, 1, [0.1, 0.2]), (7, 1, [0.1, 0.3])]
    out, books = partcodes.encode_parts(embeddings(spark, rows), parts=2, entries=2, rounds=0)
    assert [b.tolist() for b in books] == [[[102], [102]], [[204], [307]]]
    assert sorted((r.vec_id or 0, r.code) for r in out.collect()) == [(0, "0001"), (7, "0000"), (7, "0001"), (7, "0001")]


def test_part_codes_of_huge_components_and_of_nothing(spark):
    rows = [(1, 1, [1e300, 0.0]), (2, 1, [-1e300, 0.0]), (3, 1, [2e30, 1.0])]
    out, _ = partcodes.encode_parts(embeddings(spark, rows), parts=1, entries=2, rounds=0)
    assert sorted((r.vec_id, r.code, r.error) for r in out.collect()) == [(1, "00", 0), (2, "01", 0), (3, "00", 1024 ** 2)]
    for empty in ([], [(1, 1, None)]):
        out, books = partcodes.encode_parts(embeddings(spark, empty))
        assert out.collect() == [] and books == []


def test_equal_average_search_is_exact():
    rng = np.random.default_rng(0)
    for spread, m in ((2, 40), (300, 200), (2**40, 30), (1, 1)):
        x, book = rng.integers(-spread, spread + 1, (300, 4)), rng.integers(-spread, spread + 1, (m, 4))
        dist = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(2)
        index, best = partcodes.nearest_entries(x, book)
        assert index.tolist() == [min(range(m), key=lambda e: (q[e], e)) for q in dist.tolist()]
        assert [int(b) for b in best] == [min(q) for q in dist.tolist()]


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranks(pairs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in pairs]
    held = [(d, c) for d, c in held if c]
    n_docs, length, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    want = []
    for item, text in items:
        scores = []
        for d, c in held:
            n = sum(c.values())
            m = 25 + 75 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in terms(text) if t in c)
            scores.append((-score, d is None, d or 0, d, score))
        want += [(item, r + 1, s[3], s[4]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k]) if s[4] > 0]
    return Counter(want)


ITEMS = [(1, "ban kon MIST, ban!"), (2, None), (3, "zzz"), (4, "Zwei WÖRTER 中文 one"), (5, ""), (None, "tie"), (1, "b a"), (6, "ban " * 50)]


def items_table(spark, items, rng_items=()):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, at int, doc_id long")


@pytest.mark.parametrize("postings, group", [(lexical.BLOCK_POSTINGS, lexical.GROUP_TERMS), (40, lexical.GROUP_TERMS), (40, 5)])
def test_ranked_documents(spark, messy, monkeypatch, postings, group):
    """Also in small blocks, where the best of earlier blocks stop new accumulators, and in groups of items."""
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(lexical, "GROUP_TERMS", group)
    items = ITEMS + [(100 + i, " ".join((messy[i][1] or "").split()[:15])) for i in range(0, 30, 3)]
    for k in (10, 1):
        got = lexical.rank_documents(documents(spark, messy).repartition(3), items_table(spark, items), k=k).collect()
        assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == brute_ranks(messy, items, k)


def test_accumulators_stop_and_results_stay(spark):
    """One rare term decides; documents with only common terms need no accumulator."""
    start, rows = np.array([0, 3, 13]), np.r_[[0, 1, 2], np.arange(10)]
    value, top = np.r_[[900, 800, 700], np.full(10, 5)].astype(np.int64), np.array([900, 5])
    found, score = lexical.score_block([(9, 1, 0), (1, 1, 1)], start, rows, value, top, 10, 3, 0)
    assert found.tolist() == [0, 1, 2] and score.tolist() == [905, 805, 705]
    found, _ = lexical.score_block([(9, 1, 0), (1, 1, 1)], start, rows, value, top, 10, 4, 0)
    assert len(found) == 10


def test_ranking_of_nothing(spark):
    assert lexical.rank_documents(documents(spark, []), items_table(spark, ITEMS)).collect() == []
    empty = lexical.rank_documents(documents(spark, [(1, "a b")]), items_table(spark, []))
    assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.collect() == []
    assert lexical.rank_documents(documents(spark, [(1, None), (2, "?!")]), items_table(spark, ITEMS)).collect() == []


def test_registered_queries_against_their_sql(spark):
    """The thin queries on the smallest given tables."""
    import duckdb
    from tagweave.llm.registry import ORACLES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name in ("op5_passage_repeats", "op6_minhash_groups", "op11_jaccard_tiles", "op12_part_codes", "op13_ranked_documents"):
        df = getattr(queries, name)(spark, sf)
        cols = sorted(df.columns)
        want = con.sql(ORACLES[name])
        assert sorted(want.columns) == cols
        assert Counter(map(tuple, df.select(cols).collect())) == Counter(want.select(", ".join(cols)).fetchall())
