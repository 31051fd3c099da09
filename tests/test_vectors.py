import math

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.hashing import hash_normal, hash_uniform
from tagweave.functions.vectors import l2_normalize
from tagweave.functions.views import build_view_pairs, coordinate_mask, gaussian_noise
from tagweave.operators import blocks, contrast, features, heads, neighbors


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def brute_knn(x, k):
    d = np.round(1 - unit(x) @ unit(x).T, 9)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def frame_of(spark, x, first=0):
    return spark.createDataFrame([(i + first, [float(v) for v in r]) for i, r in enumerate(x)], "item_id long, embedding array<double>")


def neighbours(graph):
    out = {}
    for r in graph.orderBy("src", "rank").collect():
        out.setdefault(r["src"], []).append(r["dst"])
    return out


@pytest.mark.parametrize("block_rows", [1000, 32])
def test_knn_graph_exact(spark, cloud, block_rows):
    x, df = cloud
    got, want = neighbours(neighbors.knn_graph(df, 5, block_rows=block_rows)), brute_knn(x, 5)
    assert all(got[i] == want[i].tolist() for i in range(len(x)))


def test_knn_graph_clustered_and_third_of_rows_equal(spark):
    """A third of the rows are copies of one vector; the rest forms tight clusters, where the bounds do prune."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8)) * 4
    x = np.concatenate([np.tile(centres[0], (120, 1)), centres[rng.integers(0, 6, 240)] + rng.normal(size=(240, 8)) * 0.2])
    x = x[rng.permutation(len(x))]
    got, want = neighbours(neighbors.knn_graph(frame_of(spark, x), 4, block_rows=40)), brute_knn(x, 4)
    assert all(got[i] == want[i].tolist() for i in range(len(x)))


@pytest.mark.parametrize("metric", ["cosine", "dot", "sqeuclid"])
def test_knn_query_same_by_every_strategy(spark, cloud, metric):
    x, df = cloud
    queries = df.where(F.col("item_id") < 30)
    ways = [dict(), dict(small_rows=50), dict(small_rows=0, block_rows=64)]
    got = [sorted(map(tuple, neighbors.knn_query(queries, df, 3, metric, **w).collect())) for w in ways]
    assert got[0] == got[1] == got[2] and len(got[0]) == 90
    if metric != "dot":
        assert all(src == dst for src, dst, _, rank in got[0] if rank == 1)


def test_lsh_recall_on_planted(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(np.eye(8) * 6, 20, axis=0) + rng.normal(size=(160, 8)) * 0.3
    got, want = neighbours(neighbors.knn_graph_lsh(frame_of(spark, x), 5)), brute_knn(x, 5)
    assert np.mean([len(set(got.get(i, [])) & set(want[i])) / 5 for i in range(160)]) > 0.8


def test_lsh_gives_k_neighbours_of_spread_vectors(spark):
    x = np.random.default_rng(6).normal(size=(60, 48))
    got = neighbours(neighbors.knn_graph_lsh(frame_of(spark, x), 5, tables=1))
    assert all(len(set(got.get(i, [])) - {i}) == 5 for i in range(60))
    near = neighbors.knn_graph_lsh(frame_of(spark, x), 5, 0.5, tables=1)
    assert near.count() == 0


def test_queue_returns_own_row(spark, cloud):
    x, _ = cloud
    df = frame_of(spark, unit(x))
    out = neighbors.nearest_in_queue(df.where(F.col("item_id") < 10), df).collect()
    assert len(out) == 10 and all(r["item_id"] == r["nn_id"] for r in out)


def test_zero_shot(spark, cloud):
    x, df = cloud
    prompts = spark.createDataFrame([(f"p{c}", c, [float(v) for v in x[c]]) for c in range(4)],
                                    "prompt string, code int, embedding array<double>")
    got = {r["item_id"]: r["assigned"] for r in neighbors.zero_shot_assign(df.withColumn("prompt", F.lit("p1")), prompts).collect()}
    want = (unit(x) @ unit(x[:4]).T).argmax(1)
    assert all(got[i] == f"p{want[i]}" for i in range(200))


def test_hard_negative_mixes_are_unit_dots(spark, cloud):
    x, _ = cloud
    df = frame_of(spark, unit(x))
    out = neighbors.hard_negatives(df.where("item_id < 7"), df.where("item_id >= 100"), 5, 3, 2).collect()
    assert len(out) == 7 * 10 and all(abs(r["dot"]) <= 1 + 1e-9 for r in out)


def test_hash_draws(spark):
    r = spark.range(4000).select(hash_uniform("s", "id").alias("u"), hash_normal("s", "id").alias("z")).agg(
        F.avg("u"), F.avg("z"), F.stddev("z")).first()
    assert abs(r[0] - 0.5) < 0.02 and abs(r[1]) < 0.06 and abs(r[2] - 1) < 0.04


def test_pool(spark):
    x = np.random.default_rng(3).normal(size=(5, 4, 3))
    df = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(x)], "item_id long, cells array<array<double>>")
    for how, want in (("max", x.max(1)), ("average", x.mean(1)), ("flatten", x.reshape(5, -1))):
        got = np.array([r[0] for r in df.orderBy("item_id").select(features.pool("cells", how)).collect()])
        assert np.allclose(got, want)
    with pytest.raises(ValueError):
        features.pool("cells", "median")


def test_standardize_is_population(spark):
    df = frame_of(spark, np.arange(4.0).reshape(-1, 1))
    got = [r["embedding"][0] for r in features.standardize(df, df).orderBy("item_id").collect()]
    assert np.allclose(got, (np.arange(4) - 1.5) / np.std(np.arange(4)))


def test_pca_matches_svd_and_whitens(spark, cloud):
    x, df = cloud
    z = (x - x.mean(0)) / x.std(0)
    s = np.linalg.svd(z, full_matrices=False)
    got = np.array([r["embedding"] for r in features.pca_project(df, 3).orderBy("item_id").collect()])
    assert np.allclose(np.abs(got), np.abs((s[0] * s[1])[:, :3]), atol=1e-6)
    white = np.array([r["embedding"] for r in features.pca_project(df, 3, whiten=True).collect()])
    assert np.allclose(white.std(0, ddof=1), 1, atol=1e-6)
    assert len(features.pca_project(df, 99).first()["embedding"]) == 8


def test_random_projection_keeps_distances(spark):
    x = unit(np.random.default_rng(4).normal(size=(40, 64)))
    got = np.array([r["embedding"] for r in features.random_projection(frame_of(spark, x), 400, 1).orderBy("item_id").collect()]) / 20
    a, b = np.linalg.norm(x[:20] - x[20:], axis=1), np.linalg.norm(got[:20] - got[20:], axis=1)
    assert np.all(np.abs(b / a - 1) < 0.25)


def views_of(spark, z1, z2, size):
    rows = [(i // size, i, [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(z1, z2))]
    return spark.createDataFrame(rows, "batch_id long, pair_id long, z1 array<double>, z2 array<double>")


def brute_contrast(z1, z2, temp):
    """Loss and accuracy anchor by anchor: its partner against the views of all other items, in plain numbers."""
    losses, wins = [], []
    for own, across in ((z1, z2), (z2, z1)):
        for i, anchor in enumerate(own):
            partner = math.exp(float(anchor @ across[i]) / temp)
            others = [math.exp(float(anchor @ side[j]) / temp) for side in (z1, z2) for j in range(len(z1)) if j != i]
            losses.append(-math.log(partner / (partner + sum(others)) + 1e-8))
            wins.append(partner > max(others))
    return sum(losses) / len(losses), sum(wins) / len(wins)


@pytest.mark.parametrize("block_rows", [1000, 5])
def test_contrastive_report(spark, block_rows):
    rng = np.random.default_rng(6)
    z1, z2 = unit(rng.normal(size=(14, 23))), unit(rng.normal(size=(14, 23)))
    got = {r["batch_id"]: r for r in contrast.contrastive_report(views_of(spark, z1, z2, 7), 0.3, block_rows=block_rows).collect()}
    for b in (0, 1):
        loss, acc = brute_contrast(z1[b * 7:b * 7 + 7], z2[b * 7:b * 7 + 7], 0.3)
        assert abs(got[b]["loss"] - loss) < 1e-9 and abs(got[b]["accuracy"] - acc) < 1e-12
    pairs = contrast.contrast_pairs(views_of(spark, z1, z2, 7), block_rows=block_rows).collect()
    assert len(pairs) == 28 and {r["n_neg"] for r in pairs} == {12}
    same = contrast.contrastive_report(views_of(spark, z1, z1, 7), 0.3, block_rows=block_rows).collect()
    assert all(r["accuracy"] > 0.9 for r in same)


def test_one_batch_may_hold_most_rows(spark):
    """A batch far larger than a block gives the same reports as one block."""
    rng = np.random.default_rng(7)
    z1 = unit(rng.normal(size=(90, 6)))
    z2 = unit(z1 + 0.3 * rng.normal(size=(90, 6)))
    v = views_of(spark, z1, z2, 70)
    buffer = frame_of(spark, unit(rng.normal(size=(50, 6))))
    for report in (lambda b: contrast.hcl_report(v, block_rows=b), lambda b: contrast.nce_pair_report(v, block_rows=b),
                   lambda b: contrast.queue_nce_report(v, buffer, block_rows=b, small_rows=0 if b < 100 else 4096)):
        a, b = (sorted(tuple(round(float(x), 9) for x in r) for r in report(n).collect()) for n in (1000, 16))
        assert a == b


def test_uniformity_with_copies(spark):
    x = unit(np.random.default_rng(8).normal(size=(60, 5)))
    x[20:40] = x[0]
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for squared, e in ((False, d), (True, d ** 2)):
        got = contrast.uniformity(frame_of(spark, x), squared=squared, block_rows=10).first()[0]
        assert abs(got - np.log(np.exp(-2 * e).mean())) < 1e-6


def test_mmd_counts_empty_domains(spark, cloud):
    x, _ = cloud
    x = x[:17]
    dom = np.arange(17) % 3
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, dom))],
                               "item_id long, embedding array<double>, d int")
    means = np.stack([x[dom == k].sum(0) / ((dom == k).sum() + 1e-5) for k in range(4)])
    want = sum(((means[i] - means[j]) ** 2).sum() for i in range(4) for j in range(4)) / 4
    assert abs(contrast.mmd(df, "d", 4).first()[0] - want) < 1e-9


def test_variance_covariance(spark):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(40, 5)) * 0.7, rng.normal(size=(40, 5))
    got = contrast.variance_covariance(views_of(spark, a, b, 40)).first()
    cov = sum(((np.cov(z.T) ** 2).sum() - (np.diag(np.cov(z.T)) ** 2).sum()) / 5 for z in (a, b))
    std = sum(np.maximum(1 - np.sqrt(z.var(0) + 1e-4), 0).mean() for z in (a, b)) / 2
    assert np.allclose([got["invariance"], got["std_term"], got["cov_term"]], [((a - b) ** 2).mean(), std, cov])


def test_view_pairs(spark, cloud):
    _, df = cloud
    v = build_view_pairs(df, gaussian_noise(0.1), None, 64, "a")
    assert v.count() == 200 and v.agg(F.max("batch_id")).first()[0] == 3
    again = build_view_pairs(df.repartition(7), gaussian_noise(0.1), None, 64, "a")
    assert sorted(map(str, v.collect())) == sorted(map(str, again.collect()))
    r = build_view_pairs(df, gaussian_noise(0.1), coordinate_mask(1.0), 64, "a").first()
    assert r["z1"] != r["z2"] and set(r["z2"]) == {0.0}


def test_cosine_head(spark, cloud):
    x, df = cloud
    rng = np.random.default_rng(10)
    kernel, vectors = rng.normal(size=(8, 4)), rng.normal(size=(2, 2))
    got = {r["item_id"]: (r["a"], r["b"]) for r in heads.cosine_score(df, kernel, vectors, ["a", "b"]).collect()}
    p = (x @ kernel).reshape(-1, 2, 2)
    p = p / np.linalg.norm(p, axis=2, keepdims=True)
    want = 1 / (1 + np.exp(-(p * unit(vectors)[None]).sum(2)))
    assert all(np.allclose(got[i], want[i]) for i in range(200))




@pytest.fixture
def sent(monkeypatch):
    """Rows that reach the cogroups of the next calls, one number per side."""
    counts, real = [], blocks.meet

    def counted(left, right, *rest):
        counts.extend((left.count(), right.count()))
        return real(left, right, *rest)

    monkeypatch.setattr(blocks, "meet", counted)
    return counts


def test_parts_stop_growing_with_the_rows(spark):
    assert [blocks.part_count(n, 128) for n in (0, 128, 129, 10_000, 100_000, 500_000)] == [1, 1, 2, 8, 8, 8]
    assert blocks.part_count(600_000, 128) == 10
    sizes = spark.createDataFrame([(n,) for n in (1, 128, 129, 10_000, 100_000, 600_000)], "n long")
    assert [r[0] for r in sizes.select(blocks.part_count_column(F.col("n"), 128)).collect()] == [1, 1, 2, 8, 8, 10]


def test_a_large_batch_sends_a_row_to_few_parts(spark, sent):
    z1, z2 = (unit(np.random.default_rng(s).normal(size=(240, 4))) for s in (1, 2))
    got = contrast.contrastive_report(views_of(spark, z1, z2, 240), 0.3, block_rows=4).first()
    assert sent == [240 * blocks.GRID] * 2
    loss, accuracy = brute_contrast(z1, z2, 0.3)
    assert abs(got["loss"] - loss) < 1e-9 and abs(got["accuracy"] - accuracy) < 1e-12


@pytest.mark.parametrize("squared", [False, True])
def test_uniformity_sends_a_row_to_few_parts(spark, sent, squared):
    x = unit(np.random.default_rng(11).normal(size=(240, 5)))
    got = contrast.uniformity(frame_of(spark, x), squared=squared, block_rows=4).first()[0]
    assert sum(sent) <= 240 * (blocks.GRID + 1) * 1.5
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert abs(got - np.log(np.exp(-2 * (d ** 2 if squared else d)).mean())) < 1e-6


def test_queries_meet_few_parts(spark, cloud, sent):
    x, df = cloud
    got = neighbors.knn_query(df, df, 3, "dot", small_rows=0, block_rows=4)
    want = np.argsort(np.round(-(x @ x.T), 9), axis=1, kind="stable")[:, :3]
    assert neighbours(got) == {i: want[i].tolist() for i in range(200)}
    assert sent == [200 * blocks.GRID] * 2


def test_a_kernel_gets_one_tile_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(blocks, "TILE", 60)
    df = frame_of(spark, np.eye(30)).coalesce(1)

    def kernel(q_ids, q, c_ids, c):
        return {"src": [len(q_ids)], "dst": [len(c_ids)], "dist": [0.0]}

    for rows in (100, 0):
        got = blocks.pairwise(df, df, kernel, neighbors.EDGE, "item_id", "embedding", small_rows=rows, block_rows=30).collect()
        assert {r["src"] * r["dst"] for r in got} == {60} and len(got) == 15


def test_knn_graph_without_structure_sends_a_row_to_few_parts(spark, cloud, sent):
    x, df = cloud
    got, want = neighbours(neighbors.knn_graph(df, 5, block_rows=4)), brute_knn(x, 5)
    assert all(got[i] == want[i].tolist() for i in range(len(x)))
    assert len(sent) == 2 and max(sent) <= 200 * (blocks.GRID + 1)


def test_lsh_of_full_buckets_finds_what_the_join_of_all_pairs_finds(spark, sent, monkeypatch):
    """Two buckets a table, some rows copies; the buckets are cut into parts."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 10)
    x = np.random.default_rng(12).normal(size=(120, 6))
    x[30:60] = x[0]
    got = neighbors.knn_graph_lsh(frame_of(spark, x), 4, bucket_length=100.0, tables=2).select("src", "dst", "dist", "rank").collect()
    assert len(sent) == 2 and 240 < max(sent) <= 120 * 2 * neighbors.BUCKET_GRID * 2
    rows = frame_of(spark, x).select("item_id", array_to_vector(l2_normalize("embedding")).alias("x"))
    model = BucketedRandomProjectionLSH(inputCol="x", outputCol="h", bucketLength=100.0, numHashTables=2, seed=7).fit(rows)
    pairs = model.approxSimilarityJoin(rows, rows, float("inf"), "gap").select(
        F.col("datasetA.item_id").alias("src"), F.col("datasetB.item_id").alias("dst"), (F.col("gap") * F.col("gap") / 2.0).alias("dist"))
    want = neighbors.best_k(pairs.where("src <> dst"), 4).select("src", "dst", "dist", "rank").collect()
    assert len(want) == 480 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_parts_of_a_large_batch_meet_once(spark, monkeypatch):
    z1, z2 = (unit(np.random.default_rng(s).normal(size=(90, 4))) for s in (3, 4))
    keys, real = [], blocks.meet

    def seen(left, right, *rest):
        keys.extend({tuple(r) for r in df.select("mine", "theirs").distinct().collect()} for df in (left, right))
        return real(left, right, *rest)

    monkeypatch.setattr(blocks, "meet", seen)
    got = contrast.contrastive_report(views_of(spark, z1, z2, 90), 0.3, block_rows=4).first()
    parts = 2 * blocks.GRID - 1
    for met in keys:
        assert len(met) == parts * blocks.GRID and len({frozenset(pair) for pair in met}) == len(met)
    loss, accuracy = brute_contrast(z1, z2, 0.3)
    assert abs(got["loss"] - loss) < 1e-9 and abs(got["accuracy"] - accuracy) < 1e-12


def test_few_cells_get_tasks_of_their_own(spark):
    def where(a, b):
        return blocks.to_table([blocks.to_batch({"task": [TaskContext.get().partitionId()]}, schema)], schema)

    schema = T.StructType([T.StructField("task", T.LongType())])
    df = spark.range(36).select((F.col("id") % 6).alias("mine"), F.floor(F.col("id") / 6).alias("theirs"))
    tasks = [r[0] for r in blocks.meet(df, df, ["mine", "theirs"], where, schema, 36).collect()]
    assert len(tasks) == 36 and len(set(tasks)) > 20


@pytest.mark.parametrize("block_rows", [1000, 9])
def test_anchor_stats_in_plain_numbers(spark, block_rows):
    """Every column, with copies of vectors, so that ids decide, and with a wide batch next to a small one."""
    rng, temp, eps, beta = np.random.default_rng(12), 0.4, 0.1, 0.5
    z1, z2 = unit(rng.normal(size=(70, 5))), unit(rng.normal(size=(70, 5)))
    z2[20:24] = z2[11]
    z1[31] = z1[30]
    rows = {(r["pair_id"], r["view"]): r for r in contrast.anchor_stats(views_of(spark, z1, z2, 64), temp, eps, beta, block_rows).collect()}
    assert len(rows) == 140
    for (i, view), r in rows.items():
        batch = range(64) if i < 64 else range(64, 70)
        anchor, other = (z1, z2)[view][i], (z2, z1)[view]
        neg = np.array([anchor @ z[j] for z in (z1, z2) for j in batch if j != i])
        cross = np.array([anchor @ other[j] for j in batch])
        ties = np.nonzero(np.round(cross, 12) == np.round(cross, 12).max())[0]
        want = {"pos": z1[i] @ z2[i], "n_neg": len(neg), "neg_sum": np.exp((neg + eps) / temp).sum(), "neg_max": neg.max(),
                "imp_sum": np.exp(beta * neg / temp).sum(), "imp_neg": (np.exp(beta * neg / temp) * np.exp(neg / temp)).sum(),
                "cross_sum": np.exp((cross - 1) / temp).sum(), "cross_max": cross.max(), "cross_arg": batch[ties[0]]}
        assert all(abs(r[name] - value) < 1e-9 for name, value in want.items())


def test_anchor_stats_returns_what_is_wanted(spark):
    z = unit(np.random.default_rng(13).normal(size=(12, 3)))
    for block_rows in (100, 4):
        got = contrast.anchor_stats(views_of(spark, z, z, 12), 0.5, block_rows=block_rows, wanted=["neg_max"])
        assert got.columns == ["batch_id", "pair_id", "view", "pos", "n_neg", "neg_max"] and got.count() == 24


def test_anchor_sums_by_tiles(monkeypatch):
    """Ids that come twice are no negatives; tiles and the table of exp change nothing."""
    rng = np.random.default_rng(14)
    za, zb = ([unit(rng.normal(size=(n, 6))) for _ in (1, 2)] for n in (45, 31))
    ia, ib = np.arange(45), np.arange(100, 131)
    ia[40:] = ia[:5]
    whole = [contrast._anchor_sums(ia, za, *b, 0.1, 0.05, 0.5, set(contrast.ANCHOR.names)) for b in ((ib, zb), (None, None))]
    assert sorted(set(whole[1][0]["n_neg"][0])) == [86, 88] and set(whole[0][0]["n_neg"][1]) == {62}
    monkeypatch.setattr(contrast, "SIDE", 16)
    monkeypatch.setattr(contrast, "STRIP", 100)
    monkeypatch.setattr(contrast, "EXP_CELLS", 0)
    cut = [contrast._anchor_sums(ia, za, *b, 0.1, 0.05, 0.5, set(contrast.ANCHOR.names)) for b in ((ib, zb), (None, None))]
    for a, b in zip((x for sides in whole for x in sides), (x for sides in cut for x in sides)):
        assert all(np.allclose(a[name], b[name], rtol=1e-11, atol=0) for name in a)


@pytest.mark.parametrize("factor, shift", [(5.0, 0.0), (14.2857, -14.2857), (0.4, 1.0)])
def test_table_of_exp(monkeypatch, factor, shift):
    monkeypatch.setattr(contrast, "EXP_CELLS", 0)
    s = np.random.default_rng(15).uniform(-1, 1, size=(200, 250))
    s[0, :2] = -1.0, 1.0
    exp = contrast._Exp(factor, shift, 1.0, s.size)
    assert exp.table is not None and np.allclose(exp(s), np.exp(factor * s + shift), rtol=2e-12, atol=0)
    assert contrast._Exp(factor, shift, 1e6, s.size).table is None and contrast._Exp(factor, shift, np.nan, s.size).table is None
