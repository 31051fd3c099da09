import numpy as np
import pytest
from row_helpers import ids
from pyspark.sql import functions as F

from tagweave.functions.scoring import shannon_entropy
from tagweave.operators import diversity, filters, ranking, sample, select


@pytest.mark.parametrize("sort", ["random", "max entropy", "maxent: foo", "highest: foo", "lowest: foo", "high: foo", "low: foo"])
def test_pick_sizes(half, sort):
    labels, preds = half
    assert select.pick(labels, preds, 10, "unlabeled", sort_by=sort).count() == 10
    assert select.pick(labels, preds, 100, "unlabeled", sort_by=sort).count() == (49 if sort == "low: foo" else 50)


def test_pick_order(half):
    labels, preds = half
    assert ids(select.pick(labels, preds, 3, sort_by="highest: foo")) == [97, 98, 99]
    assert ids(select.pick(labels, preds, 3, sort_by="lowest: foo")) == [50, 51, 52]
    with pytest.raises(ValueError):
        select.pick(labels, preds, 3, sort_by="newest")


def test_entropy_exact(spark):
    r = spark.createDataFrame([(0.5, 0.5)], "a double, b double").select(
        shannon_entropy(["a", "b"], "sum").alias("s"), shannon_entropy(["a", "b"]).alias("m")).first()
    assert (r["s"], r["m"]) == (2.0, 1.0)
    with pytest.raises(ValueError):
        shannon_entropy(["a"], "mean")


def test_hash_index_is_dense_and_ignores_bucket_number(spark):
    df = spark.range(1000).select(F.col("id").alias("item_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise("b").alias("g"))
    one = sorted(map(tuple, ranking.hash_index(df, "item_id", ["g"], buckets=4).collect()))
    assert one == sorted(map(tuple, ranking.hash_index(df, "item_id", ["g"], buckets=999).collect()))
    for g in ("hot", "b"):
        n = [r[2] for r in one if r[1] == g]
        assert sorted(n) == list(range(len(n)))


def test_running_total_matches_cumsum(spark):
    rng = np.random.default_rng(0)
    rows = [("hot" if i % 4 else "b", i, int(v)) for i, v in enumerate(rng.integers(0, 9, 500))]
    df = spark.createDataFrame(rows, "g string, k long, x long")
    got = {(r["g"], r["k"]): r["t"] for r in ranking.running_total(df, ["k"], {"x": "t"}, ["g"]).collect()}
    seen = {"hot": 0, "b": 0}
    for g, k, x in rows:
        assert got[(g, k)] == seen[g]
        seen[g] += x


@pytest.mark.parametrize("mode", ["class", "instance", "squareroot"])
def test_stratified_sample(spark, mode):
    df = spark.range(300).select(F.col("id").alias("item_id"), (F.col("id") % 10 == 0).alias("exclude"), F.lit(False).alias("validation"),
                                 F.when(F.col("id") < 200, 0.0).when(F.col("id") < 220, 1.0).alias("foo"))
    out = sample.stratified_sample(df, 3000, mode).collect()
    assert len(out) == 3000 and all(r["item_id"] < 220 and r["item_id"] % 10 for r in out)
    share = np.mean([r["value"] for r in out])
    want = {"class": 0.5, "instance": 18 / 198, "squareroot": 18 ** 0.5 / (18 ** 0.5 + 180 ** 0.5)}[mode]
    assert abs(share - want) < 0.04
    weights = sample.sampling_weights(df, mode).agg(F.sum("weight")).first()[0]
    assert abs(weights - 1) < 1e-9
    with pytest.raises(ValueError):
        sample.stratified_sample(df, 3, "other")


def test_subset_sample(spark):
    df = spark.range(100).select(F.col("id").alias("item_id"), F.lit(False).alias("exclude"), F.lit(False).alias("validation"),
                                 F.when(F.col("id") < 90, "big").otherwise("small").alias("subset"), F.lit(1.0).alias("foo"))
    out = sample.subset_sample(df, 2000).collect()
    assert len(out) == 2000 and abs(np.mean([r["subset"] == "big" for r in out]) - 0.5) < 0.05
    with pytest.raises(ValueError):
        sample.subset_sample(df.drop("subset"), 3)


def test_unlabeled_and_tag_batches(spark, half):
    labels, _ = half
    assert min(ids(sample.unlabeled_sample(labels, 101))) >= 50
    assert len(set(ids(sample.tag_batch(labels, "foo")))) == 9
    stratified = sample.tag_batch(labels.withColumn("subset", F.when(F.col("item_id") < 60, "a").otherwise("b")), "foo", "stratified")
    assert stratified.count() == 9 and min(ids(stratified)) >= 50


def test_cluster_stratified_mean(spark):
    a = spark.createDataFrame([(i, 1 if i == 0 else 0) for i in range(10)], "item_id long, cluster int")
    out = sample.cluster_stratified(a, 1).collect()
    assert len(out) == 10 and np.mean([r["cluster"] for r in out]) == 0.5


def test_missingness(spark):
    df = spark.createDataFrame([(i, "x" if i < 10 else None, "y") for i in range(100)], "item_id long, a string, b string")
    w = {r["item_id"]: r["weight"] for r in sample.missingness_weights(df, ["a", "b"]).collect()}
    assert abs(w[0] - (1 / 20 + 1 / 200)) < 1e-12 and abs(w[50] - 1 / 200) < 1e-12
    out = sample.missingness_sample(df, ["a", "b"], 2000).collect()
    assert abs(np.mean([r["item_id"] < 10 for r in out]) - 0.55) < 0.05


def test_noise(spark):
    df = spark.range(200).select(F.col("id").alias("item_id"), (F.col("id") % 2).cast("double").alias("y"))
    flipped = [sum(a["y"] != b["y"] for a, b in zip(df.orderBy("item_id").collect(),
               sample.add_label_noise(df, ["y"], rate).orderBy("item_id").collect())) for rate in (0.0, 0.5, 1.0)]
    assert flipped[0] == 0 and flipped[2] == 200 and 60 < flipped[1] < 140


def test_domains_disjoint(spark):
    df = spark.range(100).select(F.col("id").alias("item_id"), (F.col("id") % 3).cast("string").alias("subset"))
    out = sample.split_domains(df).collect()
    test = {r["subset"] for r in out if r["is_test"]}
    assert len(test) == 1 and len(out) == 100 and test.isdisjoint({r["subset"] for r in out if not r["is_test"]})


def test_latest_and_zip(spark, half):
    q = spark.range(100).withColumnRenamed("id", "seq")
    assert ids(select.latest_k(q, 10, "seq"), "seq") == list(range(90, 100))
    labels, _ = half
    z = sample.zip_labeled_unlabeled(labels.where("foo is not null"), labels.where("foo is null"), 8, 2).collect()
    assert {r["batch_no"] for r in z} == {0, 1, 2, 3}



def test_kpp(cloud, spark):
    x, df = cloud
    taken = df.where(F.col("item_id") < 150)
    got = ids(diversity.kpp_sample(df, 20, unavailable=taken))
    assert len(got) == len(set(got)) == 20 and min(got) >= 150
    few = diversity.kpp_sample(df, 4, include=df.where(F.col("item_id").isin(3, 5, 8)))
    assert ids(few) == [3, 5, 8]
    assert diversity.kpp_sample(df, 2, unavailable=df).count() == 0


def test_kpp_copies_have_no_weight(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0] if i < 50 else [0.0, 1.0]) for i in range(60)], "item_id long, embedding array<double>")
    got = ids(diversity.kpp_sample(df, 5))
    assert len(got) == 2 and got[0] < 50 <= got[1]


def test_kpp_refresh_does_not_change_picks(cloud, monkeypatch):
    _, df = cloud
    whole = [tuple(r) for r in diversity.kpp_sample(df, 40).orderBy("pick").collect()]
    monkeypatch.setattr(diversity, "REFRESH", 2)
    monkeypatch.setattr(diversity, "AHEAD", 1)
    assert [tuple(r) for r in diversity.kpp_sample(df, 40).orderBy("pick").collect()] == whole


def test_oversampled_kpp(spark, cloud, monkeypatch):
    """About as good as the exact sampler on planted clusters; the same first pick, no unavailable row, all picks different."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 4)) * 20
    x = np.concatenate([centres[rng.integers(0, 60, 1500)] + rng.normal(size=(1500, 4)) * 0.3, np.zeros((300, 4))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "item_id long, embedding array<double>").repartition(6)

    def cost(picks):
        return ((x[:, None] - x[picks][None]) ** 2).sum(2).min(1).sum()

    exact = [r["item_id"] for r in diversity.kpp_sample(df, 120).orderBy("pick").collect()]
    fast = [r["item_id"] for r in diversity.kpp_sample(df, 120, mode="oversample").orderBy("pick").collect()]
    assert len(set(fast)) == 120 and fast[0] == exact[0] and cost(fast) < 1.5 * cost(exact)
    monkeypatch.setattr(diversity, "DRIVER_BYTES", 8 * 4 * 12 * 50)  # at most 50 picks a turn
    turns = [r["item_id"] for r in diversity.kpp_sample(df, 120, mode="oversample").orderBy("pick").collect()]
    assert len(set(turns)) == 120 and cost(turns) < 2 * cost(exact)
    taken, wanted = df.where("item_id < 900"), df.where("item_id % 2 = 0")
    some = ids(diversity.kpp_sample(df, 30, taken, wanted, mode="oversample"))
    assert len(set(some)) == 30 and all(i >= 900 and i % 2 == 0 for i in some)
    again = diversity.kpp_sample(df.repartition(2), 30, taken, wanted, mode="oversample")
    assert ids(again) == some


def test_oversampled_kpp_ends_when_no_distance_is_left(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(60)], "item_id long, embedding array<double>")
    got = diversity.kpp_sample(df, 10, mode="oversample")
    assert sorted(i % 3 for i in ids(got)) == [0, 1, 2]
    assert diversity.kpp_sample(df, 2, unavailable=df, mode="oversample").count() == 0
    assert diversity.kpp_sample(df.where("false"), 2, mode="oversample").count() == 0
    with pytest.raises(ValueError, match="mode"):
        diversity.kpp_sample(df, 2, mode="other")


def test_diversity_with_forty_left(spark, cloud):
    _, df = cloud
    labels = df.select("item_id", F.when(F.col("item_id") < 160, 1.0).alias("a"), F.lit(1.0).alias("b"),
                       F.lit(False).alias("exclude"), F.lit(False).alias("validation"), F.lit("").alias("filepath"))
    got = select.pick(labels, None, 10, "partial", sort_by="diversity", vectors=df)
    assert got.count() == 10 and min(ids(got)) >= 160
    assert select.pick(labels, None, 100, "partial", sort_by="diversity", vectors=df).count() == 40
    spread = diversity.sample_diversity(labels, df, 6, pca_dim=4)
    assert spread.count() <= 6 and min(ids(spread)) >= 160


def test_badge_closed_form(spark, cloud):
    x, df = cloud
    p = 1 / (1 + np.exp(-x[:, :3]))
    preds = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "item_id long, a double, b double, c double")
    got = {r["item_id"]: r["embedding"] for r in diversity.badge_embeddings(df, preds, ["a", "b", "c"]).collect()}
    want = (x[:, :, None] * (p - (p >= 0.5))[:, None, :] / 3).reshape(200, -1)
    assert np.allclose(np.array([got[i] for i in range(200)]), want)
    one = diversity.badge_embeddings(df, preds, ["a", "b", "c"], "b").first()["embedding"]
    assert len(one) == 8
    assert filters.in_predicted_class(preds, "a", 0.5).count() == int((p[:, 0] >= 0.5).sum())


def test_many_first_rows_without_a_single_task(half, monkeypatch):
    labels, preds = half
    few = ids(select.pick(labels, preds, 30, sort_by="highest: foo"))
    monkeypatch.setattr(ranking, "TOP_ROWS", 10)
    assert ids(select.pick(labels, preds, 30, sort_by="highest: foo")) == few


def test_drawn_rows_are_those_of_the_whole_numbering(spark):
    rows = spark.range(5000).select(F.col("id").alias("item_id"), F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("g"))
    whole = {(r["g"], r["row_no"]): r["item_id"] for r in ranking.hash_index(rows, "item_id", ["g"]).collect()}
    draws = spark.range(300).select(F.col("id").alias("draw"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"),
                                    (F.col("id") * 37 % 500).alias("row_no"))
    draws = draws.unionByName(spark.createDataFrame([(1000, "hot", 4499), (1001, "cold", 499), (1002, "hot", 0), (1003, "hot", 0)], draws.schema))
    for n in (4, 300, 10**6):
        got = ranking.find_rows(draws, rows, "item_id", n, ["g"]).collect()
        assert len(got) == 304 and all(whole[r["g"], r["row_no"]] == r["item_id"] for r in got)
    alone = {r["row_no"]: r["item_id"] for r in ranking.hash_index(rows, "item_id").collect()}
    got = ranking.find_rows(draws.drop("g"), rows.select("item_id"), "item_id", 300).collect()
    assert len(got) == 304 and all(alone[r["row_no"]] == r["item_id"] for r in got)


def test_draws_sort_only_what_was_drawn(spark):
    """The only sort of rows stands above the join with the drawn buckets."""
    import re

    rows = spark.range(200_000).select(F.col("id").alias("item_id"))
    out = sample.uniform_sample(rows, 20)
    assert out.count() == 20
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    window = next(i for i, line in enumerate(plan) if re.search(r"Window \[row_number", line))
    assert any("LeftSemi" in line for line in plan[window:window + 3])
