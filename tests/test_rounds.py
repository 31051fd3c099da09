import pytest
from pyspark.sql import functions as F

from tagweave.plans import rounds
from tagweave.session import scratch_path


@pytest.fixture(scope="module")
def world(spark):
    """120 points of two clear classes; ten labelled for validation, ten for training, the rest open."""
    rows = spark.range(120).select(F.col("id").alias("item_id"), (F.col("id") % 2).cast("int").alias("c"))
    vectors = rows.select("item_id", "c", F.array(F.when(F.col("c") == 1, 1.0).otherwise(-1.0) + F.col("item_id") % 7 / 20.0, F.lit(0.5)).alias("embedding"))
    known = F.when(F.col("item_id") < 20, F.col("c").cast("double"))
    labels = rows.select("item_id", F.lit("").alias("filepath"), (F.col("item_id") == 50).alias("exclude"), (F.col("item_id") < 10).alias("validation"),
                         known.alias("yes"))
    preds = rows.select("item_id", ((F.col("item_id") * 7 % 120) / 120.0).alias("yes"))

    def answers(flip=False):
        value = (F.lit(1) - F.col("c") if flip else F.col("c")).cast("double")
        return lambda picked, no: picked.join(vectors, "item_id").select(
            F.lit(no).alias("ts"), F.col("item_id").alias("event_id"), "item_id", F.lit("yes").alias("field"), value.alias("value"))

    return labels, preds, vectors, answers


def tables(log, no=None):
    return {t: sorted(map(str, log.read(t, no).collect())) for t in ("labels", "preds", "heads", "summary")}


def test_a_run_that_fails_anywhere_ends_like_one_that_never_did(spark, world, monkeypatch):
    labels, preds, vectors, answers = world
    go = dict(m=8, rounds=3, sort_by="max entropy", steps=8)
    whole = rounds.label_rounds(scratch_path(spark, "a"), labels, preds, vectors, answers(), **go)
    path, asked, tries = scratch_path(spark, "b"), [], []
    real = rounds.train_heads

    def annotate(picked, no):
        asked.append(no)
        if asked == [1, 2]:
            raise InterruptedError
        return answers()(picked, no)

    def failing(*a, **k):
        tries.append(1)
        if len(tries) == 3:
            raise InterruptedError
        return real(*a, **k)

    monkeypatch.setattr(rounds, "train_heads", failing)
    log, failed = None, 0
    while log is None:
        try:
            log = rounds.label_rounds(path, labels, preds, vectors, annotate, **go)
        except InterruptedError:
            failed += 1
    assert failed == 2 and asked == [1, 2, 2, 3, 3]
    for no in (1, 2, 3):
        assert tables(log, no) == tables(whole, no)
    assert sorted(map(str, log.history("picked").collect())) == sorted(map(str, whole.history("picked").collect()))
    assert log.history("picked").count() == 24 and log.read("labels").where("yes IS NOT NULL").count() == 44
    # Readers see whole rounds only, and a finished run does nothing more.
    again = rounds.label_rounds(path, labels, preds, vectors, annotate, **go)
    assert max(again.rounds()) == 3 and asked == [1, 2, 2, 3, 3]
    heads = rounds.load_heads(log.read("heads"), ["yes"])
    want = {r["item_id"]: r["yes"] for r in log.read("preds").collect()}
    assert all(abs(r["yes"] - want[r["item_id"]]) < 1e-9 for r in heads.predict(vectors).collect())


def test_an_unfinished_attempt_is_not_seen(spark, world):
    labels, preds, vectors, answers = world
    log = rounds.label_rounds(scratch_path(spark, "c"), labels, preds, vectors, answers(), 5, 1, steps=5)
    lost = log.begin(2)
    lost.write(labels.limit(1), "labels")
    assert max(log.rounds()) == 1 and log.read("labels").count() == 120
    other = log.begin(2)
    other.write(labels.limit(3), "labels")
    other.commit(val_loss=0.1)
    with pytest.raises(ValueError, match="another run"):
        lost.commit(val_loss=0.2)
    assert log.read("labels").count() == 3
    with pytest.raises(ValueError, match="already whole"):
        log.begin(2)


def test_early_stop_and_an_empty_pool(spark, world):
    labels, preds, vectors, answers = world
    path = scratch_path(spark, "d")
    log = rounds.label_rounds(path, labels, preds, vectors, answers(flip=True), 20, 9, patience=2, sort_by="random", steps=30)
    facts = log.rounds()
    losses = [facts[n]["val_loss"] for n in sorted(facts) if n]
    assert facts[max(facts)]["stopped"] == "no better validation loss" and len(losses) < 6 and losses.index(min(losses)) < len(losses) - 2
    assert max(rounds.label_rounds(path, labels, preds, vectors, answers(flip=True), 20, 9, patience=2, sort_by="random", steps=30).rounds()) == max(facts)
    log = rounds.label_rounds(scratch_path(spark, "e"), labels, preds, vectors, answers(), 70, 9, sort_by="random", steps=5, keep_tables=False)
    facts = log.rounds()
    assert [facts[n]["picked"] for n in (1, 2, 3)] == [70, 29, 0] and facts[3]["stopped"] == "nothing left to pick" and max(facts) == 3
    assert log.read("labels").where("yes IS NULL").count() == 1
    with pytest.raises(Exception, match="(?i)path"):
        log.read("labels", 1)
    with pytest.raises(ValueError, match="other settings"):
        rounds.label_rounds(log.path, labels, preds, vectors, answers(), 5, 9, sort_by="random")
