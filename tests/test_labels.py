import pytest
from row_helpers import ids
from pyspark.sql import functions as F

from tagweave.operators import edits, encode, filters
from tagweave.schema import class_columns
from tagweave.session import scratch_path
from tagweave.sources import items, labels, store


def test_class_columns_skip_protected(frame):
    assert class_columns(frame) == ["class1", "class2"]
    with pytest.raises(ValueError):
        class_columns(frame, ["nope"])


def test_status(frame):
    c = class_columns(frame)
    assert ids(frame.where(filters.is_unlabeled(c))) == [0]
    assert ids(frame.where(filters.is_fully_labeled(c))) == [1, 2]
    assert ids(frame.where(filters.is_partially_labeled(c))) == [3, 4]
    assert ids(filters.labeled_ids(frame)) == [1, 2]
    assert ids(filters.excluded_ids(frame)) == [0]
    assert ids(filters.unavailable_ids(frame)) == [0, 1, 2]


@pytest.mark.parametrize("args,want", [
    (("unlabeled", "not excluded", "all"), []), (("labeled", "not excluded", "subset: 0"), [1]),
    (("partial", "not excluded", "contains: class1"), [3, 4]), (("labeled", "not excluded", "doesn't contain: class1"), [2]),
    (("partial", "not excluded", "unlabeled: class2"), [3, 4]), (("unlabeled", "excluded", "all"), [0])])
def test_find_subset(frame, args, want):
    assert ids(filters.find_subset(frame, *args)) == want


def test_find_subset_rejects(frame):
    for args in (("some", "not excluded", "all"), ("labeled", "maybe", "all"), ("labeled", "excluded", "has: class1"),
                 ("labeled", "excluded", "contains: other")):
        with pytest.raises(ValueError):
            filters.find_subset(frame, *args)


def test_null_exclude_counts_as_not_excluded(spark):
    df = spark.createDataFrame([(1, None, None)], "item_id long, exclude boolean, a double").withColumn("validation", F.lit(True))
    assert ids(filters.find_subset(df, "unlabeled", "not excluded", "all", ["a"])) == [1]


def test_prep_and_minus_one(spark):
    fresh = labels.prep_label_table(spark.createDataFrame([(i, p) for i, p in enumerate("abc")], "item_id long, filepath string"),
                                    ["x", "y", "z"])
    assert fresh.columns == ["item_id", "filepath", "exclude", "validation", "x", "y", "z"]
    rows = filters.null_to_minus_one(fresh).collect()
    assert all(r["x"] == r["y"] == r["z"] == -1 and not r["exclude"] for r in rows)


def test_records_ragged(spark):
    df = spark.createDataFrame([(0, '{"class0": 1, "validation": true}'), (1, '{"class1": 0}'), (2, '{"class0": 0, "other": 1}')],
                               "item_id long, record string")
    t = labels.labels_from_records(df, classes=["class1", "class0"])
    assert t.columns == ["item_id", "filepath", "exclude", "validation", "class1", "class0"]
    r = {x["item_id"]: x for x in t.collect()}
    assert r[0]["class0"] == 1 and r[0]["class1"] is None and r[0]["validation"] and r[0]["filepath"] == ""
    assert "other" in labels.labels_from_records(df).columns


def test_manifest_and_path_labels(spark):
    df = spark.createDataFrame([("x/y/A.JPG",), ("b.jpeg.png",), ("q/c.tif",)], "filepath string")
    r = {x["filepath"]: x for x in labels.file_manifest(df).collect()}
    assert [r[p]["type_code"] for p in ("x/y/A.JPG", "b.jpeg.png", "q/c.tif")] == [1, 1, 3]
    assert (r["x/y/A.JPG"]["parent"], r["x/y/A.JPG"]["grandparent"]) == ("y", "x")
    assert r["b.jpeg.png"]["parent"] is None and r["q/c.tif"]["grandparent"] is None
    assert {x["filepath"]: x["label"] for x in labels.labels_from_path(df, ["y/", "zz"]).collect()}["x/y/A.JPG"] == 1


def test_manifest_of_folder(spark, tmp_path):
    for n in ("one.png", "two.gif"):
        (tmp_path / n).write_bytes(b"x")
    got = {r["filepath"].split("/")[-1]: r["type_code"] for r in labels.file_manifest((spark, str(tmp_path))).collect()}
    assert got == {"one.png": 0, "two.gif": 2}


def events(spark, rows):
    return spark.createDataFrame(rows, "ts int, event_id long, item_id long, field string, value double")


def test_last_write_wins_and_null_overwrites(spark, frame):
    out = edits.apply_label_events(frame, events(spark, [
        (2, 5, 1, "class1", None), (1, 9, 1, "class1", 0.0), (1, 1, 0, "exclude", None), (1, 2, 3, "class2", 1.0)]))
    r = {x["item_id"]: x for x in out.collect()}
    assert r[1]["class1"] is None and r[0]["exclude"] is False and r[3]["class2"] == 1 and r[2]["class1"] == 0


def test_copy_and_quick_tags(spark, frame):
    copies = spark.createDataFrame([(1, 1, 0, 2), (1, 2, 4, 2)], "ts int, event_id long, item_id long, source_id long")
    out = edits.apply_label_events(frame, edits.copy_label_events(frame, copies, ["class1", "class2"]))
    r = {x["item_id"]: (x["class1"], x["class2"]) for x in out.collect()}
    assert r[0] == r[4] == r[2] == (0.0, 1.0)
    taps = spark.createDataFrame([(1, 1, 1, "red"), (1, 2, 2, "blue"), (1, 3, 3, "white")], "ts int, event_id long, item_id long, color string")
    r = {x["item_id"]: x["class1"] for x in edits.apply_label_events(frame, edits.quick_tag_events(taps, "class1")).collect()}
    assert (r[1], r[2], r[3]) == (None, 1.0, 0.0)


def test_encode(spark):
    train = spark.createDataFrame([(0, "foo"), (1, "bar"), (2, "bar"), (3, None)], "item_id long, task string")
    val = spark.createDataFrame([(4, "bar"), (5, "bar")], "item_id long, task string")
    codes = encode.class_codes(train, val, ["task"])
    got = {r["item_id"]: r["task_code"] for r in encode.encode_classes(train, codes, ["task"]).collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: -1}
    assert [tuple(r) for r in encode.missing_classes(codes).collect()] == [("task", "foo", "validation")]


def test_csv_round_trip(spark, frame):
    path = scratch_path(spark, "test-labels")
    store.save_labels(frame, path, only_labeled=True)
    back = store.load_labels(spark, path, ["class1", "class2"])
    assert sorted(map(tuple, back.collect())) == sorted(tuple(r) for r in frame.collect() if r["item_id"] > 0)


def test_shards_and_map_function(spark, frame):
    path = scratch_path(spark, "test-shards")
    items.save_sharded(frame, path, 3)
    back = items.load_sharded(spark, path, lambda d: d.withColumn("twice", F.col("item_id") * 2), shuffle=True)
    assert ids(back, "twice") == [0, 2, 4, 6, 8]


def test_runs_and_metrics(spark):
    path = scratch_path(spark, "test-runs")
    store.log_run(spark, "r", {"steps": 3, "model": {"depth": 2}}, path)
    store.log_run(spark, "s", {"steps": 4}, path)
    assert {(r["run_id"], r["grp"], r["name"], r["value"]) for r in spark.read.parquet(path).collect()} == {
        ("r", "run", "steps", "3"), ("r", "model", "depth", "2"), ("s", "run", "steps", "4")}
    nested = spark.createDataFrame([("r", 0, {"cat": {"accuracy": "0.80 (0.75-0.85)", "x": "9"}})],
                                   "run_id string, step int, metrics map<string,map<string,string>>")
    assert [(r["name"], r["value"]) for r in store.flatten_metrics(nested).collect()] == [("cat_accuracy", 0.8)]


def test_rounds(spark, frame):
    path = scratch_path(spark, "test-rounds")
    store.save_round({"labels": frame}, path, 0)
    store.save_round({"labels": frame.where("item_id > 2")}, path, 1)
    assert ids(store.load_round(spark, path, "labels")) == [3, 4]
    assert ids(store.load_round(spark, path, "labels", 0)) == [0, 1, 2, 3, 4]


def test_scan_sources(spark, frame, tmp_path):
    (tmp_path / "one.png").write_bytes(b"xy")
    files = items.scan_items(spark, str(tmp_path), fmt="binaryFile")
    assert files.select("length").first()[0] == 2 and "filepath" in files.columns
    path = scratch_path(spark, "test-scan")
    items.save_sharded(frame, path, 2, compress=False)
    ys = spark.createDataFrame([(1, "x")], "item_id long, y string")
    assert [r["y"] for r in items.scan_items(spark, path, ys).collect()] == ["x"]
    assert items.batch_count(items.scan_items(spark, frame), 2).first()[0] == 3
