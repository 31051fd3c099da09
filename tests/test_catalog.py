import re

import __spark_entry__ as entry
from tagweave.catalog import QUERIES


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


def test_inventory_is_covered():
    """Every inventory id has a query; a few are covered inside others."""
    wanted = {"a": 13, "b": 20, "c": 10, "d": 32, "e": 10, "f": 17, "g": 6, "h": 14, "i": 4, "j": 4}
    have = {re.match(r"([a-k])(\d\d)", n).group(0) for n in QUERIES}
    missing = {f"{g}{i:02d}" for g, top in wanted.items() for i in range(1, top + 1)} - have
    assert missing == set()


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.columns == ["item_id", "key"] and out.count() == 20


def test_flagship_first_ids(spark):
    from tagweave.catalog.fixtures import CLASSES, label_table, pred_table
    from tagweave.operators.select import pick

    sf = "/root/testdata/sf0.01"
    out = pick(label_table(spark, sf), pred_table(spark, sf), 20, sort_by="max entropy", classes=CLASSES).collect()
    assert [r["item_id"] for r in out[:3]] == [600, 390, 750]
