"""Pages and the audit log."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from worktally.operators import changes as CH
from worktally.operators import paging as PG


def table(spark):
    r = random.Random(6)
    rows = [(i, r.choice([None, "hot", "hot", "hot", "hotel", "a", "Ä", "zz", ""]), r.choice([None, 1.5, -2.0, 1e9, float("nan"), float("inf")]), r.choice([None, dt.date(2024, 1, 1), dt.date(1960, 5, 5)]), r.random() < 0.5)
            for i in range(700)]
    return rows, spark.createDataFrame(rows, "id long, name string, size double, day date, flag boolean")


@pytest.mark.parametrize("lead", ["name", "size", "day", "flag", "id"])
@pytest.mark.parametrize("down", [True, False])
def test_pages_equal_the_sorted_table(spark, monkeypatch, lead, down):
    monkeypatch.setattr(PG, "BUCKETS", 8)
    _, df = table(spark)
    order = [(lead, down), ("id", False)] if lead != "id" else [("id", down)]
    whole = [tuple(x) for x in df.orderBy(*PG._order(order)).collect()]
    for offset, limit in ((0, 5), (333, 40), (690, 50), (700, 3), (0, 0)):
        assert [x.id for x in PG.page(df, order, offset, limit).collect()] == [x[0] for x in whole[offset:offset + limit]]


def test_a_deep_page_sorts_its_own_part(spark):
    df = spark.range(100_000).withColumn("k", F.xxhash64("id"))
    out = PG.page(df, [("k", False)], 90_000, 10)
    assert [x.k for x in out.collect()] == sorted(x.k for x in df.collect())[90_000:90_010]
    plan = out._jdf.queryExecution()
    assert int(re.search(r"Offset (\d+)", plan.optimizedPlan().toString())[1]) < 2 * 100_000 / PG.BUCKETS  # what is sorted is one part
    assert "rangepartitioning" not in plan.executedPlan().toString()


def test_keyset_pages_walk_the_table(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "id long, part int")
    order, last, seen = [("part", True), ("id", False)], None, []
    while True:
        rows = (df.orderBy(*PG._order(order)).limit(7) if last is None else PG.page_after(df, order, last, 7)).collect()
        if not rows:
            break
        seen += [(r.part, r.id) for r in rows]
        last = (rows[-1].part, rows[-1].id)
    assert seen == sorted(((i % 3, i) for i in range(50)), key=lambda x: (-x[0], x[1]))


def test_orders(spark):
    df = spark.createDataFrame([("b",), (None,), ("A",), ("zz",)], "name string")
    assert [x.name for x in df.orderBy(PG.by_name("name")).collect()] == ["A", "b", None, "zz"]
    assert [x.r for x in df.select(PG.worst_first("name", ["zz", "A"]).alias("r")).collect()] == [3, 3, 2, 1]


def test_audit_records_of_any_columns(spark, tmp_path):
    kind = "id long, n decimal(5,2), s string, x struct<a: int, b: array<string>>"
    before = spark.createDataFrame([(1, None, "a", (1, ["p"])), (2, None, "b", None), (3, None, None, None), (4, None, "gone", None)], kind)
    after = spark.createDataFrame([(1, None, "a", (1, ["p", "q"])), (2, None, None, None), (3, None, None, None), (5, None, "new", None)], kind)
    rows = CH.audit_log(before, after, "id", "thing", "UPDATE")
    got = {r.entity_id: r for r in rows.collect()}
    assert set(got) == {"1", "2", "4", "5"}
    assert got["1"].fields == ["x"] and json.loads(got["1"].before_json) == {"x": {"a": 1, "b": ["p"]}} and json.loads(got["1"].after_json) == {"x": {"a": 1, "b": ["p", "q"]}}
    assert got["2"].fields == ["s"] and json.loads(got["2"].after_json) == {}
    assert (got["4"].action, got["4"].after_json, json.loads(got["4"].before_json)) == ("DELETE", None, {"s": "gone"})
    assert (got["5"].action, got["5"].before_json, json.loads(got["5"].after_json)) == ("INSERT", None, {"s": "new"})
    home = str(tmp_path / "log")
    for version in (0, 1, 1):
        CH.append_version(rows, home, version)
    assert CH.read_log(spark, home).count() == 8
