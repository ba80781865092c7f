"""Keys from quota sheets against a plain reading of them, up to an allocation."""

import itertools
import json
import random

import pytest

from panelspark.operators import quota, quota_keys
from panelspark.operators.quota_keys import Sheet


def plain(value):
    text = "" if value is None or value != value else str(value).strip()
    if text.endswith(".0"):
        text = text[:-2]
    return None if text.lower() in quota_keys.OPEN else text


def plain_keys(person, cells, width):
    """All keys that a person falls in, most dimensions first, then those that name the earlier ones."""
    found = {}
    for cell in cells:
        values = [plain(v) for v in cell[:width]]
        if all(v is None or v == plain(p) for v, p in zip(values, person, strict=True)):
            mask = [v is not None for v in values]
            found[json.dumps(values, ensure_ascii=False, separators=(",", ":"))] = (-sum(mask), [-m for m in mask])
    return sorted(found, key=found.get)


def test_keys_equal_plain(spark):
    rng = random.Random(5)
    sex, age, area = ["M", "F", " M ", None], [20, 30, 40, None], ["서울", "부산", "a|b", "total", None]
    people = [(i, rng.choice(sex), rng.choice(age), rng.choice(area), rng.random()) for i in range(300)]
    main = [(s, a, r, float(rng.randint(1, 9))) for s, a, r in itertools.product(["M", "F", "전체"], [20.0, 30.0, float("nan")], ["서울", "부산", "a|b", " Total "]) if rng.random() < 0.5]
    sub = [(a, s, None, 5.0) for a, s in itertools.product(["20", "30.0", None], ["M", "all"])] + [("20", "M", "x", 7.0)]
    frame = spark.createDataFrame(people, "respondent_id int, sex string, age int, area string, score double")
    main_sheet = Sheet(spark.createDataFrame(main, "qt1 string, qt2 double, qt3 string, target double"), ("sex", "age", "area"))
    sub_sheet = Sheet(spark.createDataFrame(sub, "qt1 string, qt2 string, qt3 string, target double"), ("age", "sex"))
    rows = {r.respondent_id: r for r in quota_keys.with_keys(frame, main_sheet, [sub_sheet]).collect()}
    assert len(rows) == 300
    for i, s, a, r, _ in people:
        keys = plain_keys((s, a, r), main, 3)
        assert rows[i].m_key == (keys[0] if keys else None)
        assert rows[i].sub_keys == [plain_keys((a, s), sub, 2)]
    assert {r.key: r.target for r in quota_keys.sub_targets([sub_sheet]).collect()}['["20","M"]'] == 7.0
    keyed = quota_keys.with_keys(frame, main_sheet, [sub_sheet])
    chosen = quota.allocate(keyed, quota_keys.main_targets(main_sheet), quota_keys.sub_targets([sub_sheet]), quota.Starts(deviation=0.0))
    left = {r.m_key: r.target for r in quota_keys.main_targets(main_sheet).collect()}
    room = {r.key: r.target for r in quota_keys.sub_targets([sub_sheet]).collect()}
    want = []
    for i, *_ in sorted(people, key=lambda p: -round(p[4], 9)):
        m, subs = rows[i].m_key, rows[i].sub_keys[0]
        if left.get(m, 0) > 0 and all(room[k] > 0 for k in subs):
            left[m] -= 1
            for k in subs:
                room[k] -= 1
            want.append(i)
    assert [r.respondent_id for r in chosen.orderBy("rank").collect()] == want


def test_corners(spark):
    people = spark.createDataFrame([(1, "M")], "respondent_id int, sex string")
    empty = Sheet(spark.createDataFrame([], "qt1 string, qt2 string, qt3 string, target double"), ("sex",))
    assert [tuple(r) for r in quota_keys.with_keys(people, empty, []).collect()] == [(1, "M", None, [])]
    assert [tuple(r) for r in quota_keys.with_keys(people, empty, [empty]).collect()] == [(1, "M", None, [[]])]
    assert quota_keys.with_keys(people.filter("false"), empty, [empty]).collect() == []
    total = Sheet(spark.createDataFrame([("전체", None, None, 3.0)], "qt1 string, qt2 string, qt3 string, target double"), ("sex",))
    assert quota_keys.with_keys(people, total, []).first().m_key == "[null]"
    with pytest.raises(ValueError):
        quota_keys.with_keys(people.withColumnRenamed("sex", "m_key"), empty, [])
    with pytest.raises(ValueError):
        quota_keys.sheet_keys(Sheet(empty.cells, ()))


def test_sheets_are_worked_out_once(spark):
    """A sheet that a query derives from people is no part of the plan in which each of its masks is joined."""
    from pyspark.sql import functions as F

    people = spark.createDataFrame([(i, "ab"[i % 2], i % 3) for i in range(12)], "respondent_id long, segment string, area int")
    nothing = F.lit(None).cast("string")
    each = people.groupBy("segment", "area").count().select(F.col("segment").alias("qt1"), F.col("area").cast("string").alias("qt2"), nothing.alias("qt3"), F.col("count").cast("double").alias("target"))
    total = people.groupBy("segment").count().select(F.col("segment").alias("qt1"), F.lit("전체").alias("qt2"), nothing.alias("qt3"), F.col("count").cast("double").alias("target"))
    rows = quota_keys.with_keys(people, quota_keys.Sheet(each.unionByName(total), ("segment", "area")), [])
    assert "Aggregate" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.respondent_id, r.m_key) for r in rows.collect()} == {(i, f'["{"ab"[i % 2]}","{i % 3}"]') for i in range(12)}
