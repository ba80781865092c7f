"""Quotas against the sequential rule written out plainly, and its corner cases."""

import math
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from panelspark.operators import quota
from panelspark.plans import catalogue

PEOPLE = "respondent_id long, score double, m_key string, sub_keys array<array<string>>"
NAN = float("nan")


def greedy(people, main, subs):
    """The rule: in descending order of score, missing ones first, ties by id."""
    main, subs = dict(main), dict(subs)
    order = sorted(people, key=lambda p: (not (p[1] is None or math.isnan(p[1])), -(p[1] or 0) if p[1] is not None and not math.isnan(p[1]) else 0, p[0]))
    accepted = []
    for ident, _, key, lists in order:
        met = [(j, k) for j, keys in enumerate(lists or []) for k in keys or [] if (j, k) in subs]
        if main.get(key, 0) > 0 and not any(subs[m] <= 0 for m in met):
            main[key] -= 1
            for m in met:
                subs[m] -= 1
            accepted.append(ident)
    return accepted


def run(spark, people, main, subs, **starts):
    rows = quota.allocate(
        spark.createDataFrame(people, PEOPLE), spark.createDataFrame(list(main.items()), "m_key string, target double"),
        spark.createDataFrame([(j, k, t) for (j, k), t in subs.items()], "sub_id int, key string, target double"), quota.Starts(**({"deviation": 0.0} | starts)),
    )
    return [r.respondent_id for r in rows.orderBy("rank").collect()]


def test_worked_case(spark):
    people = [(1001, 5.0, "M", [["p"]]), (1002, 4.0, "M", [["p"]]), (1003, 3.0, "F", [[]]), (1004, 2.0, "M", [["z"]]), (1005, 1.0, "X", [[]])]
    assert run(spark, people, {"M": 2.0, "F": 1.0}, {(0, "p"): 1.0}) == [1001, 1003, 1004]


@pytest.mark.parametrize(
    ("main", "subs", "people"),
    [
        ({"a": 20.5}, {}, [(i, float(i), "a", None) for i in range(30)]),
        ({"a": NAN, "b": 0.0, "c": -1.0, "d": 0.3}, {}, [(i, 1.0, "abcd"[i % 4], None) for i in range(9)]),
        ({"a": 9.0}, {(0, "p"): NAN, (0, "q"): 0.0}, [(1, 1.0, "a", [["p"]]), (2, 1.0, "a", [["q"]]), (3, 1.0, "a", [["p", "u"]])]),
        ({"a": 9.0}, {(0, "p"): 2.0}, [(1, 3.0, "a", [["p", "p", "p"]]), (2, 2.0, "a", [["p"]]), (3, 1.0, "a", [None, ["p"]])]),
        ({"a": 2.0, None: 1.0}, {}, [(1, None, "a", None), (2, NAN, "a", None), (3, 9.0, "a", None), (4, 1.0, None, None)]),
    ],
)
def test_corner_cases(spark, main, subs, people):
    assert run(spark, people, main, subs) == greedy(people, main, subs)


TARGET = st.sampled_from([-1.0, 0.0, 0.5, 1.0, 2.0, 2.5, 7.0, NAN])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.data())
def test_rounds_equal_the_rule(spark, data):
    rng = random.Random(data.draw(st.integers(0, 10**6)))
    main = {k: data.draw(TARGET) for k in "abc"}
    subs = {(j, k): data.draw(TARGET) for j in range(3) for k in "pqr"}
    people = [(i, rng.choice([float(rng.randrange(9)), rng.random(), NAN]), rng.choice("abcx"), [[rng.choice("pqrz") for _ in range(rng.randrange(4))] for _ in range(3)]) for i in range(rng.randrange(0, 120))]
    want = greedy(people, main, subs)
    assert run(spark, people, main, subs) == want
    assert run(spark, people, main, subs, front_rows=40) == want
    assert run(spark, people, main, subs, front_rows=0) == want


def test_bands_do_not_change_the_result(spark):
    rng = random.Random(3)
    people = [(i, rng.random(), rng.choice("ab"), [[rng.choice("pqr")]]) for i in range(300)]
    main, subs = {"a": 40.0, "b": 30.0}, {(0, "p"): 20.0, (0, "q"): 15.0}
    assert run(spark, people, main, subs, band_rows=25, front_rows=30) == greedy(people, main, subs)


def frames(spark):
    people = spark.createDataFrame([(i, i / 10, "ab"[i % 2], [[str(i % 3)]]) for i in range(40)], PEOPLE)
    main = spark.createDataFrame([("a", 6.0), ("b", 5.5)], "m_key string, target double")
    subs = spark.createDataFrame([(0, "0", 2.0), (0, "1", 1.0)], "sub_id int, key string, target double")
    return people, main, subs


def test_starts(spark):
    people, main, subs = frames(spark)
    assert quota.allocate_best(people, main, subs, quota.Starts(count=0))[0] == -1
    assert quota.allocate_best(people.limit(0), main, subs)[0] == 0
    rows = quota.allocate(people, main, subs, quota.Starts(count=4))
    counts = {r.start_id: r["count"] for r in rows.groupBy("start_id").count().collect()}
    assert quota.best_start(rows, quota.Starts(count=4)) == min(counts, key=lambda i: (-counts[i], i))
    assert quota.best_start(rows, quota.Starts(count=4, threshold=0)) == 0
    again = quota.allocate(people.repartition(7), main, subs, quota.Starts(count=4))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect()))
    fewer = quota.allocate_best(people, main, subs, quota.Starts(count=2))[0]
    assert fewer <= quota.allocate_best(people, main, subs, quota.Starts(count=4))[0]


def test_waves_stop_at_the_threshold(spark, monkeypatch):
    people, main, subs = frames(spark)
    ran = []
    real = quota.allocate
    monkeypatch.setattr(quota, "allocate", lambda p, m, s, starts, **c: ran.append(starts.count) or real(p, m, s, starts, **c))
    n, rows = quota.allocate_best(people, main, subs, quota.Starts(count=1000, threshold=0, wave=2))
    assert ran == [2] and n == rows.count() and {r.start_id for r in rows.collect()} == {0}
    all_at_once = quota.allocate_best(people, main, subs, quota.Starts(count=5))
    in_waves = quota.allocate_best(people, main, subs, quota.Starts(count=5, wave=2))
    assert all_at_once[0] == in_waves[0] and sorted(map(tuple, all_at_once[1].collect())) == sorted(map(tuple, in_waves[1].collect()))


def test_main_alone_is_a_rank(spark):
    people, main, _ = frames(spark)
    none = spark.createDataFrame([], "sub_id int, key string, target double")
    ranked = quota.allocate_main(people, main, "m_key", "score", "respondent_id")
    rounds = quota.allocate(people, main, none, quota.Starts(deviation=0.0, front_rows=0))
    assert {r.respondent_id for r in ranked.collect()} == {r.respondent_id for r in rounds.collect()}
    plan = ranked._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Broadcast" in plan


def test_sheets(spark):
    sheet = spark.createDataFrame([("남", "20대", "서울", 10.0, 1), (None, "30대", "서울", 12.5, 2)], "a string, b string, c string, d double, target int")
    assert quota.normalize_quota(sheet).columns == ["qt1", "qt2", "qt3", "target"]
    assert [r.qt1 for r in quota.normalize_quota(sheet).collect()] == ["남", None]
    assert [r.qt1 for r in quota.normalize_quota(sheet, fill_down=True, order="target").collect()] == ["남", "남"]
    assert quota.normalize_quota(sheet.select("a", "b", "c")).columns == []
    with pytest.raises(ValueError):
        quota.normalize_quota(sheet.select("a"), strict=True)


def test_rounds_are_few(spark, monkeypatch):
    """Four quotas a respondent, targets of a third of them: rounds grow with the number of digits, not with the cells."""
    rng = random.Random(11)
    people = [(i, rng.random(), rng.choice("abcdef"), [[str(rng.randrange(12))], [str(rng.randrange(20))], [str(rng.randrange(9))]]) for i in range(4_000)]
    main = {k: float(rng.randrange(100, 400)) for k in "abcdef"}
    subs = {(j, str(k)): float(rng.randrange(10, 4_000 // (2 * n) * 2)) for j, n in enumerate((12, 20, 9)) for k in range(n)}
    ran = []
    real = quota._round
    monkeypatch.setattr(quota, "_round", lambda *a: ran.append(1) or real(*a))
    assert run(spark, people, main, subs, front_rows=800) == greedy(people, main, subs)
    assert len(ran) <= 12


def test_estimates_do_not_multiply_from_step_to_step(spark):
    """A plan's estimated size is a number that the driver holds; over checkpoints in a loop with joins it grew by a power in each round."""
    rng = random.Random(7)
    people = [(i, rng.random(), rng.choice("abc"), [[rng.choice("pqrstu")], [rng.choice("xyz")]]) for i in range(600)]
    main = {k: 70.0 for k in "abc"}
    subs = {(0, k): 20.0 + 9 * i for i, k in enumerate("pqrstu")} | {(1, k): 50.0 + 7 * i for i, k in enumerate("xyz")}
    rows = quota.allocate(
        spark.createDataFrame(people, PEOPLE), spark.createDataFrame(list(main.items()), "m_key string, target double"),
        spark.createDataFrame([(j, k, t) for (j, k), t in subs.items()], "sub_id int, key string, target double"), quota.Starts(deviation=0.0, front_rows=40, band_rows=200),
    )
    assert rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 50
    assert [r.respondent_id for r in rows.orderBy("rank").collect()] == greedy(people, main, subs)


def test_shortfall_of_an_allocation_in_many_steps(spark):
    rng = random.Random(8)
    people = [(i, rng.random(), rng.choice("ab"), [[rng.choice("pqrstu")]]) for i in range(400)]
    main, subs = {"a": 60.0, "b": 90.5}, {(0, k): 8.0 + 6 * i for i, k in enumerate("pqrstu")}
    frames_ = spark.createDataFrame(people, PEOPLE), spark.createDataFrame(list(main.items()), "m_key string, target double"), spark.createDataFrame([(j, k, t) for (j, k), t in subs.items()], "sub_id int, key string, target double")
    chosen = quota.allocate(*frames_, quota.Starts(deviation=0.0, front_rows=24))
    short = quota.shortfall(chosen.join(frames_[0].select("respondent_id", "m_key"), "respondent_id"), frames_[1])
    assert short._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 256
    keys = {p[0]: p[2] for p in people}
    filled = [keys[i] for i in greedy(people, main, subs)]
    assert {r.m_key: (r.wanted, r.filled) for r in short.collect()} == {k: (math.ceil(t), filled.count(k)) for k, t in main.items()}


def test_many_alike_are_cut_before_the_order(spark, monkeypatch):
    """Of a profile only as many as its least quota has room for are put in order, in each start; results are those of all."""
    rng = random.Random(5)
    people = [(i, rng.random(), rng.choice("ab"), [[rng.choice("pq")]]) for i in range(900)]
    main, subs = {"a": 9.0, "b": 7.5}, {(0, "p"): 5.0, (0, "q"): 6.0}
    put = []
    real = quota._placed
    monkeypatch.setattr(quota, "_placed", lambda orders, n: put.append(orders.count()) or real(orders, n))
    assert run(spark, people, main, subs) == greedy(people, main, subs)
    assert put == [22]
    monkeypatch.setattr(quota, "HEAD_ROWS", 5)
    assert run(spark, people, main, subs) == greedy(people, main, subs)
    assert 200 < put[1] < 900


def test_rounds_write_no_table_of_all(spark, monkeypatch):
    rng = random.Random(12)
    people = [(i, rng.random(), rng.choice("abc"), [[rng.choice("pqrs")]]) for i in range(500)]
    main, subs = {k: 60.0 for k in "abc"}, {(0, k): 30.0 + 9 * i for i, k in enumerate("pqrs")}
    large = []
    real = quota.written
    monkeypatch.setattr(quota, "written", lambda df, name: (lambda out: large.append(name) or out if out.count() >= 400 else out)(real(df, name)))
    assert run(spark, people, main, subs, front_rows=0, band_rows=400) == greedy(people, main, subs)
    assert sorted(large) == ["asked", "order", "orders", "rows"]


def broadcasts(df):
    """What is broadcast as df's plan stands before it runs."""
    found = []

    def walk(node):
        if node.nodeName() == "BroadcastExchange":
            found.append(node.toString())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan().initialPlan())
    return found


def many(spark, tmp_path):
    """Writes 400 customers; what is wanted and filled of each key by the rule."""
    rows = [(i, i % 25, float(i * 37 % 10_000), list(catalogue.MAIN)[i % 5]) for i in range(400)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    people = [(i, b / 10_000, m, [[str(n)], [str(math.floor((b + 1000) / 1000))]]) for i, n, b, m in rows]
    subs = {(i, str(k)): t for i, targets in enumerate((catalogue.SUB, catalogue.BANDS)) for k, t in targets.items()}
    filled = [people[i][2] for i in greedy(people, catalogue.MAIN, subs)]
    return {k: (math.ceil(t), filled.count(k)) for k, t in catalogue.MAIN.items()}


@pytest.mark.parametrize(("most", "way"), [(100_000, "broadcast"), (10, "merge")])
def test_shortfall_says_how_all_are_joined(spark, tmp_path, monkeypatch, most, way):
    """The chosen are broadcast if they are few, else there is a shuffle; left to Spark, it planned anew as it ran and broadcast everyone's keys."""
    want = many(spark, tmp_path)
    monkeypatch.setattr(quota, "BROADCAST_ROWS", most)
    short = catalogue.q11_quota_shortfall(spark, str(tmp_path))
    plan = short._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(rf"Join Inner, \(respondent_id#\d+L = respondent_id#\d+L\), rightHint=\(strategy={way}\)", plan)
    assert {r.m_key: (r.wanted, r.filled) for r in short.collect()} == want


def test_large_tables_are_not_broadcast_by_their_files(spark, monkeypatch):
    monkeypatch.setattr(quota, "BROADCAST_ROWS", 10)
    left, right = spark.range(50), spark.range(60)
    joined = left.join(quota.small(right), "id")
    assert broadcasts(joined) == [] and joined.count() == 50
    few = left.join(quota.small(right.limit(10)), "id")
    assert len(broadcasts(few)) == 1 and few.count() == 10
