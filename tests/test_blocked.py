import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberwatch.plans import blocked as B

T0 = datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    rows = []
    for i in range(600):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(4)}"
        rows.append((i, key, T0 + timedelta(seconds=rng.choice([rng.randrange(4000), rng.randrange(60)])), rng.randrange(9), rng.randrange(100)))
    return rows


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "id long, k string, ts timestamp, port int, b long").repartition(5)


@pytest.mark.parametrize("parts", [None, 6])
def test_sums_and_first_equal_brute_force(frame, data, parts):
    rows = B.sliding_sums(frame, ["k"], "ts", 60, {"n": F.lit(1), "b_sum": F.col("b")}, first="first", partitions=parts)
    got = {r.id: (r.n, r.b_sum, r.first) for r in rows.collect()}
    assert len(got) == len(data)
    for i, k, ts, *_ in data:
        near = [r for r in data if r[1] == k and ts - timedelta(seconds=60) <= r[2] <= ts]
        assert got[i] == (len(near), sum(r[4] for r in near), min(r[2] for r in near))


@pytest.mark.parametrize("parts", [None, 6])
def test_only_windows_that_pass(frame, data, parts):
    rows = B.sliding_sums(frame, ["k"], "ts", 60, {"n": F.lit(1)}, where=F.col("n") > 5, first="first", partitions=parts)
    whole = {r.id: (r.n, r.first) for r in B.sliding_sums(frame, ["k"], "ts", 60, {"n": F.lit(1)}, first="first", partitions=parts).collect()}
    assert {r.id: (r.n, r.first) for r in rows.collect()} == {i: v for i, v in whole.items() if v[0] > 5}


@pytest.mark.parametrize("parts", [None, 6])
def test_running_and_previous(frame, data, parts):
    out = B.running(frame, ["k"], ["ts", "id"], sums={"total": F.col("b")}, maxes={"top": F.col("b")}, previous={"prev": F.col("ts")}, partitions=parts)
    got = {r.id: (r.total, r.top, r.prev) for r in out.collect()}
    by = defaultdict(list)
    for r in sorted(data, key=lambda r: (r[2], r[0])):
        by[r[1]].append(r)
    for rows in by.values():
        total, top, prev = 0, None, None
        for r in rows:
            total, top = total + r[4], max(top if top is not None else r[4], r[4])
            assert got[r[0]] == (total, top, prev)
            prev = r[2]


@pytest.mark.parametrize("parts", [None, 6])
def test_running_distinct(frame, data, parts):
    out = B.running_distinct(frame, ["k"], "port", ["ts", "id"], "ports", parts)
    got = {r.id: r.ports for r in out.collect()}
    seen = defaultdict(set)
    for r in sorted(data, key=lambda r: (r[2], r[0])):
        seen[r[1]].add(r[3])
        assert got[r[0]] == len(seen[r[1]])


@pytest.mark.parametrize("joins", ["-1", "10MB"])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_same_under_forced_plans(spark, frame, data, joins, adaptive):
    held = {n: spark.conf.get(n) for n in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        for _ in range(2):
            test_sums_and_first_equal_brute_force(frame, data, 6)
            test_running_distinct(frame, data, 6)
    finally:
        for n, v in held.items():
            spark.conf.set(n, v)


HOT = 20_000


@pytest.fixture(scope="module")
def second(spark):
    """All rows of one key in one second, most of them at one instant, beside a few of a null key."""
    rows = spark.range(HOT).select(
        "id", F.when(F.col("id") % 100 != 0, "hot").alias("k"),
        F.timestamp_micros(F.lit(1_767_225_600_000_000) + F.when(F.col("id") % 4 == 0, F.col("id") * 7919 % 1_000_000).otherwise(500_000)).alias("ts"),
        (F.col("id") % 13).alias("b"))
    return rows.repartition(8, "id")


def test_one_second_is_split_over_ranges(second):
    parts = B.ranged(second, ["k"], ["ts", "id"], 8).groupBy("_part").count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 2 * HOT / 8
    # the window itself is dealt by key and range
    plan = B.running(second, ["k"], ["ts", "id"], sums={"s": F.col("b")}, partitions=8)._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan.split("Window")[1]


def test_hot_second_equals_plain_window(second, monkeypatch):
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("ts", "id")
    plain = second.select("id", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.lag("ts").over(w).alias("p"))
    mine = B.running(second, ["k"], ["ts", "id"], sums={"s": F.col("b")}, previous={"p": F.col("ts")}, partitions=8).select("id", "s", "p")
    assert mine.exceptAll(plain).isEmpty() and mine.count() == HOT
    us = second.withColumn("us", F.unix_micros("ts"))
    frame = us.select("id", F.sum("b").over(Window.partitionBy("k").orderBy("us").rangeBetween(-1_000_000, 0)).alias("n"))
    for rows in (B.SPLIT_ROWS, 1500):  # also with the rows of one instant split
        monkeypatch.setattr(B, "SPLIT_ROWS", rows)
        got = B.sliding_sums(second, ["k"], "ts", 1, {"n": F.col("b")}, partitions=8).select("id", "n")
        assert got.exceptAll(frame).isEmpty() and got.count() == HOT
        open_frame = us.select("id", F.sum("b").over(Window.partitionBy("k").orderBy("us").rangeBetween(-999_999, 0)).alias("n"))
        got = B.sliding_sums(second, ["k"], "ts", 1, {"n": F.col("b")}, open_start=True, partitions=8).select("id", "n")
        assert got.exceptAll(open_frame).isEmpty()


def test_exclusive_or_and_no_key(frame, data):
    got = {r.id: r.x for r in B.running(frame, [], ["ts", "id"], xors={"x": F.col("b")}, partitions=5).collect()}
    x = 0
    for r in sorted(data, key=lambda r: (r[2], r[0])):
        x ^= r[4]
        assert got[r[0]] == x
