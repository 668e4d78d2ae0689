"""Steps that compute each value once, and nothing that is not asked for."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch.functions import text as X
from emberwatch.operators import detect as D
from emberwatch.operators import indicators as I
from emberwatch.operators import normalize as N
from emberwatch.operators import parse as P
from emberwatch.operators import validate as V
from emberwatch.plans.fence import once


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_and_unread_columns_stop_at_the_fence(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    fenced = once(rows.select(F.md5("x").alias("m"), F.sha1("x").alias("s")))
    plan = optimized(fenced.filter("m like '0%' and length(m) > 3").select("m"))
    assert plan.count("md5(") == 1 and "sha1(" not in plan and "sha(" not in plan
    assert sorted(r["m"] or "" for r in fenced.collect()) == ["", "0cc175b9c0f1b6a831c399e269772661", "92eb5ffee6ae2fec3ad71c777531578f"]


def test_a_valid_event_is_opened_a_few_times_only(spark):
    """The filter on is_valid once repeated the whole check, and every look at a field read the JSON text again."""
    raw = spark.createDataFrame([(1, '{"event_id": "e"}')], "source_position long, raw string")
    assert optimized(V.validated_events(raw)).count("parse_json") <= 6


def test_only_the_format_is_found_where_only_it_is_read(spark):
    raw = spark.createDataFrame([(1, "Jan  9 10:15:30 h app: x")], "source_position long, raw string")
    found = N.ingest(raw, F.lit("2024-02-01").cast("timestamp")).select("format")
    assert "URI" not in optimized(found) and "javascript" not in optimized(found)
    assert [r["format"] for r in found.collect()] == ["syslog"]


def test_an_access_line_is_taken_apart_once(spark):
    """All groups at once equal group by group, also where a text holds the mark that parts them."""
    line = '1.2.3.4 - bob [09/Jan/2024:10:15:30 +0000] "GET /a?x=1 HTTP/1.1" 404 512'
    texts = [line, line + ' "-" "curl/8.0"', line + ' "http://r" "" tail "x"', "no access line", "", None, line.replace("bob", "b\x01b"), "\x01", "x\n" + line, line + "\n" + line]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    parts = X.groups("t", P.COMBINED_LOG, 11)
    got = rows.select("i", F.col("t").rlike(P.COMBINED_LOG).alias("hit"), (F.size(parts) > 11).alias("found"), *[F.nullif(F.get(parts, F.lit(g)), F.lit("")).alias(f"a{g}") for g in range(1, 12)],
                      *[X.group("t", P.COMBINED_LOG, g).alias(f"b{g}") for g in range(1, 12)]).collect()
    assert sum(bool(r["hit"]) for r in got) == 5
    for r in got:
        assert bool(r["hit"]) == bool(r["found"])
        assert [r[f"a{g}"] for g in range(1, 12)] == [r[f"b{g}"] for g in range(1, 12)], texts[r["i"]]
    raw = rows.select(F.col("i").alias("source_position"), F.col("t").alias("raw"))
    assert optimized(N.ingest(raw, F.lit("2024-02-01").cast("timestamp")).select("url", "username", "status")).count("HTTP") < 10


def test_lookups_of_a_small_feed_are_not_shuffled(spark, monkeypatch):
    """The feed's bytes are known before the events are read; a large feed gives the same rows through a shuffle."""
    events = spark.createDataFrame([(i, f"10.0.0.{i % 9}", f"h{i % 5}.bad.example") for i in range(200)], "event_id long, source_ip string, domain string")
    rows = [("10.0.0.3", "ip", "c", "t"), ("bad.example", "domain", None, "t"), ("10.0.0.4/31", "ip", "n", "t")]
    feed = spark.createDataFrame(rows * 3, "value string, kind string, category string, source string").distinct()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the plan alone does not know the feed's size
    found = D.detect(events, feed, engines=("ioc",)).select("event_id", "rule_id", "matched_value", "ioc_category")
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    got = sorted(map(tuple, found.collect()), key=str)
    monkeypatch.setattr(I, "SENT_BYTES", 0)
    other = D.detect(events, feed, engines=("ioc",)).select("event_id", "rule_id", "matched_value", "ioc_category")
    assert sorted(map(tuple, other.collect()), key=str) == got and len(got) > 200
