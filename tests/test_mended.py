"""Empty inputs, whole results, bounds that reach the scan, narrowing, ids across batches."""

import json
import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch import session
from emberwatch.operators import audit, cases, changelog, chains, investigate, metrics, normalize, respond, retrieve
from emberwatch.sources import feeds, sinks


@pytest.mark.parametrize("job, schema", [
    (cases.alert_counts, "severity string, status string, category string"), (cases.incident_counts, "status string, severity string, incident_type string"),
    (investigate.investigation_counts, "status string, priority string"), (audit.finding_counts, "severity string, category string, status string"),
])
def test_counts_of_nothing_have_a_total(spark, job, schema):
    assert [tuple(r) for r in job(spark.createDataFrame([], schema)).collect()] == [("total", None, 0)]


def test_counts_by_keeps_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 1)], "x string, y int")
    got = sorted(map(tuple, changelog.counts_by(df, "x", "y").collect()), key=repr)
    assert got == sorted([("x", "a", 2), ("x", None, 1), ("y", "1", 2), ("y", None, 1), ("total", None, 3)], key=repr)


def test_every_target_gets_its_action(spark):
    hosts = [f"h{i}" for i in range(40)]
    df = spark.createDataFrame([(1, "malware", "other", "low", hosts, hosts, hosts, hosts)], "incident_id int, threat_type string, classification string, severity string, affected_hosts array<string>, affected_users array<string>, malicious_ips array<string>, malicious_domains array<string>")
    count = lambda d: {r.action: r.n for r in respond.action_rows(d).groupBy("action").agg(F.count("*").alias("n")).collect()}
    assert count(respond.plan_actions(df))["isolate_host"] == 40
    assert count(respond.plan_actions(df, max_targets=3))["isolate_host"] == 3


def test_listings_are_whole_without_a_limit(spark):
    letters = spark.range(700).select(F.concat(F.lit("d"), "id").alias("dead_letter_id"), F.current_timestamp().alias("timestamp"), F.lit("x").alias("error_type"))
    assert normalize.query_dead_letters(letters).count() == 700
    assert normalize.query_dead_letters(letters, limit=600).count() == 600


def test_an_empty_feed_stays_empty(spark, tmp_path):
    (tmp_path / "domains.txt").write_text("\n")
    assert feeds.read_ioc_feed(spark, str(tmp_path)).count() == 0
    assert feeds.read_ioc_feed(spark, str(tmp_path), feeds.sample_feed(spark)).count() == feeds.sample_feed(spark).count()


def test_iterative_jobs_demand_a_shared_folder(monkeypatch):
    class Nothing:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})()
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None)})()

    with pytest.raises(ValueError):
        session.checkpoint_dir(Nothing())


def pushed(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "PushedFilters" in line]


def test_time_bounds_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "e")
    spark.range(10).select("id", F.timestamp_seconds(F.col("id") * 60 + 1704067200).alias("timestamp"), F.col("id").cast("string").alias("source_ip"), F.lit("x").alias("event_type")).withColumn(
        "ts", F.col("timestamp").cast("timestamp_ntz")).withColumn("ingestion_timestamp", F.col("timestamp")).withColumns({c: F.lit("a") for c in ("destination_ip", "username", "severity", "source", "source_type", "event_id")}).write.parquet(path)
    events, now = spark.read.parquet(path), F.lit("2024-01-01 00:05:00").cast("timestamp")
    assert metrics.events_per_second(events, now, "ts", 120).first()[0] == 0.02  # 3 / 120, half to even
    for job in (metrics.events_per_second(events, now, "ts", 120), metrics.recent_error_rate(events, now, F.lit(True), "ts", 120), sinks.recent_events(events, now, 120), chains.entity_correlation(events, "source", now, 1, 120)):
        assert any("Greater" in line for line in pushed(job)), pushed(job)


@pytest.mark.parametrize("values", [[5.0], [1.0, 1.0, 1.0], [1e300, 1.0, 2.0, -1e300, 0.0], list(np.random.default_rng(1).lognormal(0, 9, 3000)), [float(x % 7) for x in range(500)]])
def test_order_statistics_by_narrowing(spark, values, monkeypatch):
    monkeypatch.setattr(metrics, "BINS", 8)
    random.Random(0).shuffle(values)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    got = metrics.order_statistics(df, "v", shares, accuracy=20).first()
    ranked = sorted(values)
    assert list(got) == [ranked[min(math.floor(len(ranked) * p), len(ranked) - 1)] for p in shares.values()]


def test_order_statistics_of_nothing(spark):
    assert list(metrics.order_statistics(spark.createDataFrame([], "v double"), "v", {"a": 0.5}).first()) == [None]


def test_top_k_with_many_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 16)
    monkeypatch.setattr(retrieve, "CHUNK_BLOCK", 10)
    rng = np.random.default_rng(3)
    q, x = rng.integers(-2, 3, (90, 4)).astype(float), rng.integers(-2, 3, (70, 4)).astype(float)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id int, embedding array<double>")
    chunks = spark.createDataFrame([(f"c{i:03d}", v.tolist()) for i, v in enumerate(x)], "chunk_id string, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.chunk_id) for r in retrieve.top_k(queries, chunks, 5).collect())
    want = [(i, n + 1, c) for i in range(90) for n, (_, c) in enumerate(sorted((-float(q[i] @ x[j]), f"c{j:03d}") for j in range(70))[:5])]
    assert got == sorted(want)
    assert retrieve.top_k(queries.limit(0), chunks, 5).count() == 0 and retrieve.top_k(queries, chunks.limit(0), 5).count() == 0


def test_an_id_is_stored_once_over_batches(spark, tmp_path):
    from emberwatch.sources.raw import read_raw_stream
    from emberwatch.streaming import flows

    folder = tmp_path / "raw"
    folder.mkdir()
    one = json.dumps({"timestamp": "2026-01-05T00:00:00Z", "event_type": "a", "source_ip": "1.1.1.1", "event_id": "same"})
    paths = (str(tmp_path / "ev"), str(tmp_path / "dl"), str(tmp_path / "cp"))
    stored = None
    for name in ("1.txt", "2.txt"):
        (folder / name).write_text(one + "\n")
        flows.start_ingest(read_raw_stream(spark, str(folder)), *paths, as_of=F.lit("2026-02-01").cast("timestamp"), available_now=True).awaitTermination()
        rows = spark.read.parquet(paths[0]).select("event_id").collect()
        assert len({r.event_id for r in rows}) == len(rows)
        stored = stored or rows
    assert stored and datetime
