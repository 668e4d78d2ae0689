import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberwatch.operators import chains as C
from emberwatch.operators import correlate as K

T0 = datetime(2026, 1, 1)


def greedy(times, window):
    out, anchor = {}, None
    for t in sorted(times):
        if anchor is None or t - anchor > window:
            anchor = t
        out[t] = anchor
    return out


@pytest.mark.parametrize("partitions", [None, 7])
@pytest.mark.parametrize("keys", [(), ("k",)])
def test_time_groups_equal_greedy(spark, partitions, keys):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        at = rng.choice([rng.randrange(20_000), 60_000 + rng.randrange(4000), 3600 * rng.randrange(9)])
        rows.append((f"f{i}", rng.choice("ab"), T0 + timedelta(seconds=at)))
    check_groups(spark, rows, keys, partitions)


def check_groups(spark, rows, keys, partitions, minutes=60):
    df = spark.createDataFrame(rows, "finding_id string, k string, timestamp timestamp")
    got = {r.finding_id: r.group_start for r in K.time_groups(df, minutes, keys, partitions).collect()}
    assert len(got) == len(rows)
    for key in {r[1] for r in rows} if keys else (None,):
        mine = [r for r in rows if not keys or r[1] == key]
        want = greedy([r[2] for r in mine if r[2] is not None], timedelta(minutes=minutes))
        for r in mine:
            assert got[r[0]] == want.get(r[2])


@pytest.mark.parametrize("joins", ["-1", "10MB"])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_time_groups_hot_key_and_settings(spark, joins, adaptive):
    """One key over many blocks, dense and sparse stretches, a null key and a null time, under forced plans, twice each."""
    rng = random.Random(11)
    rows, at = [], 0
    for i in range(900):
        at += rng.choice([1, 1, 1, 40, 700]) if i % 300 else 9000
        rows.append((f"f{i}", "hot", T0 + timedelta(seconds=at)))
    rows += [(f"g{i}", None if i % 2 else f"k{i % 5}", T0 + timedelta(seconds=rng.randrange(9000))) for i in range(60)] + [("none", "hot", None)]
    held = {n: spark.conf.get(n) for n in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        for _ in range(2):
            check_groups(spark, rows, ("k",), 9, minutes=10)
    finally:
        for n, v in held.items():
            spark.conf.set(n, v)


def test_pair_scores(spark):
    rows = [("f1", "phishing", "email", T0, "medium", {"source_ip": "1.1.1.1", "username": "u"}), ("f2", "credential_theft", "auth", T0 + timedelta(minutes=2), "high", {"source_ip": "1.1.1.1", "username": "u"}),
            ("f3", "phishing", "email", T0 + timedelta(hours=5), "low", {"source_ip": "9.9.9.9"})]
    df = spark.createDataFrame(rows, "finding_id string, finding_type string, source string, timestamp timestamp, severity string, indicators map<string,string>")
    out = K.correlate(df, min_score=0.1).collect()
    assert len(out) == 1
    r = out[0]
    assert r.finding_count == 2 and r.severity == "high" and r.classification == "credential_phishing"
    assert abs(r.correlation_score - (0.075 + 0.075 + 0.08 * 0.6 + 0.04)) < 1e-9
    assert r.attack_chain == ["initial_access", "credential_activity"]
    assert r.reasoning.startswith("Correlated 2 findings from 2 sources. Shared indicators: 1 shared ip(s), 1 shared user(s).")
    assert K.correlate(df).count() == 0


def fold(events):
    taken = []
    for t, i, ty in sorted(events):
        st = stage(ty)
        if st is None or st in [s for s, _ in taken]:
            continue
        if not taken or C.STAGES.index(st) >= C.STAGES.index(taken[-1][0]):
            taken.append((st, i))
    return taken


def stage(ty):
    return next((s for w, s in C.STAGE_WORDS if w in ty), None)


def test_kill_chain_equals_fold(spark):
    rng = random.Random(5)
    words = [w for w, _ in C.STAGE_WORDS] + ["noise"]
    rows = [(i, f"h{rng.randrange(12)}", T0 + timedelta(seconds=rng.randrange(5000)), rng.choice(words), "medium", f"10.0.0.{i % 5}", "10.1.1.1", "u") for i in range(150)]
    df = spark.createDataFrame(rows, "event_id int, host string, timestamp timestamp, event_type string, severity string, source_ip string, destination_ip string, username string")
    got = {r.host: (r.stages, r.event_ids) for r in C.kill_chains(df, ["host"]).collect()}
    for host in {r[1] for r in rows}:
        want = fold([(r[2], r[0], r[3]) for r in rows if r[1] == host])
        if len(want) >= 3:
            assert got[host] == ([s for s, _ in want], [i for _, i in want])
        else:
            assert host not in got


def test_entities_and_primary(spark):
    rows = [(i, "auth", T0 + timedelta(seconds=i), "low", "1.1.1.1", f"10.0.0.{i % 3}", "u") for i in range(12)] + [(99, "auth", T0 - timedelta(hours=3), "critical", "1.1.1.1", "x", "u")]
    df = spark.createDataFrame(rows, "event_id int, event_type string, timestamp timestamp, severity string, source_ip string, destination_ip string, username string")
    as_of = F.lit(T0 + timedelta(minutes=10))
    src = C.entity_correlation(df, "source", as_of).collect()
    assert [(r.entity, r.event_count, r.unique_partners, r.severity, r.time_span_sec) for r in src] == [("1.1.1.1", 12, 3, "high", 11.0)]
    best = C.primary_correlation(C.all_correlations(df, as_of)).collect()
    assert best[0].finding_type == "source_correlation"
