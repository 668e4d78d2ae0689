import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberwatch.functions import sql as SQL
from emberwatch.operators import normalize as N
from emberwatch.operators import retrieve as R
from emberwatch.operators import routing as G
from emberwatch.operators import validate as V
from emberwatch.sources import dims, raw, sinks

T0 = datetime(2026, 1, 1)


def test_raw_readers_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"vendor": "v", "name": "x", "time": "2026-01-05T00:00:00Z"}\n\nplain\n')
    rows = raw.read_raw_batch(spark, str(tmp_path / "in"))
    assert rows.count() == 2
    assert {r.source_type for r in raw.read_syslog(spark, str(tmp_path / "in")).collect()} == {"syslog"}
    assert raw.read_syslog(spark, str(tmp_path / "in"), "json").first().source_type == "json"
    with pytest.raises(ValueError):
        raw.bound_reader("nope")
    done = N.ingest(rows, F.lit(T0))
    out = str(tmp_path / "ev")
    sinks.write_events(N.accepted(done), out)
    stored = spark.read.parquet(out)
    assert stored.count() == 1 and json.loads(stored.first().raw_data)["vendor"] == "v"
    sinks.write_events(N.accepted(done), out, known=stored)
    assert spark.read.parquet(out).count() == 1
    sinks.write_dead_letters(N.dead_letters(done), str(tmp_path / "dl"))
    assert spark.read.parquet(str(tmp_path / "dl")).first().raw_payload == "plain"
    sinks.publish(N.accepted(done), "event_id", path=str(tmp_path / "msg"), headers={"kind": F.lit("x")})
    msg = spark.read.parquet(str(tmp_path / "msg")).first()
    assert json.loads(msg.value)["source"] == "v" and msg.headers[0].key == "kind"
    assert sinks.recent_events(N.accepted(done), F.lit(T0 + timedelta(minutes=5))).count() == 1
    assert sinks.recent_events(N.accepted(done), F.lit(T0 + timedelta(hours=5))).count() == 0


def test_undecodable_bytes_are_kept(spark):
    df = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"a\xffb"),)], "b binary")
    texts = [r.raw for r in raw.raw_from_bytes(df, "b").collect()]
    assert texts[0] == "ok" and texts[1].startswith("a") and texts[1].endswith("b") and len(texts[1]) == 3


def test_replay_gives_the_same_ids(spark):
    df = spark.createDataFrame([("p1", "line x"), ("p2", "line x")], "source_position string, raw string")
    one = [r.event_id for r in N.ingest(df, F.lit(T0)).orderBy("source_position").collect()]
    two = [r.event_id for r in N.ingest(df, F.lit(T0)).orderBy("source_position").collect()]
    assert one == two and one[0] != one[1]


def test_dimensions_and_sql_functions(spark):
    tables = dims.dimensions(spark)
    counts = {n: tables[n].count() for n in ("mitre_technique", "sla", "response_action", "knowledge_chunk", "rule", "source")}
    assert counts == {"mitre_technique": 10, "sla": 5, "response_action": 12, "knowledge_chunk": 9, "rule": 27, "source": 6}
    SQL.register_functions(spark)
    row = spark.sql("SELECT severity_rank('high') a, norm_port(' 80 ') b, norm_port('x') c, is_private_ip('172.20.1.1') d, is_private_ip('8.8.8.8') e, host_of('http://A.b:1/x') f").first()
    assert tuple(row) == (3, 80, None, True, False, "a.b")


def test_validation_edges(spark):
    base = {"event_id": "e", "timestamp": "2026-01-01T00:00:00Z", "source": "s", "source_type": "t", "event_type": "x", "severity": "HIGH", "raw_data": {}, "normalized_data": {}}
    cases = [(base, True)] + [({k: v for k, v in base.items() if k != drop}, False) for drop in base]
    cases += [({**base, "timestamp": t}, False) for t in ("not-a-timestamp", "2026-99-99T99:99:99Z", "2026/09/08 25:00:00", "", None, {})]
    cases += [({**base, "source_ip": ip}, False) for ip in ("999.999.999.999", "256.1.1.1", "192.168.1.1.1", "not_an_ip", "1234::gggg", "192.168.1.1:8080")]
    cases += [({**base, "source_ip": ip}, True) for ip in ("10.0.0.1", "::1", "2001:0db8:0000:0000:0000:0000:0000:0001", "fe80::1", "")]
    cases += [({**base, "metadata": m}, False) for m in ("x", [1], 5, True)] + [({**base, "metadata": None}, True), ({**base, "timestamp": 1767225600}, True)]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(900, "[1]"), (901, "{" + "x" * 1_100_000), (902, None)], "i int, raw string")
    got = {r.i: r for r in V.validate_events(df).collect()}
    for i, (c, want) in enumerate(cases):
        assert got[i].is_valid == want, c
    assert [got[i].validation_errors[0].type for i in (900, 901, 902)] == ["type_error", "oversized_payload", "value_error"]


def test_custom_route(spark):
    df = spark.createDataFrame([("1", "x", "y", "low", {"cidr": "a"}, None)], "event_id string, source_type string, event_type string, severity string, metadata map<string,string>, hash string")
    routes = (*G.DEFAULT_ROUTES, G.Route("mine", "vulnerability", 200, condition=lambda: F.map_contains_key("metadata", "cidr")))
    assert G.route_events(df, routes).first().domain_agent == "vulnerability"


def test_chunk_store_and_knowledge(spark, tmp_path):
    chunks = R.default_knowledge(spark)
    R.save_chunks(chunks, str(tmp_path / "c"))
    asked = spark.createDataFrame([("q", "Brute Force techniques to gain access to accounts when passwords are unknown")], "query_id string, query_text string")
    found = R.retrieve(asked, R.load_chunks(spark, str(tmp_path / "c")), 2, 0.1, "mitre")
    rows = found.orderBy("rank").collect()
    assert rows[0].source == "mitre_attack_T1110" and [r["rank"] for r in rows] == [1, 2]
    assert R.contexts(found).first().context.startswith("[Source: mitre_attack_T1110, Score: ")


def test_vector_slots_follow_md5(spark):
    import hashlib

    words = ["alpha", "été", "x_1", "42"]
    got = spark.createDataFrame([(" ".join(words),)], "t string").select(R.token_slots("t")).first()[0]
    assert got == [int(hashlib.md5(w.encode()).hexdigest(), 16) % 384 for w in words]
