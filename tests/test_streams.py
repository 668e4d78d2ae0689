import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberwatch.operators import correlate as K
from emberwatch.operators import logs as L
from emberwatch.operators import network as N
from emberwatch.sources import feeds
from emberwatch.sources.raw import read_raw_stream
from emberwatch.streaming import flows as S
from emberwatch.streaming import state as ST

T0 = datetime(2026, 1, 1)
SCHEMA = "event_id string, timestamp timestamp, source_ip string, destination_ip string, destination_port int, bytes_out long, username string, event_type string, status string, action string, message string, windows_id string"


def rows():
    out = []
    for i in range(120):
        at = T0 + timedelta(seconds=(i * 37) % 900)
        out.append((f"e{i:03d}", at, f"1.1.1.{i % 3}", "8.8.8.8", 1000 + i % 17, 1000 * i, "u", "auth_failed" if i % 2 else "view", "ok", "allowed", "", ""))
    return out


# pushes the watermark past everything
LAST = ("zzz", T0 + timedelta(days=3), "9.9.9.9", "9.9.9.8", 1, 1, "u", "auth_failed", "ok", "allowed", "", "")


def as_stream(spark, folder, chunks, schema=SCHEMA):
    for i, chunk in enumerate(chunks):
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def run(df, folder, mode="append"):
    q = df.writeStream.format("memory").queryName("q_" + folder.name.replace("-", "_")).outputMode(mode).option("checkpointLocation", str(folder / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table("q_" + folder.name.replace("-", "_")).collect()


@pytest.fixture()
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("stream")


def test_brute_force_stream_equals_batch(spark, folder):
    data = rows()
    stream = as_stream(spark, folder, [data[:60], data[60:], [LAST]])
    got = {(r.event_id, r.hits) for r in run(S.brute_force_stream(stream, 4, 60, "30 minutes"), folder)}
    batch = L.brute_force(spark.createDataFrame(data, SCHEMA), 4, 60).collect()
    assert got == {(r.event_id, int(r.actual)) for r in batch} and got


def test_pairs_stream_equals_batch(spark, folder):
    data = rows() + [(f"b{i:02d}", T0 + timedelta(seconds=60 * i + i % 2), "2.2.2.2", "8.8.4.4", 0, 0, "u", "view", "ok", "allowed", "", "") for i in range(12)]
    data += [("n1", T0, "", "8.8.8.8", 5, 10**9, "u", "view", "ok", "allowed", "", ""), ("n2", T0, "3.3.3.3", None, 5, 10**9, "u", "view", "ok", "allowed", "", "")]
    stream = as_stream(spark, folder, [data[::2], data[1::2], [LAST]])
    got = sorted((r.event_id, r.threat_type, r.value) for r in run(ST.running_pairs(stream, 10, 500_000, delay="30 minutes"), folder))
    df = spark.createDataFrame(data, SCHEMA)
    want = [(r.event_id, "port_scan", r.unique_ports) for r in N.port_scans(df, 10).collect()] + [(r.event_id, "data_exfiltration", r.bytes_transferred) for r in N.exfiltration(df, 500_000).collect()]
    want += [(r.event_id, "beaconing", r.connection_count) for r in N.beacons(df).collect()]
    assert got == sorted(want) and {t for _, t, _ in want} == {"port_scan", "data_exfiltration", "beaconing"}


class Store:
    """State of one key in memory, with the calls the processors use."""

    def __init__(self):
        self.maps, self.values, self.timers = {}, {}, set()

    def getMapState(self, name, *schemas):
        held = self.maps.setdefault(name, {})

        class Map:
            updateValue = staticmethod(held.__setitem__)
            getValue = staticmethod(held.__getitem__)
            removeKey = staticmethod(held.__delitem__)
            keys = staticmethod(lambda: list(held))
            clear = staticmethod(held.clear)

        return Map

    def getValueState(self, name, schema):
        held = self.values

        class Value:
            exists = staticmethod(lambda: name in held)
            get = staticmethod(lambda: held[name])
            update = staticmethod(lambda v: held.__setitem__(name, v))
            clear = staticmethod(lambda: held.pop(name, None))

        return Value

    def registerTimer(self, ms):
        self.timers.add(ms)


class At:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def fed(processor, batches):
    """Output of a processor over batches of rows, and the largest entry it ever wrote; its state must be gone at the end."""
    store, out, largest = Store(), [], 0
    processor.init(store)
    for pdf in batches:
        list(processor.handleInputRows(("k",), iter([pdf]), At(0)))
        largest = max([largest, *(len(v[0]) for m in ("pending", "past") for v in store.maps.get(m, {}).values())])
    for ms in sorted(store.timers):
        out += list(processor.handleExpiredTimer(("k",), At(ms), None))
    while left := [t for t in store.timers if t > ms]:
        ms = min(left)
        out += list(processor.handleExpiredTimer(("k",), At(ms), None))
        largest = max([largest, *(len(v[0]) for v in store.maps.get("past", {}).values())])
    assert not any(store.maps.values()) and set(store.values) <= {"chunks"}
    return out, largest


def test_hot_key_keeps_small_entries():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    us = rng.integers(0, 40_000_000, 100_000)
    us[:50_000] = 5_000_000  # half of them at one instant
    rng.shuffle(us)
    pdf = pd.DataFrame({"us": us, "event_id": [f"e{i}" for i in range(len(us))]})
    out, largest = fed(ST.Sliding(20_000, 3_000_000), [pdf.iloc[i::7] for i in range(7)])
    got = pd.concat(out)
    ordered = np.sort(us)
    hits = np.searchsorted(ordered, us, side="right") - np.searchsorted(ordered, us - 3_000_000, side="left")
    assert largest <= ST.CHUNK and dict(zip(got.event_id, got.hits)) == {e: h for e, h in zip(pdf.event_id, hits) if h >= 20_000}

    flows = pdf.assign(port=us % 50 + 1, sent=1, talks=1)  # port 0 is no port
    out, largest = fed(ST.Pairs(50, 99_990, 10**9, 0.1, 5, 3), [flows.iloc[i::3] for i in range(3)])
    got = pd.concat(out)
    assert largest <= ST.CHUNK and (got.threat_type == "data_exfiltration").sum() == 11 and (got.threat_type == "port_scan").sum() > 90_000


def test_silent_pair_starts_anew():
    import pandas as pd

    us = [0, 1_000_000, 2_000_000, 500_000_000, 501_000_000]
    pdf = pd.DataFrame({"us": us, "event_id": list("abcde"), "port": [1, 2, 3, 1, 2], "sent": 1, "talks": 1})
    out, _ = fed(ST.Pairs(3, 100, 60_000_000, 0.1, 50, 3), [pdf])
    assert [(r.event_id, r.threat_type, r.value) for r in pd.concat(out).itertuples()] == [("c", "port_scan", 3)]


def test_groups_stream_equals_batch(spark, folder):
    data = [(f"f{i}", T0 + timedelta(minutes=(i * 13) % 400), "k") for i in range(40)]
    stream = as_stream(spark, folder, [data[:20], data[20:], [("z", T0 + timedelta(days=9), "other")], [("z2", T0 + timedelta(days=10), "other")]], "event_id string, timestamp timestamp, k string")
    got = {(r.start_us, r.findings) for r in run(ST.anchored_groups(stream, "k", 60, "10 hours"), folder) if r.key == "k"}
    batch = K.time_groups(spark.createDataFrame(data, "finding_id string, timestamp timestamp, k string"), 60, ["k"])
    want = {(r.us, r["count"]) for r in batch.groupBy(F.unix_micros("group_start").alias("us")).count().collect()}
    assert got == want and want


def test_duplicates_and_collapse(spark, folder):
    data = rows()[:10]
    stream = as_stream(spark, folder, [data, data])
    assert len(run(S.deduplicated(stream), folder)) == 10


def test_collapse(spark, folder):
    schema = "rule_id string, source_ip string, timestamp timestamp"
    stream = as_stream(spark, folder, [[("r", "1", T0), ("r", "1", T0 + timedelta(seconds=30)), ("r", "2", T0)], [("r", "1", T0 + timedelta(seconds=40))]], schema)
    assert len(run(S.collapsed_alerts(stream), folder)) == 2


def test_live_throughput(spark, folder):
    stream = as_stream(spark, folder, [rows(), [LAST], [(*LAST[:1], LAST[1] + timedelta(days=1), *LAST[2:])]])
    got = run(S.live_throughput(stream), folder)
    assert sum(r.events for r in got) == 121


def test_ingest_stream(spark, folder):
    (folder / "raw").mkdir()
    line = lambda t, n: json.dumps({"@timestamp": t, "name": n})
    (folder / "raw" / "1.txt").write_text("\n".join([line("2026-01-05T00:00:00Z", "a"), "no form", line("2026-01-05T00:01:00Z", "b")]) + "\n")
    as_of = F.lit("2026-02-01").cast("timestamp")
    args = dict(as_of=as_of, delay_sec=3600, marks_path=str(folder / "marks"), available_now=True)
    paths = (str(folder / "ev"), str(folder / "dl"), str(folder / "cp"))
    S.start_ingest(read_raw_stream(spark, str(folder / "raw")), *paths, **args).awaitTermination()
    (folder / "raw" / "2.txt").write_text("\n".join([line("2026-01-01T00:00:00Z", "late"), line("2026-01-05T00:30:00Z", "c")]) + "\n")
    S.start_ingest(read_raw_stream(spark, str(folder / "raw")), *paths, **args).awaitTermination()
    assert {r.event_type for r in spark.read.parquet(paths[0]).collect()} == {"a", "b", "c"}
    assert sorted(r.error_type for r in spark.read.parquet(paths[1]).collect()) == ["late_event", "unknown_source_format"]


def test_detection_enrichment_and_alert_streams(spark, folder):
    from emberwatch.operators import intel as T

    schema = "event_id string, timestamp timestamp, source string, source_type string, event_type string, raw_data string, url string, source_ip string"
    ev = [("e1", T0, "app", "web", "web", "x", "/?q=1 or 1=1", "203.0.113.100"), ("e2", T0, "app", "web", "web", "x", "/", "45.33.32.156"), ("e3", T0, "app", "web", "web", "x", "/", "7.7.7.7")]
    feeds.sample_feed(spark).write.parquet(str(folder / "feed"))
    S.start_detection(as_stream(spark, folder, [ev], schema), str(folder / "m"), str(folder / "f"), str(folder / "cp"), str(folder / "feed"), available_now=True).awaitTermination()
    found = {r.event_id: r.finding_type for r in spark.read.parquet(str(folder / "f")).collect()}
    assert found == {"e1": "sql_injection_attempt", "e2": "malicious_ip_communication"}
    T.sample_provider(spark).write.parquet(str(folder / "prov"))
    events = spark.readStream.schema(schema).parquet(f"{folder}/in")
    S.start_enrichment(events, str(folder / "prov"), ["mock_provider"], str(folder / "en"), str(folder / "cp2"), True).awaitTermination()
    rep = {r.event_id: {e.reputation for e in r.enrichments} for r in spark.read.parquet(str(folder / "en")).collect()}
    assert rep["e2"] == {"malicious", "unknown"} and rep["e3"] == {"unknown"}
    seen = []
    fs = spark.read.parquet(str(folder / "f")).schema
    S.start_alerts(spark.readStream.schema(fs).parquet(str(folder / "f")), lambda df, i: seen.extend(df.collect()), str(folder / "cp3"), True).awaitTermination()
    assert {a.severity for a in seen} == {"high"} and len(seen) == 2
