import json

import pytest
from pyspark.sql import functions as F

from emberwatch.operators import normalize as N
from emberwatch.operators import parse as P

def AS_OF():
    return F.lit("2026-09-10 00:00:00").cast("timestamp")

SURICATA = {"timestamp": "2026-09-08T22:00:00Z", "event_type": "alert", "src_ip": "192.168.1.5", "src_port": 4444, "dest_ip": "198.51.100.42",
            "dest_port": 443, "proto": "tcp", "flow_id": 99, "alert": {"action": "blocked", "signature": "ET TROJAN", "category": "Trojan", "severity": 1},
            "http": {"hostname": "bad.example.com", "url": "/gate.php"}}
AUTH = {"EventID": 4625, "TimeCreated": "2026-09-08T22:00:00Z", "TargetUserName": "bob", "TargetDomainName": "CORP", "WorkstationName": "WS1",
        "IpAddress": "10.9.8.7", "IpPort": 51000, "LogonType": 10}
MAIL = {"timestamp": 1788904800000, "sender": "x@evil.example.org", "recipient": "me@corp.example", "spf_result": "fail", "dkim_result": "pass",
        "dmarc_result": "pass", "phishing_score": 0.95, "threat_verdict": "phishing", "extracted_urls": ["http://u1", "http://u2"],
        "attachment_hashes": ["abc", "def"]}
CLOUD = {"@timestamp": "2026-09-08T22:00:00Z", "eventName": "AuthorizeSecurityGroupIngress", "source.ip": "10.1.1.1", "destination": {"ip": "2001:0db8::0001"},
         "user.name": "carol", "risk_level": "high"}

CASES = [
    (json.dumps(SURICATA), None, dict(format="suricata", event_type="network_ids_alert", severity="critical", source_ip="192.168.1.5", destination_port=443,
                                     protocol="TCP", action="blocked", status="triggered", url="http://bad.example.com/gate.php", source_type="network_ids")),
    ("<85>Sep  9 10:15:30 soc-srv sshd[14205]: Failed password for invalid user hacker from 198.51.100.25 port 55432 ssh2", None,
     dict(format="syslog", event_type="auth_failed", severity="medium", username="hacker", source_ip="198.51.100.25", source_port=55432, action="denied", status="failure",
          source="syslog.sshd", hostname="soc-srv")),
    ("Sep  9 10:15:30 host sshd[1]: Accepted publickey for admin from 10.0.1.5 port 22 ssh2", None,
     dict(format="syslog", event_type="auth_success", severity="low", username="admin", action="allowed", status="success")),
    ("Sep  9 10:15:30 fw kernel: [UFW BLOCK] IN=eth0 OUT= MAC=aa SRC=203.0.113.99 DST=10.0.0.1 LEN=60 PROTO=TCP SPT=44123 DPT=22", None,
     dict(format="syslog", event_type="firewall_drop", severity="medium", source_ip="203.0.113.99", destination_ip="10.0.0.1", source_port=44123, destination_port=22, action="blocked")),
    ("Sep  9 10:15:30 h sudo: alice : TTY=pts/0 ; PWD=/root ; USER=root ; COMMAND=/bin/ls", None,
     dict(event_type="privilege_escalation", severity="low", username="alice", action="executed", status="success")),
    ("<34>1 2026-09-09T10:15:30Z host app 99 ID1 - hello", None, dict(format="syslog", event_type="syslog_generic", severity="high", source="syslog.app")),
    (json.dumps(CLOUD), None, dict(format="json", event_type="authorizesecuritygroupingress", severity="high", source_ip="10.1.1.1", destination_ip="2001:db8::1",
                                   username="carol", source="json_stream", source_type="generic_json")),
    ('203.0.113.7 - - [10/Oct/2026:13:55:36 +0000] "GET /products?category=1%27%20UNION HTTP/1.1" 200 4521 "-" "curl/8"', None,
     dict(format="application", event_type="web_sqli_attempt", severity="high", status="success", action="allowed", url="/products?category=1%27%20UNION")),
    ('10.0.0.9 - user1 [10/Oct/2026:13:55:36 +0000] "POST /api/login HTTP/1.1" 401 128 "-" "x"', None,
     dict(event_type="web_unauthorized", severity="medium", action="denied", username="user1", status="failure")),
    ("2026-09-08 10:00:00,123 ERROR [db.pool] lost", None, dict(format="application", event_type="app_error", severity="high", source="application.db.pool", status="error")),
    (json.dumps(AUTH), None, dict(format="authentication", event_type="user_logon_failed", severity="high", action="denied", status="failure", username="bob",
                                  domain="CORP", hostname="WS1", source_ip="10.9.8.7", source_port=51000, source="windows_security_event_4625")),
    (json.dumps(MAIL), None, dict(format="email", event_type="email_phishing_detected", severity="high", action="blocked", status="detected", url="http://u1",
                                  hash="abc", domain="evil.example.org", username="x@evil.example.org", source="email_gateway")),
    ("plain words", None, dict(format="unknown", error_type="unknown_source_format")),
    ("{broken", "json", dict(format="json", error_type="parsing_exception")),
    (json.dumps({"name": "x" * 200}), None, dict(format="json", error_type="normalization_exception")),
]


@pytest.fixture(scope="module")
def rows(spark):
    raw = spark.createDataFrame([(i, r, h) for i, (r, h, _) in enumerate(CASES)], "source_position int, raw string, source_type string")
    return {r.source_position: r for r in N.ingest(raw, AS_OF()).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_formats(rows, i):
    for key, want in CASES[i][2].items():
        assert rows[i][key] == want, key


def test_times_and_metadata(rows):
    assert str(rows[0].timestamp) == "2026-09-08 22:00:00"
    assert str(rows[1].timestamp) == "2026-09-09 10:15:30"
    assert str(rows[11].timestamp) == "2026-09-08 22:00:00"
    assert rows[10].metadata["logon_type_desc"] == "RemoteInteractive (RDP)"
    assert rows[4].metadata["command"] == "/bin/ls"
    block = json.loads(rows[0].normalized_data)
    assert block["suricata"]["signature"] == "ET TROJAN" and block["network"]["source"]["ip"] == "192.168.1.5"
    assert "user" not in block


def test_split_and_summary(spark):
    raw = spark.createDataFrame([(c[0], c[1]) for c in CASES], "raw string, source_type string")
    done = N.ingest(raw, AS_OF())
    total = N.ingest_summary(done).first()
    assert (total.total, total.accepted, total.rejected) == (15, 12, 3)
    assert N.accepted(done).count() == 12 and N.dead_letters(done).count() == 3
    assert N.query_dead_letters(N.dead_letters(done), error_type="parsing_exception").count() == 1


def test_plan_is_one_narrow_pass(spark):
    raw = spark.createDataFrame([("a", None)], "raw string, source_type string")
    plan = N.ingest(raw, AS_OF())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan.replace("ExistingRDD", "")


def test_source_override_skips_detection(spark):
    raw = spark.createDataFrame([(json.dumps(MAIL), "json")], "raw string, source_type string")
    assert N.ingest(raw, AS_OF()).first().format == "json"


def test_catalogue(spark):
    assert P.source_catalogue(spark).count() == 6


def pairs_format(**changed):
    part = lambda i: F.nullif(F.get(F.split("raw", ";"), F.lit(i)), F.lit(""))
    fields = {"timestamp": part(1), "source": F.lit("pairs"), "source_type": F.lit("pair_log"), "event_type": part(2), "source_ip": part(3), "severity": part(4), "action": part(5)}
    return P.Format({**fields, **changed}, F.col("raw").startswith("pair;"), "pair_parser", "3.0")


def test_a_registered_format_is_parsed_and_normalised(spark):
    forms = P.Formats().register(" Pairs ", pairs_format())
    rows = [("pair;2026-09-09T10:00:00Z;probe;10.0.0.7:80;warning;drop", None), ("pair;2026-09-09T10:00:00Z;;10.0.0.7;;", None),
            ("pair;;;x;;", None), ("2026;2026-09-09T10:00:00Z;hinted;;;", "PAIRS"), ('{"src": "10.0.0.1", "name": "n"}', None), (None, None)]
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "source_position int, raw string, source_type string")
    done = {r.source_position: r for r in N.ingest(raw, AS_OF(), forms).collect()}
    first = done[0]
    assert (first.format, first.event_type, first.source, first.source_type, first.source_ip, first.severity, first.action) == ("pairs", "probe", "pairs", "pair_log", "10.0.0.7", "medium", "drop")
    assert str(first.timestamp) == "2026-09-09 10:00:00" and first.parser_version == "3.0" and first.error_type is None
    assert first.metadata["parser_name"] == "pair_parser" if "parser_name" in first.metadata else True
    assert set(N.EVENT_COLUMNS) <= set(first.asDict())
    assert (done[1].error_type, done[1].error_message) == ("parsing_exception", "Parsing exception: no event_type")
    assert done[2].error_message == "Parsing exception: no timestamp, event_type"
    assert (done[3].format, done[3].event_type, done[3].severity) == ("pairs", "hinted", "low")
    assert (done[4].format, done[4].source_ip) == ("json", "10.0.0.1")
    assert done[5].format == "unknown"
    assert P.source_catalogue(spark, forms).count() == 7


def test_a_registered_format_takes_a_built_in_place(spark):
    forms = P.Formats().register("json", P.Format({"timestamp": F.lit("2026-01-02T00:00:00Z"), "source": F.lit("mine"), "source_type": F.lit("own"), "event_type": F.get_json_object("raw", "$.kind")}))
    raw = spark.createDataFrame([('{"kind": "k1"}',), ('{"other": 1}',)], "raw string")
    got = N.ingest(raw, AS_OF(), forms).collect()
    assert [(r.format, r.source, r.event_type, r.error_type) for r in got] == [("json", "mine", "k1", None), ("json", "mine", None, "parsing_exception")]


def test_a_format_without_its_parts_is_refused():
    with pytest.raises(ValueError, match="event_type"):
        P.Format({"timestamp": F.lit("x"), "source": F.lit("x"), "source_type": F.lit("x")})
    with pytest.raises(ValueError, match="colour"):
        pairs_format(colour=F.lit("red"))
    with pytest.raises(ValueError, match="accepts"):
        P.Formats().register("new", P.Format(pairs_format().fields))
