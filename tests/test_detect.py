import pytest
from pyspark.sql import functions as F

from emberwatch.operators import detect as D
from emberwatch.operators import indicators as I
from emberwatch.operators import rules as R
from emberwatch.sources import feeds

COLS = "event_id string, source string, source_type string, event_type string, severity string, raw_data string, url string, source_ip string, destination_ip string, domain string, hostname string, hash string, username string, status string, action string, protocol string, metadata map<string,string>"
BASE = dict(source="app", source_type="application_log", event_type="web_access", severity="low", raw_data="x", metadata={})


def frame(spark, *rows):
    names = [c.split()[0] for c in COLS.split(", ")]
    out = []
    for i, r in enumerate(rows):
        full = {**BASE, "event_id": f"e{i}", **r}
        out.append(tuple(full.get(n) for n in names))
    return spark.createDataFrame(out, COLS)


@pytest.fixture(scope="module")
def found(spark):
    rows = [
        dict(url="/search?q=1' OR '1'='1"), dict(url="/api?id=1 UNION SELECT username,password FROM users--"), dict(source_ip="203.0.113.100"),
        dict(url="/clean"), dict(domain="a.b.fake-bank-login.xyz"), dict(url="http://c2-beacon.example.net:8080/x"),
        dict(hash="44D88612FEA8A8F36DE82E1278ABB02F"), dict(url="${jndi:ldap://x}"),
        dict(source="linux.sshd", source_type="authentication", event_type="auth_failed", action="denied"),
        dict(source="suricata", source_type="network_ids", event_type="network_ids_alert", metadata={"category": "Port Scan"}),
        dict(raw_data='{"user_agent": "sqlmap/1.0", "command": "x"}'), dict(destination_ip="10.20.30.40"), dict(source_ip="2001:db8:1::5"),
        dict(url="http://evil.c2-beacon.example.net"), dict(source_ip="203.0.113.100", destination_ip="203.0.113.200"),
    ]
    feed = feeds.add_indicators(feeds.sample_feed(spark), [("10.20.0.0/16", "ip", "lab", "t"), ("2001:db8:1::/48", "ip", "v6", "t"), ("203.0.113.100", "ip", "c2_server", "test_data")])
    matches = D.detect(frame(spark, *rows), feed)
    by = {}
    for m in matches.collect():
        by.setdefault(int(m.event_id[1:]), {})[m.rule_id] = m
    return by, {int(f.event_id[1:]): f for f in D.findings(matches).collect()}


def test_text_rules(found):
    by, _ = found
    assert "regex_sqli_or_bypass" in by[0]
    m = by[1]["regex_sqli_union"]
    assert (m.matched_field, m.matched_value, m.match_start, m.match_end) == ("url", "UNION SELECT ", 10, 23)
    assert 3 not in by
    assert "regex_ua_scanner" in by[10] and by[10]["regex_ua_scanner"].matched_field == "raw_string"


def test_indicators(found):
    by, _ = found
    assert by[2]["ioc_ip_blocklist"].ioc_category == "c2_server"
    assert by[4]["ioc_domain_blocklist"].matched_value == "a.b.fake-bank-login.xyz" and by[4]["ioc_domain_blocklist"].ioc_category is None
    assert set(by[5]) == {"ioc_url_blocklist"}
    assert "ioc_hash_blocklist" in by[6] and by[6]["ioc_hash_blocklist"].severity == "critical"
    assert by[11]["ioc_ip_blocklist"].matched_field == "destination_ip"
    assert "ioc_ip_blocklist" in by[12]
    assert {"ioc_domain_blocklist", "ioc_url_blocklist"} <= set(by[13])
    assert by[14]["ioc_ip_blocklist"].matched_field == "source_ip"


def test_sigma(found):
    by, _ = found
    assert by[8]["sigma_brute_force_ssh"].matched_value == "auth_failed"
    assert "sigma_port_scan_detection" in by[9]
    assert "sigma_log4shell_jndi" not in by[7]


def test_findings(found):
    _, f = found
    assert f[0].finding_type == "sql_injection_attempt" and f[2].finding_type == "malicious_ip_communication"
    assert f[7].finding_type == "command_injection_attempt" and f[7].severity == "critical"
    assert f[7].mitre_techniques[:2] == ["T1190", "T1059"]
    assert f[6].finding_type == "malicious_file_detected" and f[8].finding_type == "brute_force_indicator"


def test_negation_and_logic(spark):
    ev = frame(spark, dict(url="a b"), dict(url="a"), dict())
    cols = ev.columns
    cond = lambda **k: R.condition_hit(R.Condition("url", ("a", "b"), **k), cols)
    rows = ev.select(cond(), cond(match_all=True), cond(negate=True), cond(negate=True, match_all=True)).collect()
    assert [tuple(r) for r in rows] == [("a", "a", None, None), ("a", None, None, "a"), (None, None, None, None)]


def test_modifiers(spark):
    ev = frame(spark, dict(url="Alpha"))
    t = lambda p, m: ev.select(R.pattern_test(F.col("url"), p, m)).first()[0]
    assert t("LPH", "contains") and t("al", "startswith") and t("HA", "endswith") and t("^a.*a$", "regex") and t("alpha", "equals")
    assert not t("alpha", "equals_exact") and not t("(", "regex")


def test_custom_rules_and_engines(spark):
    ev = frame(spark, dict(url="needle", source_ip="203.0.113.100", status="9.9.9.9"))
    rules = R.add_rule(R.default_rules(), R.regex_rule("needle", "n", "high", ["url"], "mine", tags=("t",)))
    assert [r.rule_id for r in R.rules_by_tag(rules, "t")] == ["mine"]
    assert {m.rule_id for m in D.detect(ev, None, rules, ("regex",)).collect()} == {"mine"}
    feed = feeds.add_indicators(feeds.sample_feed(spark), [("9.9.9.9", "ip", None, None)])
    got = D.detect(ev, feed, [R.ioc_rule("ip", ("status",), rule_id="c")]).collect()
    assert [(g.rule_id, g.matched_field) for g in got] == [("c", "status")]
    off = R.compile_sigma({"id": "o", "status": "deprecated", "detection": {"s": {"url": "needle"}}})
    assert D.detect(ev, None, [off, rules[-1]]).count() == 1


def test_feed_file(spark, tmp_path):
    (tmp_path / "ip_list.txt").write_text("# c\n\n1.2.3.4,c2,src\n10.0.0.0/33\n10.0.0.5/8\nnope\n")
    (tmp_path / "domain_list.txt").write_text("BAD.example\n")
    (tmp_path / "hash_list.txt").write_text("abc\n" + "A" * 32 + ",fam\n")
    rows = {r.value: r for r in feeds.read_ioc_feed(spark, str(tmp_path)).collect()}
    assert set(rows) == {"1.2.3.4", "10.0.0.5/8", "bad.example", "a" * 32}
    assert rows["a" * 32].source == "blocklist" and rows["bad.example"].category is None


def test_sigma_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "r.yml").write_text("id: r1\ntitle: T\nlevel: crit\ndetection:\n  s:\n    url|startswith: x\n  condition: s\n")
    (tmp_path / "bad.yaml").write_text("a: [")
    rules, skipped = feeds.read_sigma_rules(spark, str(tmp_path))
    assert [(r.rule_id, r.severity, r.conditions[0].modifier) for r in rules] == [("r1", "critical", "startswith")] and len(skipped) == 1


def test_catalogue(spark):
    assert {r.rule_type: r.rules for r in R.rule_counts(spark).collect()} == {"sigma": 4, "regex": 19, "ioc": 4}


def test_flattened_fields(spark):
    from emberwatch.functions import text as X
    from emberwatch.operators import rules as R
    from pyspark.sql import functions as F

    texts = ['{"a": {"b": {"c": 1}}, "l": ["p", "q"], "m": ["p", 1], "o": []}', '{"a.b": "whole", "a": {"b": "way"}}', "[1]", "no json", "", None, "{}"]
    df = spark.createDataFrame(list(enumerate(texts)), "event_id int, j string")
    got = {(r.event_id, r.field): r.value for r in X.flatten_keys(df, "j", "n", ["event_id"]).collect()}
    assert got == {(0, "n.a.b.c"): "1", (0, "n.l"): "p q", (0, "n.l_str"): "p q", (0, "n.m"): "p 1", (0, "n.o"): "", (0, "n.o_str"): "", (1, "n.a.b"): got[(1, "n.a.b")]}
    rows = df.withColumnsRenamed({"j": "raw_data"}).withColumn("normalized_data", F.col("raw_data")).withColumn("_raw", X.json_object("raw_data"))
    field = lambda name: [r[0] for r in rows.orderBy("event_id").select(R.field_column(name, ["raw_data", "normalized_data"])).collect()]
    assert field("raw_data.a.b")[:2] == ['{"c":1}', "whole"] and field("raw_data.a.b.c")[0] == "1"
    assert field("normalized_data.l_str")[0] == "p q" and field("normalized_data.m_str")[0] is None and field("normalized_data.o_str")[0] == "" and field("NORMALIZED_DATA.m")[0] == "p 1"


def test_network_prefixes(spark):
    import ipaddress

    from emberwatch.operators import indicators as I
    from pyspark.sql import functions as F

    nets = ["10.0.0.0/8", "0.0.0.0/0", "10.1.2.3/32", "255.255.255.255/1", "2001:db8::/32", "::/0", "2001:db8:0:1::/64", "2001:db8::8000:0:0:1/65", "ffff::1/128", "bad/3", "10.0.0.0/33"]
    ips = ["10.1.2.3", "200.0.0.1", "2001:db8::1", "2001:db8:0:1::9", "2001:db8::8000:0:0:2", "ffff::1", "ffff::2"]
    keys = {r.v: r.k for r in spark.createDataFrame([(n,) for n in nets], "v string").select("v", I.network_key(F.col("v")).alias("k")).collect()}
    assert keys["bad/3"] is None and keys["10.0.0.0/33"] is None
    widths = spark.createDataFrame([(n, "ip", None, None) for n in nets], "value string, kind string, category string, source string")
    lengths = I.network_lengths(widths).agg(F.collect_set("w").alias("w"))
    rows = spark.createDataFrame([(i,) for i in ips], "ip string").crossJoin(lengths).select("ip", F.explode(I.lookup_keys(F.col("ip"), "ip", F.col("w"))).alias("k")).select("ip", "k.*").collect()
    for ip in ips:
        found = {r.key for r in rows if r.ip == ip and r.key_kind == "network"}
        for n in nets[:-2]:
            inside = ipaddress.ip_address(ip) in ipaddress.ip_network(n, strict=False)
            assert (keys[n] in found) == inside, (ip, n)
