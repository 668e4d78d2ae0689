"""Queries: rule detection, indicator lookups, findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import detect as D
from ..operators import rules as R
from ..sources import feeds
from .base import EV, RULES, canon, query, rank, table

# a feed taken from the data itself: listed addresses, networks, names and hashes
FEED_SQL = """fd0(value, kind, category) AS (
 SELECT DISTINCT destination_ip, 'ip', 'seen' FROM ev WHERE destination_ip IN ('203.0.113.100', '203.0.113.200')
 UNION ALL SELECT DISTINCT '192.168.0.0/16', 'ip', 'lab' FROM ev WHERE destination_ip LIKE '192.168.%'
 UNION ALL SELECT DISTINCT '198.51.100.32/28', 'ip', 'range' FROM ev WHERE destination_ip LIKE '198.51.100.%'
 UNION ALL SELECT DISTINCT domain, 'domain', 'name' FROM ev WHERE domain IN ('c2-beacon.example.net')
 UNION ALL SELECT DISTINCT 'fake-bank-login.xyz', 'domain', 'parent' FROM ev WHERE domain LIKE '%.fake-bank-login.xyz'
 UNION ALL SELECT DISTINCT lower(hash), 'hash', 'file' FROM ev WHERE lower(hash) IN ('44d88612fea8a8f36de82e1278abb02f', 'd41d8cd98f00b204e9800998ecf8427e'))"""


def feed_of(events: DataFrame) -> DataFrame:
    """Indicators drawn from the events themselves in one pass (a handful of distinct values)."""
    dst, dom, h = F.col("destination_ip"), F.col("domain"), F.lower("hash")
    row = lambda test, value, kind, cat: F.when(test, F.struct(value.alias("value"), F.lit(kind).alias("kind"), F.lit(cat).alias("category"), F.lit("t").alias("source")))
    rows = F.array(
        row(dst.isin("203.0.113.100", "203.0.113.200"), dst, "ip", "seen"), row(dst.startswith("192.168."), F.lit("192.168.0.0/16"), "ip", "lab"),
        row(dst.startswith("198.51.100."), F.lit("198.51.100.32/28"), "ip", "range"), row(dom == "c2-beacon.example.net", dom, "domain", "name"),
        row(dom.endswith(".fake-bank-login.xyz"), F.lit("fake-bank-login.xyz"), "domain", "parent"),
        row(h.isin("44d88612fea8a8f36de82e1278abb02f", "d41d8cd98f00b204e9800998ecf8427e"), h, "hash", "file"))
    return events.select("destination_ip", "domain", "hash").select(F.explode(rows).alias("r")).filter(F.col("r").isNotNull()).select("r.*").distinct()


def quoted(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


FIELD_SQL = {
    "url": "url", "raw_string": "raw_data", "status": "status", "username": "username", "hostname": "hostname",
    "raw_data.message": "message", "raw_data.user_agent": "user_agent", "metadata.user_agent": "NULL", "raw_data.query": "NULL", "raw_data.body": "NULL",
    "raw_data.command": "NULL", "normalized_data.url.original": "NULL",
}


def regex_sql() -> str:
    """One SELECT per rule: first field that hits, and the matched text."""
    parts = []
    for r in R.BUILTIN_REGEX:
        fields = [(f, FIELD_SQL[f]) for f in r.fields if FIELD_SQL[f] != "NULL"]
        p = quoted(r.pattern)
        which = "CASE " + " ".join(f"WHEN regexp_matches({c}, {p}) THEN '{f}'" for f, c in fields) + " END"
        text = "CASE " + " ".join(f"WHEN regexp_matches({c}, {p}) THEN regexp_extract({c}, {p}, 0)" for f, c in fields) + " END"
        parts.append(f"SELECT event_id, '{r.rule_id}' AS rule_id, '{r.severity}' AS severity, {which} AS matched_field, {text} AS matched_value FROM ev")
    return "rx AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE matched_field IS NOT NULL)"


SIGMA_SQL = """sg AS (
 SELECT event_id, 'sigma_brute_force_ssh' AS rule_id, 'high' AS severity,
  CASE WHEN contains(event_type, 'auth_failed') THEN 'event_type' WHEN contains(action, 'denied') OR contains(action, 'blocked') OR contains(action, 'failed') THEN 'action' WHEN contains(source, 'sshd') OR contains(source, 'auth') THEN 'source' END AS matched_field,
  CASE WHEN contains(event_type, 'auth_failed') THEN 'auth_failed' WHEN contains(action, 'denied') THEN 'denied' WHEN contains(action, 'blocked') THEN 'blocked' WHEN contains(source, 'sshd') THEN 'sshd' END AS matched_value
 FROM ev WHERE (contains(source, 'linux') OR contains(source_type, 'linux')) AND (contains(source, 'sshd') OR contains(event_type, 'sshd')) AND (contains(source_type, 'authentication') OR contains(event_type, 'authentication'))
 UNION ALL SELECT event_id, 'sigma_port_scan_detection', 'medium', CASE WHEN contains(event_type, 'port_scan') THEN 'event_type' ELSE 'metadata.category' END, CASE WHEN contains(event_type, 'port_scan') THEN 'port_scan' ELSE 'scan' END
 FROM ev WHERE contains(source, 'suricata') AND contains(source_type, 'network') AND (contains(event_type, 'port_scan') OR contains(category, 'scan')))"""

IOC_SQL = f"""{FEED_SQL}, ips AS (SELECT value, category, CASE WHEN contains(value, '/') THEN split_part(value, '/', 1) ELSE value END AS base, CASE WHEN contains(value, '/') THEN cast(split_part(value, '/', 2) AS int) ELSE 32 END AS len FROM fd0 WHERE kind = 'ip'),
 num AS (SELECT *, cast(split_part(base, '.', 1) AS bigint) * 16777216 + cast(split_part(base, '.', 2) AS bigint) * 65536 + cast(split_part(base, '.', 3) AS bigint) * 256 + cast(split_part(base, '.', 4) AS bigint) AS low, cast(pow(2, 32 - len) AS bigint) AS span FROM ips),
 ipn AS (SELECT *, low // span AS slot FROM num),
 adr AS (SELECT event_id, pos, name, ip, cast(split_part(ip, '.', 1) AS bigint) * 16777216 + cast(split_part(ip, '.', 2) AS bigint) * 65536 + cast(split_part(ip, '.', 3) AS bigint) * 256 + cast(split_part(ip, '.', 4) AS bigint) AS n
  FROM (SELECT event_id, 0 AS pos, 'source_ip' AS name, source_ip AS ip FROM ev UNION ALL SELECT event_id, 1, 'destination_ip', destination_ip FROM ev)),
 iph AS (SELECT event_id, name AS matched_field, ip AS matched_value FROM (SELECT a.*, row_number() OVER (PARTITION BY event_id ORDER BY pos) AS rn FROM adr a WHERE EXISTS (SELECT 1 FROM ipn WHERE a.n // ipn.span = ipn.slot)) WHERE rn = 1),
 hosts AS (SELECT event_id, 0 AS pos, 'domain' AS name, domain AS v, domain AS h FROM ev UNION ALL SELECT event_id, 1, 'hostname', hostname, hostname FROM ev UNION ALL SELECT event_id, 2, 'url', url, lower(url) FROM ev),
 dmh AS (SELECT event_id, name AS matched_field, v AS matched_value FROM (SELECT x.*, row_number() OVER (PARTITION BY event_id ORDER BY pos) AS rn FROM hosts x WHERE EXISTS (SELECT 1 FROM fd0 WHERE kind = 'domain' AND (x.h = value OR suffix(x.h, concat('.', value))))) WHERE rn = 1),
 urlh AS (SELECT event_id, 'url' AS matched_field, url AS matched_value FROM (SELECT event_id, url, split_part(split_part(CASE WHEN contains(url, '://') THEN split_part(lower(url), '://', 2) ELSE lower(url) END, '/', 1), ':', 1) AS h FROM ev) WHERE EXISTS (SELECT 1 FROM fd0 WHERE kind = 'domain' AND (h = value OR suffix(h, concat('.', value))))),
 ic AS (SELECT event_id, 'ioc_ip_blocklist' AS rule_id, 'high' AS severity, matched_field, matched_value, 'ip' AS ioc_type FROM iph UNION ALL SELECT event_id, 'ioc_domain_blocklist', 'high', matched_field, matched_value, 'domain' FROM dmh
  UNION ALL SELECT event_id, 'ioc_hash_blocklist', 'critical', 'hash', hash, 'hash' FROM ev WHERE lower(hash) IN (SELECT value FROM fd0 WHERE kind = 'hash') UNION ALL SELECT event_id, 'ioc_url_blocklist', 'high', matched_field, matched_value, 'url' FROM urlh)"""


@query("detect_regex", f"WITH {EV}, {regex_sql()} SELECT event_id, rule_id, severity, matched_field, matched_value FROM rx")
def _(spark, sf):
    return D.detect(canon(spark, sf, *RULES), None, engines=("regex",)).select("event_id", "rule_id", "severity", "matched_field", "matched_value")


@query("detect_regex_offsets", f"""WITH {EV} SELECT event_id, instr(lower(url), 'union select ') - 1 AS match_start, instr(lower(url), 'union select ') - 1 + 13 AS match_end FROM ev WHERE contains(lower(url), 'union select ')""")
def _(spark, sf):
    rules = [r for r in R.BUILTIN_REGEX if r.rule_id == "regex_sqli_union"]
    return D.detect(canon(spark, sf, *RULES), None, rules).select("event_id", "match_start", "match_end")


@query("detect_sigma", f"WITH {EV}, {SIGMA_SQL} SELECT event_id, rule_id, severity, matched_field, matched_value FROM sg WHERE matched_field IS NOT NULL")
def _(spark, sf):
    return D.detect(canon(spark, sf, *RULES), None, engines=("sigma",)).select("event_id", "rule_id", "severity", "matched_field", "matched_value")


@query("detect_custom_sigma", f"""WITH {EV} SELECT event_id, 'custom' AS rule_id, 'high' AS severity FROM ev WHERE starts_with(lower(username), 'user_1') AND suffix(lower(hostname), '7') AND regexp_matches(url, '(?i)admin|login')""")
def _(spark, sf):
    rule = R.compile_sigma({"id": "custom", "title": "c", "level": "high", "detection": {"a": {"username|startswith": "USER_1", "hostname|endswith": ["7"]}, "b": {"url|re": "admin|login"}, "condition": "a and b"}})
    return D.detect(canon(spark, sf, *RULES), None, [rule]).select("event_id", "rule_id", "severity")


# all six modifiers, and negated conditions
MODIFIERS = {
    "contains": ("url", "contains", ("ADMIN",), "contains(lower(url), 'admin')"), "startswith": ("username", "startswith", ("USER_2",), "starts_with(lower(username), 'user_2')"),
    "endswith": ("hostname", "endswith", ("-7",), "suffix(lower(hostname), '-7')"), "regex": ("url", "regex", ("q=[0-9]",), "regexp_matches(url, '(?i)q=[0-9]')"),
    "equals": ("status", "equals", ("DENIED",), "lower(status) = 'denied'"), "equals_exact": ("status", "equals_exact", ("denied", "DENIED"), "(status = 'denied' OR status = 'DENIED')"),
}


@query("detect_modifiers", f"WITH {EV} " + " UNION ALL ".join(f"SELECT event_id, '{name}' AS rule_id FROM ev WHERE {sql}" for name, (_, _, _, sql) in MODIFIERS.items()))
def _(spark, sf):
    rules = [R.Rule(name, name, "sigma", "low", conditions=(R.Condition(field, patterns, modifier),)) for name, (field, modifier, patterns, _) in MODIFIERS.items()]
    return D.detect(canon(spark, sf, *RULES), None, rules).select("event_id", "rule_id")


@query("detect_negated", f"WITH {EV} SELECT event_id, CASE WHEN contains(lower(url), 'login') THEN 'login' ELSE 'or' END AS matched_value FROM ev WHERE (contains(lower(url), 'login') OR contains(lower(url), 'or')) AND NOT (contains(lower(url), 'login') AND contains(lower(url), 'or'))")
def _(spark, sf):
    rule = R.Rule("negated", "negated", "sigma", "low", conditions=(R.Condition("url", ("login", "or"), "contains", True, True),))
    return D.detect(canon(spark, sf, *RULES), None, [rule]).select("event_id", "matched_value")


# nested fields, a list of texts, a list of numbers, a null and an empty object
NESTED = "concat('{\"a\": {\"b\": ', k, ', \"l\": [\"x\", \"y', k % 3, '\"]}, \"c\": null, \"n\": [1, ', k, '], \"e\": {}}')"


@query("flatten_keys", f"""WITH {EV} SELECT event_id, 'normalized_data.a.b' AS field, cast(k AS varchar) AS value FROM ev UNION ALL SELECT event_id, 'normalized_data.a.l', concat('x y', k % 3) FROM ev
 UNION ALL SELECT event_id, 'normalized_data.a.l_str', concat('x y', k % 3) FROM ev UNION ALL SELECT event_id, 'normalized_data.c', NULL FROM ev UNION ALL SELECT event_id, 'normalized_data.n', concat('1 ', k) FROM ev""")
def _(spark, sf):
    return X.flatten_keys(canon(spark, sf).selectExpr("event_id", f"{NESTED} as normalized_data"), "normalized_data", "normalized_data", ["event_id"])


@query("detect_flattened_fields", f"""WITH {EV} SELECT event_id, 'list' AS rule_id, 'normalized_data.a.l_str' AS matched_field, concat('x y', k % 3) AS matched_value FROM ev WHERE k % 3 < 2
 UNION ALL SELECT event_id, 'numbers', 'normalized_data.n', concat('1 ', k) FROM ev WHERE k < 10 UNION ALL SELECT event_id, 'nested', 'Normalized_Data.a.b', cast(k AS varchar) FROM ev WHERE k BETWEEN 10 AND 99""")
def _(spark, sf):
    rules = [R.regex_rule("^x y[01]$", "list", fields=("normalized_data.a.l_str",), rule_id="list"), R.regex_rule(r"^1 \d$", "numbers", fields=("normalized_data.a.l_none", "normalized_data.n"), rule_id="numbers"),
             R.regex_rule(r"^\d\d$", "nested", fields=("Normalized_Data.a.b",), rule_id="nested")]
    events = canon(spark, sf, *RULES, "k").withColumn("normalized_data", F.expr(NESTED))
    return D.detect(events, None, rules).select("event_id", "rule_id", "matched_field", "matched_value")


@query("detect_indicators", f"WITH {EV}, {IOC_SQL} SELECT event_id, rule_id, severity, matched_field, matched_value, ioc_type, (SELECT max(category) FROM fd0 WHERE fd0.value = CASE WHEN ioc_type = 'ip' THEN matched_value ELSE lower(matched_value) END) AS ioc_category FROM ic")
def _(spark, sf):
    ev = canon(spark, sf, *RULES)
    return D.detect(ev, feed_of(ev), engines=("ioc",)).select("event_id", "rule_id", "severity", "matched_field", "matched_value", "ioc_type", "ioc_category")


@query("detect_custom_indicator_rule", f"WITH {EV}, {FEED_SQL} SELECT event_id, 'mine' AS rule_id, 'low' AS severity FROM ev WHERE lower(hash) IN (SELECT value FROM fd0 WHERE kind = 'hash')")
def _(spark, sf):
    ev = canon(spark, sf, *RULES)
    return D.detect(ev, feed_of(ev), [R.ioc_rule("hash", ("hash",), severity="low", rule_id="mine")]).select("event_id", "rule_id", "severity")


TAGS = {r.rule_id: r.tags for r in R.default_rules()}


def _tag_test(*tags: str) -> str:
    ids = sorted(k for k, v in TAGS.items() if set(tags) & set(v))
    return "bool_or(rule_id IN (" + ", ".join(f"'{i}'" for i in ids) + "))"


KIND_SQL = "CASE " + " ".join(f"WHEN {_tag_test(*t)} THEN '{k}'" for t, k in D.TYPE_BY_TAG if any(set(t) & set(v) for v in TAGS.values())) + (
    " WHEN bool_or(rule_id = 'ioc_ip_blocklist') THEN 'malicious_ip_communication' WHEN bool_or(rule_id = 'ioc_domain_blocklist') THEN 'malicious_domain_access' "
    "WHEN bool_or(rule_id = 'ioc_hash_blocklist') THEN 'malicious_file_detected' WHEN bool_or(rule_id = 'ioc_url_blocklist') THEN 'malicious_url_access' "
    "WHEN bool_or(rule_id LIKE 'sigma%') THEN 'sigma_rule_match' ELSE 'pattern_match' END")
ALL_SQL = f"{EV}, {regex_sql()}, {SIGMA_SQL}, {IOC_SQL}, al AS (SELECT event_id, rule_id, severity FROM rx UNION ALL SELECT event_id, rule_id, severity FROM sg WHERE matched_field IS NOT NULL UNION ALL SELECT event_id, rule_id, severity FROM ic)"


@query("detect_findings", f"""WITH {ALL_SQL}, g AS (SELECT event_id, {KIND_SQL} AS finding_type, max({rank()}) AS rk, count(*) AS match_count, string_agg(rule_id, ',' ORDER BY rule_id) AS rules FROM al GROUP BY event_id)
 SELECT g.event_id, finding_type, CASE rk WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'informational' END AS severity, match_count, rules, source_ip, username FROM g JOIN ev ON ev.event_id = g.event_id""")
def _(spark, sf):
    ev = canon(spark, sf, *RULES)
    found = D.findings(D.detect(ev, feed_of(ev)))
    return found.select("event_id", "finding_type", "severity", "match_count", F.array_sort("rule_ids").alias("rules"), "source_ip", "username")


@query("detect_finding_techniques", f"""WITH {ALL_SQL}, t(rule_id, tech) AS (VALUES {', '.join(f"('{r.rule_id}', '{t}')" for r in R.default_rules() for t in r.mitre_techniques)})
 SELECT event_id, string_agg(DISTINCT tech, ',' ORDER BY tech) AS techniques FROM al JOIN t USING (rule_id) GROUP BY event_id""")
def _(spark, sf):
    ev = canon(spark, sf, *RULES)
    return D.findings(D.detect(ev, feed_of(ev))).select("event_id", F.array_sort("mitre_techniques").alias("techniques")).filter(F.col("techniques") != F.array().cast("array<string>"))


@query("detect_rule_hits", f"WITH {ALL_SQL} SELECT rule_id, count(*) AS hits, count(DISTINCT event_id) AS events FROM al GROUP BY rule_id")
def _(spark, sf):
    ev = canon(spark, sf, *RULES)
    return D.detect(ev, feed_of(ev)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("event_id").alias("events"))


@query("detect_stats", f"WITH {ALL_SQL} SELECT (SELECT count(*) FROM ev) AS events_processed, count(*) AS matches_found, count(DISTINCT event_id) AS findings_generated FROM al")
def _(spark, sf):
    ev = canon(spark, sf, *RULES)
    return D.detection_stats(ev, D.detect(ev, feed_of(ev)))


def _text_events(df: DataFrame, key: str, text: str, url=None) -> DataFrame:
    return df.select(F.col(key).alias("event_id"), F.lit("web").alias("source"), F.lit("web").alias("source_type"), F.lit("page").alias("event_type"), F.col(text).alias("raw_data"),
                     (F.col(url) if url else F.lit(None).cast("string")).alias("url"))


def _text_sql(tab: str, key: str, text: str, url: str | None) -> str:
    parts = []
    for r in R.BUILTIN_REGEX:
        cols = [c for f, c in (("url", url), ("raw_string", text)) if c and f in r.fields]
        if cols:
            parts.append(f"SELECT {key} AS event_id, '{r.rule_id}' AS rule_id FROM {tab} WHERE " + " OR ".join(f"regexp_matches({c}, {quoted(r.pattern)})" for c in cols))
    return " UNION ALL ".join(parts)


@query("detect_pages", _text_sql("pages", "page_id", "html", "url"))
def _(spark, sf):
    return D.detect(_text_events(table(spark, sf, "pages"), "page_id", "html", "url"), None, engines=("regex",)).select("event_id", "rule_id")


@query("detect_documents", _text_sql("documents", "doc_id", "text", None))
def _(spark, sf):
    return D.detect(_text_events(table(spark, sf, "documents"), "doc_id", "text"), None, engines=("regex",)).select("event_id", "rule_id")


@query("ioc_feed_lines", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, trim(line) AS line FROM l),
 p AS (SELECT doc_id, lower(trim(split_part(line, ',', 1))) AS value, nullif(trim(split_part(line, ',', 2)), '') AS category FROM c WHERE line <> '' AND NOT starts_with(line, '#'))
 SELECT value, count(*) AS n, count(category) AS with_category FROM p WHERE value <> '' GROUP BY value""")
def _(spark, sf):
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("value"), F.lit("x/domain_lines.txt").alias("file"))
    return feeds.parse_feed(lines).groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.count("category").alias("with_category"))
