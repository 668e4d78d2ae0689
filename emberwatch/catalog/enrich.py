"""Queries: e-mail, threat intelligence, correlation, kill chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chains as C
from ..operators import correlate as K
from ..operators import email as E
from ..operators import intel as T
from .base import EV, canon, query, rank, table

URL_RX = "(?i)https?://[^\\s<>\"'']+|www\\.[^\\s<>\"'']+"

# ---- e-mail --------------------------------------------------------------------------------------------------
U_SQL = f"u AS (SELECT page_id, list_distinct(regexp_extract_all(html, '{URL_RX}')) AS us FROM pages), x AS (SELECT page_id, unnest(us) AS url FROM u), d AS (SELECT *, lower(regexp_extract(CASE WHEN starts_with(url, 'http') THEN url ELSE concat('http://', url) END, '^[^:/?#]+://([^/?#]*)', 1)) AS domain FROM x)"


@query("email_urls", f"""WITH {U_SQL} SELECT page_id, url, domain, regexp_matches(domain, '^\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}') AS is_ip_based, regexp_matches(domain, '\\.(tk|ml|ga|cf|gq|xyz|top|work|click|link)$') AS has_suspicious_tld,
 greatest(length(domain) - length(replace(domain, '.', '')) - 1, 0) AS subdomain_count, regexp_matches(domain, 'bit\\.ly|t\\.co|goo\\.gl|tinyurl\\.com|ow\\.ly|is\\.gd') AS is_shortened FROM d""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(E.extract_urls("html")).alias("u")).select("page_id", "u.*")


# messages built from the documents: the whole text is the body, headers follow the id
MAIL_HEAD = """concat('From: Ann <ann@', case when doc_id % 3 = 0 then 'corp.example' else 'mail.example' end, '>', chr(10), 'To: a@x.example, b@y.example', chr(10), 'Reply-To: ann@', case when doc_id % 4 = 0 then 'other.example' else 'mail.example' end, chr(10),
 'Received-SPF: ', case doc_id % 5 when 0 then 'Fail' when 1 then 'none' else 'Pass' end, chr(10), 'DKIM-Signature: ', case doc_id % 7 when 0 then 'fail' else 'pass' end, chr(10), 'Subject: Invoice ', doc_id, case when doc_id % 6 = 0 then ' urgent' else '' end, chr(10), chr(10))"""


def mails(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("doc_id", f"concat({MAIL_HEAD}, text, case when doc_id % 9 = 0 then ' http://10.0.0.9/a http://a.b.c.d.evil.top/x' else '' end) as eml",
                                                    "case when doc_id % 8 = 0 then array(named_struct('filename', 'a.pdf.exe', 'size', cast(5 as bigint), 'content_type', 'x')) else array() end as attachments")
    return E.split_message(docs)


@query("email_split", f"SELECT doc_id, concat('Invoice ', doc_id, CASE WHEN doc_id % 6 = 0 THEN ' urgent' ELSE '' END) AS subject, 'a@x.example|b@y.example' AS \"to\", length(text) + CASE WHEN doc_id % 9 = 0 THEN length(' http://10.0.0.9/a http://a.b.c.d.evil.top/x') ELSE 0 END AS body_chars, md5(concat(text, CASE WHEN doc_id % 9 = 0 THEN ' http://10.0.0.9/a http://a.b.c.d.evil.top/x' ELSE '' END)) AS body_md5 FROM documents")
def _(spark, sf):
    return mails(spark, sf).select("doc_id", "subject", F.array_join("to", "|").alias("to"), F.length("body").alias("body_chars"), F.md5("body").alias("body_md5"))


@query("email_senders", "SELECT doc_id, concat('ann@', CASE WHEN doc_id % 3 = 0 THEN 'corp.example' ELSE 'mail.example' END) AS sender, CASE WHEN doc_id % 3 = 0 THEN 'corp.example' ELSE 'mail.example' END AS sender_domain, CASE WHEN doc_id % 4 = 0 THEN 'other.example' ELSE 'mail.example' END AS reply_to_domain, CASE doc_id % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'none' ELSE 'pass' END AS spf_result FROM documents")
def _(spark, sf):
    return E.analyse(mails(spark, sf)).select("doc_id", "sender", "sender_domain", "reply_to_domain", "spf_result")


def _fam(patterns) -> str:
    return "(" + " OR ".join("regexp_matches(t, '" + p.replace("'", "''") + "')" for p in patterns) + ")"


MAIL_SQL = f"""m AS (SELECT doc_id, concat(text, CASE WHEN doc_id % 9 = 0 THEN ' http://10.0.0.9/a http://a.b.c.d.evil.top/x' ELSE '' END) AS body, concat('Invoice ', doc_id, CASE WHEN doc_id % 6 = 0 THEN ' urgent' ELSE '' END) AS subj FROM documents),
 mt AS (SELECT doc_id, body, concat(subj, ' ', body) AS t FROM m),
 mu AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(body, '{URL_RX}'))) AS url FROM mt),
 md AS (SELECT doc_id, lower(regexp_extract(CASE WHEN starts_with(url, 'http') THEN url ELSE concat('http://', url) END, '^[^:/?#]+://([^/?#]*)', 1)) AS domain FROM mu),
 i AS (SELECT doc_id, 'sender_mismatch' AS kind, 0.25 AS c, 2 AS rk FROM mt WHERE (CASE WHEN doc_id % 4 = 0 THEN 'other.example' ELSE 'mail.example' END) <> (CASE WHEN doc_id % 3 = 0 THEN 'corp.example' ELSE 'mail.example' END)
  UNION ALL SELECT doc_id, 'spf_fail', 0.2, 2 FROM mt WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'dkim_fail', 0.2, 2 FROM mt WHERE doc_id % 7 = 0
  UNION ALL SELECT doc_id, 'ip_based_url', 0.15, 2 FROM md WHERE regexp_matches(domain, '^\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}') UNION ALL SELECT doc_id, 'suspicious_tld', 0.1, 1 FROM md WHERE regexp_matches(domain, '\\.(tk|ml|ga|cf|gq|xyz|top|work|click|link)$')
  UNION ALL SELECT doc_id, 'excessive_subdomains', 0.1, 1 FROM md WHERE length(domain) - length(replace(domain, '.', '')) - 1 > 3 UNION ALL SELECT doc_id, 'suspicious_attachment', 0.3, 3 FROM mt WHERE doc_id % 8 = 0
  UNION ALL SELECT doc_id, 'urgency_language', 0.1, 1 FROM mt WHERE {_fam(E.URGENCY_PATTERNS)} UNION ALL SELECT doc_id, 'credential_request', 0.2, 2 FROM mt WHERE {_fam(E.CREDENTIAL_PATTERNS)}
  UNION ALL SELECT doc_id, 'financial_indicator', 0.1, 1 FROM mt WHERE {_fam(E.FINANCIAL_PATTERNS)}),
 g AS (SELECT mt.doc_id, count(kind) AS n, least(round(coalesce(sum(cast(c AS double)), 0), 10), 1.0) AS risk, coalesce(max(rk), 0) AS rk, count(*) FILTER (WHERE kind IN ('credential_request', 'sender_mismatch', 'ip_based_url')) AS ph, count(*) FILTER (WHERE kind IN ('urgency_language', 'financial_indicator')) AS so,
  string_agg(kind, ',' ORDER BY kind) AS kinds FROM mt LEFT JOIN i ON i.doc_id = mt.doc_id GROUP BY mt.doc_id),
 c AS (SELECT *, CASE WHEN n = 0 THEN 'benign' WHEN rk = 3 OR risk >= 0.7 THEN 'malicious_indicators' WHEN ph >= 2 OR risk >= 0.5 THEN 'possible_phishing' WHEN so >= 2 OR risk >= 0.3 THEN 'possible_social_engineering' WHEN risk >= 0.1 THEN 'suspicious' ELSE 'benign' END AS classification FROM g)"""


@query("email_findings", f"""WITH {MAIL_SQL} SELECT doc_id, n AS indicator_count, coalesce(kinds, '') AS kinds, round(risk, 6) AS risk_score, classification,
 CASE classification WHEN 'benign' THEN 'informational' WHEN 'suspicious' THEN 'low' WHEN 'malicious_indicators' THEN 'high' ELSE 'medium' END AS severity, CASE classification WHEN 'benign' THEN 0 WHEN 'suspicious' THEN 2 WHEN 'possible_social_engineering' THEN 3 ELSE 4 END AS advice FROM c""")
def _(spark, sf):
    done = E.email_findings(mails(spark, sf))
    return done.select("doc_id", F.size("indicators").alias("indicator_count"), F.array_sort(F.transform("indicators", lambda x: x["indicator_type"])).alias("kinds"), "risk_score", "classification", "severity",
                       F.size("recommendations").alias("advice"))


@query("email_attachments", "SELECT doc_id, 'a.pdf.exe' AS filename, '.exe' AS extension, true AS is_suspicious_type, false AS is_archive FROM documents WHERE doc_id % 8 = 0")
def _(spark, sf):
    return E.analyse(mails(spark, sf)).select("doc_id", F.explode("files").alias("f")).select("doc_id", "f.filename", "f.extension", "f.is_suspicious_type", "f.is_archive")


# ---- threat intelligence -------------------------------------------------------------------------------------
IND = """ind AS (SELECT event_id, source_ip AS indicator, 'ip' AS t FROM ev UNION ALL SELECT event_id, destination_ip, 'ip' FROM ev UNION ALL SELECT event_id, domain, 'domain' FROM ev UNION ALL SELECT event_id, hostname, 'domain' FROM ev
 UNION ALL SELECT event_id, url, 'url' FROM ev UNION ALL SELECT event_id, hash, 'hash_md5' FROM ev)"""
PROV = f"pv(v, kd, rep, cf) AS (VALUES {', '.join(f'''('{v}', '{k}', '{r}', {T.PROVIDER_CONFIDENCE[k]})''' for v, k, r, _, _ in T.SAMPLE_PROVIDER)})"
LOOK = f"lk AS (SELECT DISTINCT indicator, t, coalesce(rep, 'unknown') AS rep, cast(coalesce(cf, 0) AS double) AS cf FROM ind LEFT JOIN pv ON (CASE WHEN t LIKE 'hash%' THEN 'hash' ELSE t END) = kd AND (CASE WHEN t = 'ip' THEN indicator ELSE lower(indicator) END) = v)"


@query("intel_indicator_types", f"""WITH {EV}, c AS (SELECT event_id, CASE k % 8 WHEN 0 THEN source_ip WHEN 1 THEN hash WHEN 2 THEN concat('CVE-2024-', k) WHEN 3 THEN concat(username, '@x.example') WHEN 4 THEN url WHEN 5 THEN concat('T1', 100 + k) WHEN 6 THEN concat('ftp://h/', k) ELSE domain END AS v, k, url FROM ev)
 SELECT event_id, CASE k % 8 WHEN 0 THEN 'ip' WHEN 1 THEN 'hash_md5' WHEN 2 THEN 'cve' WHEN 3 THEN 'email' WHEN 4 THEN CASE WHEN url LIKE 'http%' THEN 'url' ELSE 'domain' END ELSE 'domain' END AS lookup_type,
 CASE k % 8 WHEN 0 THEN 'ip_address' WHEN 1 THEN 'file_hash_md5' WHEN 2 THEN 'cve' WHEN 3 THEN 'email' WHEN 4 THEN CASE WHEN url LIKE 'http%' THEN 'url' ELSE 'domain' END WHEN 5 THEN CASE WHEN length(v) = 5 THEN 'mitre_technique' ELSE 'domain' END WHEN 6 THEN 'url' ELSE 'domain' END AS analyst_type FROM c""")
def _(spark, sf):
    v = "CASE k % 8 WHEN 0 THEN source_ip WHEN 1 THEN hash WHEN 2 THEN concat('CVE-2024-', k) WHEN 3 THEN concat(username, '@x.example') WHEN 4 THEN url WHEN 5 THEN concat('T1', 100 + k) WHEN 6 THEN concat('ftp://h/', k) ELSE domain END as v"
    return canon(spark, sf).selectExpr("event_id", v).select("event_id", T.lookup_type("v").alias("lookup_type"), T.analyst_type("v").alias("analyst_type"))


@query("intel_extract", f"WITH {EV}, {IND} SELECT event_id, indicator, t AS indicator_type FROM ind")
def _(spark, sf):
    return T.extract_indicators(canon(spark, sf)).select("event_id", "indicator", "indicator_type")


@query("intel_lookup", f"WITH {EV}, {IND}, {PROV}, {LOOK} SELECT indicator, t AS indicator_type, 'mock_provider' AS provider, rep AS reputation, round(cf, 6) AS confidence FROM lk")
def _(spark, sf):
    ind = T.extract_indicators(canon(spark, sf)).select("indicator", "indicator_type").distinct()
    return T.lookup_indicators(ind, T.sample_provider(spark), ["mock_provider"]).select("indicator", "indicator_type", "provider", "reputation", "confidence")


@query("intel_enrich_events", f"""WITH {EV}, {IND}, {PROV}, {LOOK} SELECT event_id, count(*) AS results, count(*) FILTER (WHERE rep = 'malicious') AS malicious, round(max(cf), 6) AS top_confidence FROM ind JOIN lk USING (indicator, t) GROUP BY event_id""")
def _(spark, sf):
    done = T.enrich_events(canon(spark, sf), T.sample_provider(spark), ["mock_provider"])
    return done.select("event_id", F.size("enrichments").alias("results"), F.size(F.filter("enrichments", lambda x: x["reputation"] == "malicious")).alias("malicious"),
                       F.array_max(F.transform("enrichments", lambda x: x["confidence"])).alias("top_confidence"))


@query("intel_reputation", f"""WITH {EV}, {IND}, {PROV}, {LOOK}, r AS (SELECT event_id, min(CASE rep WHEN 'malicious' THEN 0 WHEN 'suspicious' THEN 1 WHEN 'benign' THEN 2 ELSE 3 END) AS r, max(cf) AS confidence FROM ind JOIN lk USING (indicator, t) GROUP BY event_id)
 SELECT event_id, CASE r WHEN 0 THEN 'malicious' WHEN 1 THEN 'suspicious' WHEN 2 THEN 'benign' ELSE 'unknown' END AS reputation, round(confidence, 6) AS confidence FROM r""")
def _(spark, sf):
    found = T.extract_indicators(canon(spark, sf))
    return T.aggregated_reputation(T.lookup_indicators(found, T.sample_provider(spark), ["mock_provider"]), "event_id")


@query("intel_stale", f"WITH {EV}, {IND} SELECT DISTINCT indicator, t AS indicator_type FROM ind WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE t = 'domain' AND e.domain = lower(indicator) AND e.timestamp >= timestamp '2024-01-15' AND e.k % 8 < 3)")
def _(spark, sf):
    ev = canon(spark, sf)
    wanted = T.extract_indicators(ev).select("indicator", "indicator_type").distinct()
    known = ev.filter(F.col("k") % 8 < 3).select(F.col("domain").alias("indicator"), F.lit("domain").alias("indicator_type"), F.col("timestamp").alias("retrieval_time"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return T.stale_indicators(wanted, known, 16 * 86400, now)


LISTED = f"li(v, kd, cat, cf) AS (VALUES {', '.join(f'''('{v}', '{k}', '{c}', {x})''' for v, k, c, x, _ in T.INTERNAL_LIST)}, ('evil.com', 'domain', 'c2', 0.8), ('files.top', 'domain', 'phishing', 0.6))"


def _listed(spark):
    return T.internal_list(spark).unionByName(spark.createDataFrame([("evil.com", "domain", "c2", 0.8, None), ("files.top", "domain", "phishing", 0.6, None)], "value string, kind string, category string, confidence double, malware_family string"))


FI = """fi AS (SELECT event_id, value, ioc_type FROM (SELECT *, row_number() OVER (PARTITION BY event_id, value ORDER BY pos) AS rn FROM (SELECT event_id, 1 AS pos, source_ip AS value, 'ip_address' AS ioc_type FROM ev UNION ALL SELECT event_id, 2, destination_ip, 'ip_address' FROM ev
 UNION ALL SELECT event_id, 3, domain, 'domain' FROM ev UNION ALL SELECT event_id, 4, hostname, 'domain' FROM ev UNION ALL SELECT event_id, 5, hash, 'file_hash_md5' FROM ev UNION ALL SELECT event_id, 6, url, 'url' FROM ev)) WHERE rn = 1)"""


@query("intel_threat_findings", f"""WITH {EV}, {FI}, {LISTED}, en AS (SELECT fi.event_id, v IS NOT NULL AS bad, cf, cat FROM fi LEFT JOIN li ON (CASE WHEN ioc_type = 'ip_address' THEN 'ip' WHEN ioc_type LIKE 'file%' THEN 'hash' ELSE ioc_type END) = kd AND (CASE WHEN ioc_type = 'ip_address' THEN value ELSE lower(value) END) = v),
 s AS (SELECT event_id, count(*) AS total_iocs, count(*) FILTER (WHERE bad) AS known_malicious, coalesce(avg(cast(cf AS double)) FILTER (WHERE bad), 0.1) AS sc FROM en GROUP BY event_id),
 tt AS (SELECT event_id, unnest(CASE cat WHEN 'phishing' THEN ['T1566', 'T1566.001'] WHEN 'c2' THEN ['T1071'] WHEN 'malware' THEN ['T1059'] WHEN 'ransomware' THEN ['T1486'] WHEN 'botnet' THEN ['T1071'] END) AS tech FROM en WHERE bad
  UNION ALL SELECT event_id, 'T1110' FROM ev WHERE event_type LIKE '%auth_failed%' OR event_type LIKE '%brute_force%' UNION ALL SELECT event_id, 'T1046' FROM ev WHERE event_type LIKE '%port_scan%' UNION ALL SELECT event_id, 'T1021' FROM ev WHERE event_type LIKE '%lateral_movement%' UNION ALL SELECT event_id, 'T1048' FROM ev WHERE event_type LIKE '%data_exfil%'),
 ta AS (SELECT event_id, string_agg(DISTINCT tech, ',' ORDER BY tech) AS techniques FROM tt GROUP BY event_id)
 SELECT s.event_id, total_iocs, known_malicious, round(sc, 6) AS threat_score, CASE WHEN sc >= 0.9 THEN 'critical' WHEN sc >= 0.7 THEN 'high' WHEN sc >= 0.4 THEN 'medium' WHEN sc >= 0.2 THEN 'low' ELSE 'informational' END AS severity, coalesce(techniques, '') AS techniques FROM s LEFT JOIN ta USING (event_id)""")
def _(spark, sf):
    ev = canon(spark, sf).select(F.col("event_id").alias("finding_id"), "source_ip", "destination_ip", "domain", "hostname", "hash", "url", "event_type")
    return T.threat_findings(ev, _listed(spark)).select(F.col("finding_id").alias("event_id"), "total_iocs", "known_malicious", "threat_score", "severity", F.array_sort("mitre_techniques").alias("techniques"))


CHAIN_COLUMNS = ("event_id", "timestamp", "event_type", "severity", "source_ip", "destination_ip", "username")

# ---- chains and entity correlation ---------------------------------------------------------------------------
STAGE = "CASE " + " ".join(f"WHEN contains(event_type, '{w}') THEN '{s}'" for w, s in C.STAGE_WORDS) + " END"
ORDER = "CASE stage " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(C.STAGES)) + " END"
CHAIN = f"""st AS (SELECT event_id, username, source_ip, timestamp, {STAGE} AS stage FROM ev), so AS (SELECT *, {ORDER} AS o FROM st WHERE stage IS NOT NULL),
 rm AS (SELECT *, max(o) OVER (PARTITION BY username ORDER BY timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM so),
 ch AS (SELECT username, count(*) AS stage_count, string_agg(stage, ',' ORDER BY o) AS stages, string_agg(cast(event_id AS string), ',' ORDER BY o) AS event_ids, min(timestamp) AS t0, max(timestamp) AS t1 FROM rm WHERE before IS NULL OR o > before GROUP BY username HAVING count(*) >= 3)"""


@query("attack_stages", f"WITH {EV}, s AS (SELECT {STAGE} AS stage FROM ev) SELECT stage, count(*) AS n FROM s GROUP BY stage")
def _(spark, sf):
    return canon(spark, sf, "event_type").select(C.attack_stage("event_type").alias("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query("kill_chains", f"WITH {EV}, {CHAIN} SELECT username, stage_count, stages, event_ids, round(stage_count / 13.0, 6) AS completeness, epoch_us(t0) AS start_time, round((epoch_us(t1) - epoch_us(t0)) / 1e6, 6) AS duration_sec FROM ch")
def _(spark, sf):
    done = C.kill_chains(canon(spark, sf, *CHAIN_COLUMNS), ["username"])
    return done.select("username", "stage_count", "stages", "event_ids", "completeness", "start_time", "duration_sec")


@query("chain_findings", f"WITH {EV}, {CHAIN} SELECT concat('chain_', username) AS entity, CASE WHEN stage_count / 13.0 > 0.5 THEN 'critical' ELSE 'high' END AS severity, replace(stages, '_', '-') AS mitre_tactics FROM ch")
def _(spark, sf):
    return C.chain_findings(C.kill_chains(canon(spark, sf, *CHAIN_COLUMNS), ["username"])).select("entity", "severity", "mitre_tactics")


NOW_SQL, WIN = "timestamp '2024-01-31 00:00:00'", 20 * 86400


def _now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def _since():
    """Start of the correlation window, for the scan."""
    return _now() - F.make_dt_interval(secs=F.lit(WIN).cast("decimal(18,6)"))


def _entity_sql(kind: str, key: str, partner: str) -> str:
    return f"""SELECT 'same_{kind}' AS correlation_type, {key} AS entity, CASE WHEN max({rank()}) >= 4 THEN 'critical' WHEN max({rank()}) = 3 THEN 'high' WHEN count(*) > 10 THEN 'high' WHEN count(*) > 5 THEN 'medium' ELSE 'low' END AS severity,
 count(*) AS event_count, {f'count(DISTINCT {partner})' if partner else '0'} AS unique_partners, round((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6, 6) AS time_span_sec FROM ev
 WHERE timestamp >= {NOW_SQL} - INTERVAL '{WIN} seconds' GROUP BY {key} HAVING count(*) >= 5"""


for _kind, _key, _partner in (("source", "source_ip", "destination_ip"), ("target", "destination_ip", "source_ip"), ("user", "username", "")):

    @query(f"correlate_same_{_kind}", f"WITH {EV} {_entity_sql(_kind, _key, _partner)}")
    def _(spark, sf, kind=_kind):
        return C.entity_correlation(canon(spark, sf, *CHAIN_COLUMNS, since=_since()), kind, _now(), 5, WIN).select("correlation_type", "entity", "severity", "event_count", "unique_partners", "time_span_sec")


@query("primary_correlation", f"""WITH {EV}, {CHAIN}, u AS (SELECT 0 AS p, 0 AS r, 0 AS n, concat('corr_chain_', username) AS finding_id, 'attack_chain' AS correlation_type FROM ch
 UNION ALL SELECT 1, 0, 0, 'zzz', 'none' WHERE false) SELECT finding_id, correlation_type FROM u ORDER BY p, finding_id LIMIT 1""")
def _(spark, sf):
    return C.primary_correlation(C.all_correlations(canon(spark, sf, *CHAIN_COLUMNS), _now(), ["username"], 5, WIN)).select("finding_id", "correlation_type")


@query("findings_as_events", f"WITH {EV} SELECT event_id, event_type, CASE WHEN k % 10 = 9 THEN 'medium' ELSE severity END AS severity FROM ev")
def _(spark, sf):
    rows = canon(spark, sf).withColumns({"finding_type": F.col("event_type"), "finding_id": F.col("event_id"), "severity": F.expr("case when k % 10 = 9 then 'weird' else upper(severity) end")})
    return C.findings_as_events(rows).select("event_id", "event_type", "severity")


# ---- correlation over time groups ----------------------------------------------------------------------------
# groups per user: walk forward, a group takes everything within the window of its first member
GROUP_SQL = f"""{EV}, rk AS (SELECT *, row_number() OVER (PARTITION BY username ORDER BY timestamp, event_id) AS n FROM ev),
 wk(username, n, anchor) AS (SELECT username, n, timestamp FROM rk WHERE n = 1 UNION ALL SELECT r.username, r.n, CASE WHEN r.timestamp - w.anchor <= INTERVAL '360 minutes' THEN w.anchor ELSE r.timestamp END FROM wk w JOIN rk r ON r.username = w.username AND r.n = w.n + 1),
 gr AS (SELECT rk.*, wk.anchor FROM rk JOIN wk ON wk.username = rk.username AND wk.n = rk.n)"""


def _findings(spark, sf):
    rows = canon(spark, sf, "event_id", "event_type", "source", "timestamp", "severity", "username", "source_ip", "domain", "destination_ip")
    return rows.select("event_id", F.col("event_id").cast("string").alias("finding_id"), F.col("event_type").alias("finding_type"), "source", "timestamp", "severity", "username", "source_ip", "domain",
                                   F.col("destination_ip").alias("dest_ip"))


@query("time_groups", f"WITH RECURSIVE {GROUP_SQL} SELECT event_id, epoch_us(anchor) AS group_start FROM gr")
def _(spark, sf):
    return K.time_groups(_findings(spark, sf), 360, ["username"]).select("event_id", "group_start")


@query("time_groups_global", f"""WITH RECURSIVE {EV}, rk AS (SELECT event_id, timestamp, row_number() OVER (ORDER BY timestamp, event_id) AS n FROM ev),
 wk(n, anchor) AS (SELECT n, timestamp FROM rk WHERE n = 1 UNION ALL SELECT r.n, CASE WHEN r.timestamp - w.anchor <= INTERVAL '60 minutes' THEN w.anchor ELSE r.timestamp END FROM wk w JOIN rk r ON r.n = w.n + 1)
 SELECT epoch_us(anchor) AS group_start, count(*) AS n FROM wk GROUP BY anchor""")
def _(spark, sf):
    return K.time_groups(_findings(spark, sf), 60).groupBy("group_start").agg(F.count(F.lit(1)).alias("n"))


@query("shared_list_values", f"""WITH RECURSIVE {GROUP_SQL}, sz AS (SELECT username, anchor, count(*) AS size FROM gr GROUP BY ALL),
 vals AS (SELECT DISTINCT username, anchor, event_id, 'ip' AS kind, unnest([source_ip, destination_ip, '']) AS value FROM gr UNION SELECT username, anchor, event_id, 'domain', unnest([domain, 'all.example']) FROM gr),
 held AS (SELECT username, anchor, kind, value, count(*) AS h FROM vals WHERE value <> '' GROUP BY ALL) SELECT username, epoch_us(anchor) AS group_start, kind, value FROM held JOIN sz USING (username, anchor) WHERE h = size""")
def _(spark, sf):
    grouped = K.time_groups(_findings(spark, sf), 360, ["username"])
    lists = grouped.select(F.col("username").alias("owner"), "group_start", "finding_id", F.array("source_ip", "dest_ip", F.lit("")).alias("ip"), F.create_map(F.lit("domain"), F.array("domain", F.lit("all.example"))).alias("indicators"))
    return K.shared_values(lists, ["owner", "group_start"]).withColumnRenamed("owner", "username")


def _has(*words: str) -> str:
    return "bool_or(" + " OR ".join(f"contains(event_type, '{w}')" for w in words) + ")"


COMPAT = " OR ".join(f"(bool_or(event_type = '{a}') AND bool_or(event_type IN ({', '.join(repr(b) for b in bs)})))" for a, bs in K.COMPATIBLE.items())


@query("correlations", f"""WITH RECURSIVE {GROUP_SQL}, sz AS (SELECT username, anchor, count(*) AS size FROM gr GROUP BY ALL),
 vals AS (SELECT DISTINCT username, anchor, event_id, 'ip' AS kd, source_ip AS v FROM gr UNION SELECT username, anchor, event_id, 'ip', destination_ip FROM gr UNION SELECT username, anchor, event_id, 'domain', domain FROM gr UNION SELECT username, anchor, event_id, 'user', username FROM gr),
 held AS (SELECT username, anchor, kd, v, count(*) AS h FROM vals GROUP BY ALL), sh AS (SELECT username, anchor, count(*) FILTER (WHERE kd = 'ip') AS ips, count(*) FILTER (WHERE kd = 'domain') AS doms, count(*) FILTER (WHERE kd = 'user') AS users FROM held JOIN sz USING (username, anchor) WHERE h = size GROUP BY ALL),
 b AS (SELECT username, anchor, count(*) AS finding_count, max({rank()}) AS rk, epoch_us(max(timestamp)) - epoch_us(min(timestamp)) AS us, ({COMPAT}) AS comp,
  CASE WHEN {_has('ransomware')} THEN 'ransomware_attack' WHEN {_has('phishing')} THEN CASE WHEN {_has('credential', 'login')} THEN 'credential_phishing' ELSE 'phishing_campaign' END WHEN {_has('c2', 'beacon')} THEN 'c2_activity' WHEN {_has('exfil', 'breach')} THEN 'data_exfiltration' WHEN {_has('brute')} THEN 'brute_force_attack' WHEN {_has('lateral')} THEN 'lateral_movement' ELSE 'suspicious_activity' END AS classification,
  concat_ws(',', {', '.join(f"CASE WHEN {_has(*ws)} THEN '{st}' END" for st, ws in K.CHAIN_WORDS.items())}) AS attack_chain FROM gr GROUP BY ALL HAVING count(*) >= 2),
 s AS (SELECT b.*, coalesce(ips, 0) AS ips, coalesce(doms, 0) AS doms, coalesce(users, 0) AS users, least(coalesce(ips, 0) / 2.0, 1.0) * 0.15::double + least(coalesce(doms, 0) / 2.0, 1.0) * 0.12::double + least(coalesce(users, 0) / 2.0, 1.0) * 0.15::double
  + CASE WHEN us / 1e6 < 300 THEN 0.08::double * (1 - us / 1e6 / 300) ELSE 0 END + CASE WHEN comp THEN 0.04::double ELSE 0 END AS score FROM b LEFT JOIN sh USING (username, anchor))
 SELECT username, epoch_us(anchor) AS group_start, finding_count, ips AS shared_ips, doms AS shared_domains, users AS shared_users, round(score, 6) AS correlation_score, round(least(score * 1.2, 1.0), 6) AS confidence,
  CASE WHEN rk >= 4 THEN 'critical' WHEN rk = 3 THEN 'high' WHEN rk = 2 THEN 'medium' ELSE 'low' END AS severity, classification, attack_chain FROM s WHERE score >= 0.1500001""")
def _(spark, sf):
    done = K.correlate(_findings(spark, sf), 360, 0.1500001, ["username"])
    return done.select("username", "group_start", "finding_count", "shared_ips", "shared_domains", "shared_users", "correlation_score", "confidence", "severity", "classification", "attack_chain")
