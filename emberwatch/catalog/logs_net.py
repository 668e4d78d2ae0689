"""Queries: log and network analytics, quota."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.network import domain_suffixes, host_of, is_private
from ..functions.text import entropy
from ..operators import logs as L
from ..operators import metrics as M
from ..operators import network as N
from ..plans.blocked import running
from ..plans.fence import once
from .base import EV, FLOW, LOGS, PAIRS, canon, query

FAIL = (
    "(event_type IN ('auth_failed','login_failed','authentication_failure') OR status IN ('failure','failed','denied') OR action IN ('denied','blocked') "
    "OR windows_id IN ('4625','4771','4776') OR regexp_matches(message, '(?i)failed\\s+password\\s+for\\s+(?:invalid\\s+user\\s+)?(\\S+)\\s+from\\s+(\\S+)') "
    "OR regexp_matches(message, '(?i)authentication\\s+failure.*user=(\\S+).*rhost=(\\S+)') OR regexp_matches(message, '(?i)pam_unix.*authentication\\s+failure') "
    "OR regexp_matches(message, '(?i)an\\s+account\\s+failed\\s+to\\s+log\\s+on') OR regexp_matches(message, '(?i)logon\\s+failure.*user.*(\\S+)') "
    "OR regexp_matches(message, '(?i)(failed|invalid|bad)\\s+(login|auth|password|credential)') OR regexp_matches(message, '(?i)access\\s+denied'))"
)
PRIV = (
    "(event_type IN ('privilege_escalation','sudo_command','su_command') OR windows_id IN ('4672','4728','4732','4756') OR regexp_matches(message, '(?i)sudo.*command=') "
    "OR regexp_matches(message, '(?i)su\\s*:\\s*\\S+\\s+to\\s+root') OR regexp_matches(message, '(?i)privilege\\s+escalation'))"
)
W6H = "OVER (PARTITION BY {key} ORDER BY timestamp RANGE BETWEEN INTERVAL '21600 seconds' PRECEDING AND CURRENT ROW)"


def _brief(df, *cols):
    return df.select("event_id", "detection_type", "severity", "source", *cols)


@query("log_auth_failures", f"WITH {EV} SELECT event_id, source_ip FROM ev WHERE {FAIL}")
def _(spark, sf):
    return canon(spark, sf, *LOGS).filter(L.is_auth_failure()).select("event_id", "source_ip")


@query("log_brute_force", f"""WITH {EV}, f AS (SELECT event_id, timestamp, source_ip FROM ev WHERE {FAIL}),
 w AS (SELECT *, count(*) {W6H.format(key='source_ip')} AS n, min(timestamp) {W6H.format(key='source_ip')} AS t0 FROM f)
 SELECT cast(event_id AS string) AS event_id, 'brute_force' AS detection_type, 'high' AS severity, source_ip AS source, cast(n AS double) AS actual, epoch_us(t0) AS time_range_start,
 concat('Detected ', n, ' auth failures from ', source_ip, ' in 21600s') AS explanation FROM w WHERE n >= 2""")
def _(spark, sf):
    return _brief(L.brute_force(canon(spark, sf, *LOGS), 2, 21600), "actual", "time_range_start", "explanation")


@query("log_privilege_escalation", f"WITH {EV} SELECT cast(event_id AS string) AS event_id, 'privilege_escalation' AS detection_type, 'medium' AS severity, source_ip AS source FROM ev WHERE {PRIV}")
def _(spark, sf):
    return _brief(L.privilege_escalation(canon(spark, sf, *LOGS)))


@query("log_request_rate", f"""WITH {EV}, w AS (SELECT event_id, timestamp, source_ip, count(*) {W6H.format(key='source_ip')} AS n, min(timestamp) {W6H.format(key='source_ip')} AS t0 FROM ev)
 SELECT cast(event_id AS string) AS event_id, 'suspicious_rate' AS detection_type, 'medium' AS severity, source_ip AS source, cast(n AS double) AS actual, epoch_us(t0) AS time_range_start FROM w WHERE n >= 3""")
def _(spark, sf):
    return _brief(L.request_rate(canon(spark, sf, *LOGS), 3, 21600), "actual", "time_range_start")


@query("log_off_hours", f"""WITH {EV} SELECT cast(event_id AS string) AS event_id, 'off_hours_activity' AS detection_type, 'low' AS severity, source_ip AS source, cast(hour(timestamp) AS double) AS actual,
 concat('Auth activity at ', lpad(cast(hour(timestamp) AS string), 2, '0'), ':00 (outside business hours 8:00-18:00)') AS explanation
 FROM ev WHERE (contains(event_type, 'auth') OR contains(event_type, 'login') OR contains(event_type, 'session')) AND NOT (hour(timestamp) >= 8 AND hour(timestamp) < 18)""")
def _(spark, sf):
    return _brief(L.off_hours(canon(spark, sf, *LOGS)), "actual", "explanation")


ANOM = f"""{EV}, g AS (SELECT event_id, timestamp, source_ip, cast({FAIL} AS int) AS bad FROM ev),
 w AS (SELECT event_id, source_ip, count(*) {W6H.format(key='source_ip')} AS requests, sum(bad) {W6H.format(key='source_ip')} AS failures, timestamp FROM g),
 s AS (SELECT *, least(abs(requests - 10.0) / 10.0 / 3.0, 1.0) AS a, CASE WHEN failures > 0 THEN least(abs(failures - 1.0) / 1.0 / 3.0, 1.0) END AS b FROM w),
 z AS (SELECT event_id, source_ip, requests, cast(failures AS bigint) AS failures, CASE WHEN b IS NULL THEN a ELSE (a + b) / 2 END AS anomaly_score FROM s)"""


@query("log_anomaly_scores", f"WITH {ANOM} SELECT event_id, source_ip, requests, failures, round(anomaly_score, 6) AS anomaly_score, anomaly_score >= 1.0 / 3.0 AS is_anomaly FROM z")
def _(spark, sf):
    return L.anomaly_scores(canon(spark, sf, *LOGS), 21600).select("event_id", "source_ip", "requests", "failures", "anomaly_score", "is_anomaly")


@query("log_primary_findings", f"""WITH {EV}, f AS (SELECT event_id, timestamp, source_ip FROM ev WHERE {FAIL}),
 w AS (SELECT *, count(*) OVER (PARTITION BY source_ip ORDER BY timestamp RANGE BETWEEN INTERVAL '60 seconds' PRECEDING AND CURRENT ROW) AS n FROM f),
 r AS (SELECT event_id, timestamp, source_ip, count(*) OVER (PARTITION BY source_ip ORDER BY timestamp RANGE BETWEEN INTERVAL '60 seconds' PRECEDING AND CURRENT ROW) AS n,
  sum(cast({FAIL} AS int)) OVER (PARTITION BY source_ip ORDER BY timestamp RANGE BETWEEN INTERVAL '60 seconds' PRECEDING AND CURRENT ROW) AS m FROM ev),
 sc AS (SELECT *, least(abs(n - 10.0) / 10.0 / 3.0, 1.0) AS a, CASE WHEN m > 0 THEN least(abs(m - 1.0) / 3.0, 1.0) END AS b FROM r),
 u AS (SELECT event_id, timestamp, 3 AS rk, 'brute_force' AS d, 1 AS pos FROM w WHERE n >= 5
  UNION ALL SELECT event_id, timestamp, 2, 'privilege_escalation', 2 FROM ev WHERE {PRIV}
  UNION ALL SELECT event_id, timestamp, 2, 'suspicious_rate', 3 FROM r WHERE n >= 100
  UNION ALL SELECT event_id, timestamp, 1, 'off_hours_activity', 4 FROM ev WHERE (contains(event_type, 'auth') OR contains(event_type, 'login') OR contains(event_type, 'session')) AND NOT (hour(timestamp) >= 8 AND hour(timestamp) < 18)
  UNION ALL SELECT event_id, timestamp, 2, 'anomaly', 5 FROM sc WHERE (CASE WHEN b IS NULL THEN a ELSE (a + b) / 2 END) >= 1.0 / 3.0),
 x AS (SELECT *, strftime(timestamp, '%Y-%m-%d') AS batch_id, row_number() OVER (PARTITION BY strftime(timestamp, '%Y-%m-%d') ORDER BY rk DESC, timestamp, cast(event_id AS string), pos) AS rn FROM u)
 SELECT batch_id, max(CASE WHEN rn = 1 THEN cast(event_id AS string) END) AS event_id, max(CASE WHEN rn = 1 THEN d END) AS detection_type, string_agg(DISTINCT d, ',' ORDER BY d) AS detection_types, count(*) AS finding_count
 FROM x GROUP BY batch_id""")
def _(spark, sf):
    found = L.log_findings(canon(spark, sf, *LOGS)).withColumn("batch_id", F.date_format("timestamp", "yyyy-MM-dd"))
    return L.primary_findings(found).select("batch_id", "event_id", "detection_type", "detection_types", "finding_count")


@query("quota_sliding", f"""WITH {EV}, w AS (SELECT event_id, source_ip, count(*) OVER (PARTITION BY source_ip ORDER BY epoch_us(timestamp) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS current_count FROM ev)
 SELECT event_id, source_ip, current_count, current_count <= 4 AS is_allowed, greatest(4 - current_count, 0) AS remaining FROM w""")
def _(spark, sf):
    return M.quota_checks(canon(spark, sf, "event_id", "timestamp", "source_ip"), "source_ip", 4, window_sec=21600).drop("timestamp")


# ---- network -------------------------------------------------------------------------------------------------
PRIVATE = "({c} LIKE '10.%' OR {c} LIKE '192.168.%' OR regexp_matches({c}, '^172\\.(1[6-9]|2[0-9]|3[01])\\.'))"
C2P = "(destination_port IN (443,8443,4443,8080,8888,1337,31337,6667,6697) AND protocol IN ('tcp','https','ssl'))"
C2U = "regexp_matches(lower(user_agent), 'mozilla/4.0|python-requests|curl|wget|powershell')"
C2D = "regexp_matches(lower(domain), '\\.(tk|ml|ga|cf|gq|xyz|top|work)$')"
SUB = "CASE WHEN len(string_split(dns_query, '.')) > 2 THEN length(array_to_string(list_slice(string_split(dns_query, '.'), 1, len(string_split(dns_query, '.')) - 2), '.')) ELSE 0 END"
LAT = f"({PRIVATE.format(c='source_ip')} AND {PRIVATE.format(c='destination_ip')} AND destination_port IN (22,23,135,139,445,3389,5985,5986))"
ENT = """en AS (SELECT event_id, -sum(p * log2(p)) AS entropy FROM (SELECT event_id, ch, count(*) * 1.0 / max(n) AS p FROM
 (SELECT event_id, unnest(string_split(lower(dns_query), '')) AS ch, length(dns_query) AS n FROM ev) WHERE ch <> '' GROUP BY event_id, ch) GROUP BY event_id)"""


@query("net_entropy", f"WITH {EV}, {ENT} SELECT event_id, round(entropy, 6) AS entropy FROM en")
def _(spark, sf):
    return canon(spark, sf, "event_id", "dns_query").select("event_id", entropy("dns_query").alias("entropy"))


@query("net_flow_indicators", f"""WITH {EV}, {ENT}, i AS (
  SELECT event_id, 'c2_communication' AS t, 0.3 AS c FROM ev WHERE {C2P} UNION ALL SELECT event_id, 'c2_communication', 0.2 FROM ev WHERE {C2U} UNION ALL
  SELECT event_id, 'c2_communication', 0.25 FROM ev WHERE {C2D} UNION ALL SELECT event_id, 'dns_tunneling', 0.3 FROM ev WHERE {SUB} > 50 UNION ALL
  SELECT event_id, 'dns_tunneling', 0.25 FROM en WHERE entropy > 3.5 UNION ALL SELECT event_id, 'lateral_movement', 0.2 FROM ev WHERE {LAT})
 SELECT event_id, count(*) AS indicators, round(least(sum(cast(c AS double)), 1.0), 6) AS risk_score, string_agg(t, ',' ORDER BY t) AS kinds FROM i GROUP BY event_id""")
def _(spark, sf):
    rows = once(canon(spark, sf, *FLOW).withColumn("i", N.flow_indicators())).filter(F.size("i") > 0)
    return rows.select("event_id", F.size("i").alias("indicators"), N.risk_score("i").alias("risk_score"), F.array_sort(F.transform("i", lambda x: x["indicator_type"])).alias("kinds"))


@query("net_private_addresses", f"WITH {EV} SELECT event_id, {PRIVATE.format(c='source_ip')} AS src, {PRIVATE.format(c='destination_ip')} AS dst FROM ev")
def _(spark, sf):
    return canon(spark, sf, "event_id", "source_ip", "destination_ip").select("event_id", is_private("source_ip").alias("src"), is_private("destination_ip").alias("dst"))


PAIRW = "OVER (PARTITION BY source_ip, destination_ip ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING)"
SCAN = f"""ff AS (SELECT *, row_number() OVER (PARTITION BY source_ip, destination_ip, destination_port ORDER BY timestamp, event_id) AS seen FROM ev),
 ps AS (SELECT event_id, sum(CASE WHEN seen = 1 THEN 1 ELSE 0 END) {PAIRW} AS ports FROM ff)"""
EXF = f"""xf AS (SELECT event_id, sum(bytes_out) {PAIRW} AS total FROM ev WHERE bytes_out <> 0 AND NOT {PRIVATE.format(c='destination_ip')})"""


@query("net_port_scan", f"WITH {EV}, {SCAN} SELECT event_id, cast(ports AS bigint) AS unique_ports FROM ps WHERE ports >= 4")
def _(spark, sf):
    return N.port_scans(canon(spark, sf, *PAIRS), 4).select("event_id", "unique_ports")


@query("net_exfiltration_sent", f"WITH {EV}, xs AS (SELECT event_id, sum(bytes_out) {PAIRW} AS total FROM ev WHERE bytes_out <> 0 AND NOT {PRIVATE.format(c='destination_ip')}) SELECT event_id, cast(total AS bigint) AS bytes_transferred FROM xs WHERE total >= 300000")
def _(spark, sf):
    """Every third flow names its bytes ``bytes_sent``."""
    flows = canon(spark, sf, *PAIRS)
    other = F.col("event_id") % 3 == 0
    flows = flows.withColumn("bytes_sent", F.when(other, F.col("bytes_out"))).withColumn("bytes_out", F.when(~other, F.col("bytes_out")))
    return N.exfiltration(flows, 300_000).select("event_id", "bytes_transferred")


@query("net_exfiltration", f"WITH {EV}, {EXF} SELECT event_id, cast(total AS bigint) AS bytes_transferred FROM xf WHERE total >= 200000")
def _(spark, sf):
    return N.exfiltration(canon(spark, sf, *PAIRS), 200_000).select("event_id", "bytes_transferred")


GAPS = """ga AS (SELECT event_id, timestamp, source_ip, destination_ip, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY source_ip, destination_ip ORDER BY timestamp, event_id)) / 1e6 AS gap0 FROM ev),
 gp AS (SELECT *, CASE WHEN gap0 > 0 THEN gap0 END AS gap FROM ga)"""


@query("net_beacon_pairs", f"""WITH {EV}, {GAPS} SELECT source_ip, destination_ip, count(*) AS connection_count, count(gap) AS gap_count, round(avg(gap), 3) AS avg_interval_sec,
 round(stddev_pop(gap) / avg(gap), 6) AS variation FROM gp GROUP BY ALL HAVING count(*) >= 5 AND count(gap) >= 3 AND stddev_pop(gap) / avg(gap) < 0.7""")
def _(spark, sf):
    return N.beacon_pairs(canon(spark, sf, *PAIRS), 0.7).withColumn("avg_interval_sec", F.round("avg_interval_sec", 3))


@query("net_beacons_running", f"""WITH {EV}, {GAPS}, r AS (SELECT event_id, count(*) {PAIRW} AS n, count(gap) {PAIRW} AS g, avg(gap) {PAIRW} AS m, stddev_pop(gap) {PAIRW} AS s FROM gp)
 SELECT event_id, n AS connection_count, g AS gap_count, round(s / m, 5) AS variation FROM r WHERE n >= 5 AND g >= 3 AND s / m < 0.6""")
def _(spark, sf):
    return N.beacons(canon(spark, sf, *PAIRS), 0.6).select("event_id", "connection_count", "gap_count", F.round("variation", 5).alias("variation"))


@query("net_findings", f"""WITH {EV}, {ENT}, {SCAN}, {EXF}, {GAPS}, r AS (SELECT event_id, count(*) {PAIRW} AS n, count(gap) {PAIRW} AS g, avg(gap) {PAIRW} AS m, stddev_pop(gap) {PAIRW} AS s FROM gp),
 i AS (SELECT event_id, 'c2_communication' AS t, 0.3 AS c, 3 AS rk, 1 AS pos FROM ev WHERE {C2P} UNION ALL SELECT event_id, 'c2_communication', 0.2, 2, 2 FROM ev WHERE {C2U} UNION ALL
  SELECT event_id, 'c2_communication', 0.25, 2, 3 FROM ev WHERE {C2D} UNION ALL SELECT event_id, 'port_scan', 0.25, 2, 4 FROM ps WHERE ports >= 4 UNION ALL
  SELECT event_id, 'data_exfiltration', 0.35, 3, 5 FROM xf WHERE total >= 200000 UNION ALL SELECT event_id, 'dns_tunneling', 0.3, 3, 6 FROM ev WHERE {SUB} > 50 UNION ALL
  SELECT event_id, 'dns_tunneling', 0.25, 2, 7 FROM en WHERE entropy > 3.5 UNION ALL SELECT event_id, 'beaconing', 0.4, 3, 8 FROM r WHERE n >= 5 AND g >= 3 AND s / m < 0.1 UNION ALL
  SELECT event_id, 'lateral_movement', 0.2, 2, 9 FROM ev WHERE {LAT}),
 b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY rk DESC, c DESC, pos) AS rn FROM i)
 SELECT event_id, max(CASE WHEN rn = 1 THEN t END) AS threat_type, CASE max(rk) WHEN 3 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN count(*) > 2 THEN 'high' ELSE 'medium' END AS confidence,
  count(*) AS indicator_count, round(least(sum(cast(c AS double)), 1.0), 6) AS risk_score FROM b GROUP BY event_id""")
def _(spark, sf):
    flows = canon(spark, sf, *FLOW).withColumn("bytes_in", F.lit(0))
    return N.network_findings(N.network_indicators(flows, 4, 200_000)).select("event_id", "threat_type", "severity", "confidence", "indicator_count", "risk_score")


@query("net_bytes_running_max", f"WITH {EV} SELECT event_id, max(bytes_out) OVER (PARTITION BY source_ip ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS top_bytes FROM ev")
def _(spark, sf):
    rows = canon(spark, sf, "event_id", "timestamp", "source_ip", "bytes_out")
    return running(rows, ["source_ip"], ["timestamp", "event_id"], maxes={"top_bytes": F.col("bytes_out")}).select("event_id", "top_bytes")


@query("url_hosts_and_suffixes", """WITH h AS (SELECT page_id, split_part(split_part(CASE WHEN contains(lower(url), '://') THEN split_part(lower(url), '://', 2) ELSE lower(url) END, '/', 1), ':', 1) AS host FROM pages),
 l AS (SELECT page_id, host, string_split(host, '.') AS parts FROM h)
 SELECT page_id, host, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(list_slice(parts, i, len(parts)), '.')), ',') AS suffixes FROM l""")
def _(spark, sf):
    from .base import table

    return table(spark, sf, "pages").select("page_id", host_of("url").alias("host"), domain_suffixes(host_of("url")).alias("suffixes"))
