"""Queries: parsing, normalising, validation, ingest metrics. Raw texts are built from the events and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import normalize as N
from ..operators import validate as V
from ..operators.parse import Format, Formats
from .base import EV, canon, query

AS_OF = "2024-02-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


# text templates valid in both engines, over the canonical view
STAMP_SPARK, STAMP_SQL = "date_format(timestamp, \"yyyy-MM-dd'T'HH:mm:ss\")", "strftime(timestamp, '%Y-%m-%dT%H:%M:%S')"


def _raw(spark, sf, expr: str, hint: str | None = None) -> DataFrame:
    rows = canon(spark, sf).selectExpr("event_id as source_position", f"{expr.replace('{stamp}', STAMP_SPARK)} as raw")
    return rows.withColumn("source_type", F.lit(hint)) if hint else rows


SURICATA = """concat('{"timestamp": "', {stamp}, 'Z", "event_type": "', case when k % 3 = 0 then 'alert' else 'flow' end, '", "src_ip": "', source_ip, '", "dest_ip": "', destination_ip, '", "src_port": ', source_port,
 ', "dest_port": ', destination_port, ', "proto": "', protocol, '", "alert": {"action": "Blocked", "signature": "sig', k, '", "severity": ', k % 5, '}, "http": {"hostname": "', domain, '", "url": "/p', k, '"}}')"""


@query("parse_suricata", f"""WITH {EV} SELECT event_id AS source_position, CASE WHEN k % 3 = 0 THEN 'network_ids_alert' ELSE 'network_flow' END AS event_type,
 CASE WHEN k % 5 <= 1 THEN 'critical' WHEN k % 5 = 2 THEN 'high' WHEN k % 5 = 3 THEN 'medium' ELSE 'low' END AS severity, source_ip, destination_ip, cast(source_port AS bigint) AS source_port, cast(destination_port AS bigint) AS destination_port,
 upper(protocol) AS protocol, concat('http://', domain, '/p', k) AS url, domain AS hostname, 'blocked' AS action, CASE WHEN k % 3 = 0 THEN 'triggered' ELSE 'success' END AS status, 'suricata' AS source, 'network_ids' AS source_type,
 epoch_us(date_trunc('second', timestamp)) AS timestamp FROM ev""")
def _(spark, sf):
    return N.ingest(_raw(spark, sf, SURICATA), as_of()).select("source_position", "event_type", "severity", "source_ip", "destination_ip", "source_port", "destination_port", "protocol", "url",
                                                             "hostname", "action", "status", "source", "source_type", "timestamp")


SYSLOG = """case k % 4 when 0 then concat('<', 80 + k % 8, '>Jan  9 10:15:30 ', hostname, ' sshd[', k, ']: Failed password for invalid user ', username, ' from ', source_ip, ' port ', source_port, ' ssh2')
 when 1 then concat('Jan 12 10:15:30 ', hostname, ' kernel: [UFW ', case when k % 3 = 0 then 'BLOCK' else 'ALLOW' end, '] IN=eth0 OUT= SRC=', source_ip, ' DST=', destination_ip, ' LEN=40 PROTO=', protocol, ' SPT=', source_port, ' DPT=', destination_port)
 when 2 then concat('<', 32 + k % 8, '>1 2024-01-09T10:15:30Z ', hostname, ' app', k % 3, ' 77 ID - state ', k)
 else concat('Jan 12 10:15:30 ', hostname, ' sudo: ', username, ' : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/x', k) end"""


@query("parse_syslog", f"""WITH {EV} SELECT event_id AS source_position, CASE k % 4 WHEN 0 THEN 'auth_failed' WHEN 1 THEN 'firewall_drop' WHEN 2 THEN 'syslog_generic' ELSE 'privilege_escalation' END AS event_type,
 CASE k % 4 WHEN 0 THEN 'medium' WHEN 1 THEN CASE WHEN k % 3 = 0 THEN 'medium' ELSE 'low' END WHEN 2 THEN CASE WHEN k % 8 <= 1 THEN 'critical' WHEN k % 8 = 2 THEN 'high' WHEN k % 8 = 3 THEN 'medium' ELSE 'low' END ELSE 'low' END AS severity,
 CASE WHEN k % 4 IN (0, 3) THEN username END AS username, CASE WHEN k % 4 IN (0, 1) THEN source_ip END AS source_ip, CASE WHEN k % 4 = 1 THEN destination_ip END AS destination_ip,
 cast(CASE WHEN k % 4 IN (0, 1) THEN source_port END AS bigint) AS source_port, cast(CASE WHEN k % 4 = 1 THEN destination_port END AS bigint) AS destination_port, CASE WHEN k % 4 = 1 THEN upper(protocol) END AS protocol, hostname,
 CASE k % 4 WHEN 0 THEN 'denied' WHEN 1 THEN CASE WHEN k % 3 = 0 THEN 'blocked' ELSE 'allowed' END WHEN 2 THEN 'logged' ELSE 'executed' END AS action,
 CASE k % 4 WHEN 0 THEN 'syslog.sshd' WHEN 1 THEN 'syslog.kernel' WHEN 2 THEN concat('syslog.app', k % 3) ELSE 'syslog.sudo' END AS source,
 epoch_us(CASE WHEN k % 4 IN (0, 2) THEN timestamp '2024-01-09 10:15:30' ELSE timestamp '2024-01-12 10:15:30' END) AS timestamp FROM ev""")
def _(spark, sf):
    return N.ingest(_raw(spark, sf, SYSLOG), as_of()).select("source_position", "event_type", "severity", "username", "source_ip", "destination_ip", "source_port", "destination_port", "protocol",
                                                           "hostname", "action", "source", "timestamp")


WEB = """concat(source_ip, ' - ', case when k % 2 = 0 then '-' else username end, ' [09/Jan/2024:10:15:30 +0000] "GET ', case k % 5 when 0 then concat('/a?id=1%27--', k) when 1 then concat('/b?x=javascript:', k) else concat('/c/', k) end,
 ' HTTP/1.1" ', case k % 6 when 0 then 401 when 1 then 403 when 2 then 404 when 3 then 503 else 200 end, ' 512 "-" "', user_agent, '"')"""


@query("parse_web_access", f"""WITH {EV} SELECT event_id AS source_position, CASE WHEN k % 5 = 0 THEN 'web_sqli_attempt' WHEN k % 5 = 1 THEN 'web_xss_attempt' ELSE CASE k % 6 WHEN 0 THEN 'web_unauthorized' WHEN 1 THEN 'web_forbidden' WHEN 2 THEN 'web_not_found' WHEN 3 THEN 'web_server_error' ELSE 'web_access' END END AS event_type,
 CASE WHEN k % 5 IN (0, 1) THEN 'high' ELSE CASE k % 6 WHEN 0 THEN 'medium' WHEN 1 THEN 'medium' WHEN 3 THEN 'high' ELSE 'low' END END AS severity, source_ip, CASE WHEN k % 2 = 1 THEN username END AS username,
 CASE k % 5 WHEN 0 THEN concat('/a?id=1%27--', k) WHEN 1 THEN concat('/b?x=javascript:', k) ELSE concat('/c/', k) END AS url, CASE k % 6 WHEN 0 THEN 'denied' WHEN 1 THEN 'blocked' ELSE 'allowed' END AS action,
 CASE WHEN k % 6 <= 3 THEN 'failure' ELSE 'success' END AS status, user_agent, epoch_us(timestamp '2024-01-09 10:15:30') AS timestamp FROM ev""")
def _(spark, sf):
    return N.ingest(_raw(spark, sf, WEB), as_of()).select("source_position", "event_type", "severity", "source_ip", "username", "url", "action", "status",
                                                        F.try_element_at("metadata", F.lit("user_agent")).alias("user_agent"), "timestamp")


AUTH = """concat('{"EventID": ', case k % 4 when 0 then 4625 when 1 then 4624 when 2 then 4740 else 9999 end, ', "TimeCreated": "', {stamp}, 'Z", "TargetUserName": "', username, '", "IpAddress": "', source_ip, '", "IpPort": ', source_port,
 ', "LogonType": ', 2 + k % 4, ', "WorkstationName": "', hostname, '", "TargetDomainName": "CORP", "eventName": "', case when k % 8 = 3 then 'LoginFailed' else 'Login' end, '"}')"""


@query("parse_authentication", f"""WITH {EV} SELECT event_id AS source_position, CASE k % 4 WHEN 0 THEN 'user_logon_failed' WHEN 1 THEN 'user_logon_success' WHEN 2 THEN 'user_account_locked_out' ELSE CASE WHEN k % 8 = 3 THEN 'auth_failed' ELSE 'auth_success' END END AS event_type,
 CASE WHEN k % 4 IN (0, 2) OR k % 8 = 3 THEN 'high' ELSE 'low' END AS severity, username, hostname, 'CORP' AS domain, source_ip, cast(source_port AS bigint) AS source_port,
 CASE k % 4 WHEN 2 THEN 'locked' ELSE CASE WHEN k % 4 = 0 OR k % 8 = 3 THEN 'denied' ELSE 'allowed' END END AS action,
 concat('windows_security_event_', CASE k % 4 WHEN 0 THEN 4625 WHEN 1 THEN 4624 WHEN 2 THEN 4740 ELSE 9999 END) AS source,
 CASE k % 4 WHEN 0 THEN 'Interactive (Console)' WHEN 1 THEN 'Network (SMB/RPC)' WHEN 2 THEN 'Batch' ELSE 'Service' END AS logon FROM ev""")
def _(spark, sf):
    return N.ingest(_raw(spark, sf, AUTH), as_of()).select("source_position", "event_type", "severity", "username", "hostname", "domain", "source_ip", "source_port", "action", "source",
                                                         F.try_element_at("metadata", F.lit("logon_type_desc")).alias("logon"))


MAIL = """concat('{"timestamp": ', 1704067200 + event_id, ', "sender": "', username, '@mail', k % 5, '.example", "recipient": "x@corp.example", "spf_result": "', case k % 3 when 0 then 'Fail' else 'pass' end,
 '", "phishing_score": 0.', k % 10, ', "urls": ["', 'http://u', k, '.example/a", "http://z"], "attachment_hashes": [', case when k % 2 = 0 then concat('"h', k, '"') else '' end, ']}')"""


@query("parse_email", f"""WITH {EV} SELECT event_id AS source_position, CASE WHEN k % 10 >= 7 THEN 'email_phishing_detected' WHEN k % 3 = 0 THEN 'email_auth_failure' ELSE 'email_delivered' END AS event_type,
 CASE WHEN k % 10 >= 7 THEN 'high' WHEN k % 3 = 0 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN k % 10 >= 7 THEN 'blocked' WHEN k % 3 = 0 THEN 'flagged' ELSE 'delivered' END AS action,
 concat('mail', k % 5, '.example') AS domain, concat('http://u', k, '.example/a') AS url, CASE WHEN k % 2 = 0 THEN concat('h', k) END AS hash, (1704067200 + event_id) * 1000000 AS timestamp FROM ev""")
def _(spark, sf):
    return N.ingest(_raw(spark, sf, MAIL), as_of()).select("source_position", "event_type", "severity", "action", "domain", "url", "hash", "timestamp")


JSON = """concat('{"@timestamp": "', {stamp}, '+02:00", "', case when k % 2 = 0 then 'source.ip' else 'src' end, '": "', source_ip, '", "destination": {"ip": "', destination_ip, '", "port": ', destination_port, '}, "eventName": "', upper(event_type),
 '", "risk_level": "', case k % 3 when 0 then 'warning' when 1 then 'P1' else 'other' end, '", "user.name": "', username, '", "outcome": "FAILED", "vendor": "v', k % 4, '"}')"""


@query("parse_json", f"""WITH {EV} SELECT event_id AS source_position, event_type, CASE k % 3 WHEN 0 THEN 'medium' WHEN 1 THEN 'high' ELSE 'low' END AS severity, source_ip, destination_ip, cast(destination_port AS bigint) AS destination_port, username, 'failed' AS status,
 concat('v', k % 4) AS source, 'generic_json' AS source_type, epoch_us(date_trunc('second', timestamp)) - 7200000000 AS timestamp FROM ev""")
def _(spark, sf):
    return N.ingest(_raw(spark, sf, JSON), as_of()).select("source_position", "event_type", "severity", "source_ip", "destination_ip", "destination_port", "username", "status", "source", "source_type", "timestamp")


MIX = f"""case k % 8 when 0 then {SURICATA} when 1 then {SYSLOG} when 2 then {WEB} when 3 then {AUTH} when 4 then {MAIL} when 5 then {JSON} when 6 then concat('no known form ', k) else concat('{{"name": "', repeat('x', 100 + k), '"}}') end"""
MIX_KIND = "CASE k % 8 WHEN 0 THEN 'suricata' WHEN 1 THEN 'syslog' WHEN 2 THEN 'application' WHEN 3 THEN 'authentication' WHEN 4 THEN 'email' WHEN 5 THEN 'json' WHEN 6 THEN 'unknown' ELSE 'json' END"
MIX_ERR = "CASE WHEN k % 8 = 6 THEN 'unknown_source_format' WHEN k % 8 = 7 AND k > 28 THEN 'normalization_exception' END"


@query("detect_format", f"WITH {EV} SELECT event_id AS source_position, {MIX_KIND} AS format FROM ev")
def _(spark, sf):
    return N.ingest(_raw(spark, sf, MIX), as_of()).select("source_position", "format")


@query("ingest_summary", f"WITH {EV} SELECT count(*) AS total, count(*) FILTER (WHERE {MIX_ERR} IS NULL) AS accepted, count(*) FILTER (WHERE {MIX_ERR} IS NOT NULL) AS rejected FROM ev")
def _(spark, sf):
    return N.ingest_summary(N.ingest(_raw(spark, sf, MIX), as_of()))


@query("dead_letters", f"WITH {EV} SELECT {MIX_ERR} AS error_type, {MIX_KIND} AS source_type, CASE WHEN k % 8 = 6 THEN concat('no known form ', k) ELSE concat('{{\"name\": \"', repeat('x', 100 + k), '\"}}') END AS raw_payload, count(*) AS n FROM ev WHERE {MIX_ERR} IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    return N.dead_letters(N.ingest(_raw(spark, sf, MIX), as_of())).groupBy("error_type", "source_type", "raw_payload").agg(F.count(F.lit(1)).alias("n"))


MIX_SEV = """CASE k % 8 WHEN 0 THEN CASE WHEN k % 5 <= 1 THEN 'critical' WHEN k % 5 = 2 THEN 'high' WHEN k % 5 = 3 THEN 'medium' ELSE 'low' END
 WHEN 1 THEN CASE k % 4 WHEN 0 THEN 'medium' WHEN 1 THEN CASE WHEN k % 3 = 0 THEN 'medium' ELSE 'low' END WHEN 2 THEN CASE WHEN k % 8 <= 1 THEN 'critical' WHEN k % 8 = 2 THEN 'high' WHEN k % 8 = 3 THEN 'medium' ELSE 'low' END ELSE 'low' END
 WHEN 2 THEN CASE WHEN k % 5 IN (0, 1) THEN 'high' ELSE CASE k % 6 WHEN 0 THEN 'medium' WHEN 1 THEN 'medium' WHEN 3 THEN 'high' ELSE 'low' END END WHEN 3 THEN CASE WHEN k % 4 IN (0, 2) OR k % 8 = 3 THEN 'high' ELSE 'low' END
 WHEN 4 THEN CASE WHEN k % 10 >= 7 THEN 'high' WHEN k % 3 = 0 THEN 'medium' ELSE 'low' END WHEN 5 THEN CASE k % 3 WHEN 0 THEN 'medium' WHEN 1 THEN 'high' ELSE 'low' END ELSE 'low' END"""


@query("ingest_snapshot", f"""WITH {EV}, g AS (SELECT {MIX_ERR} AS e, CASE k % 8 WHEN 0 THEN 'network_ids' WHEN 1 THEN 'syslog' WHEN 2 THEN 'application_log' WHEN 3 THEN 'authentication' WHEN 4 THEN 'email_security' ELSE 'generic_json' END AS st, {MIX_SEV} AS sev FROM ev),
 t AS (SELECT count(*) AS r, count(*) FILTER (WHERE e IS NULL) AS a, count(*) FILTER (WHERE e IS NOT NULL) AS x FROM g)
 SELECT 'total' AS dimension, 'events_received' AS value, r AS n, cast(NULL AS double) AS rate FROM t UNION ALL SELECT 'total', 'events_accepted', a, round_even(a / greatest(r, 1) * 100, 2) FROM t UNION ALL SELECT 'total', 'events_rejected', x, NULL FROM t
 UNION ALL SELECT 'source_type', st, count(*), NULL FROM g WHERE e IS NULL GROUP BY st UNION ALL SELECT 'severity', sev, count(*), NULL FROM g WHERE e IS NULL GROUP BY sev""")
def _(spark, sf):
    return M.ingest_snapshot(N.ingest(_raw(spark, sf, MIX), as_of()))


# a format registered with its own fields: parts between bars; each eleventh payload has no kind of event
BARS = """concat('@bars|', {stamp}, '|', case when k % 11 = 0 then '' else concat('kind', k % 7) end, '|', source_ip, '|', source_port, '|', case k % 3 when 0 then 'CRIT' when 1 then 'warning' else 'other' end, '|', username)"""


def bars() -> Formats:
    part = lambda i: F.nullif(F.get(F.split("raw", r"\|"), F.lit(i)), F.lit(""))
    form = Format(
        {"timestamp": part(1), "source": F.lit("bars"), "source_type": F.lit("bar_log"), "event_type": part(2), "source_ip": part(3), "source_port": part(4),
         "severity": part(5), "username": part(6), "metadata": F.create_map(F.lit("width"), F.length("raw").cast("string"))},
        F.col("raw").startswith("@bars|"), "bar_parser", "2.1.0")
    return Formats().register("bars", form)


BARS_SQL = f"WITH {EV}, r AS (SELECT *, {BARS.replace('{stamp}', STAMP_SQL)} AS raw FROM ev)"


@query("registered_format", f"""{BARS_SQL} SELECT event_id AS source_position, concat('kind', k % 7) AS event_type, 'bars' AS source, 'bar_log' AS source_type, CASE k % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, source_ip, cast(source_port AS bigint) AS source_port, username,
 '2.1.0' AS parser_version, cast(length(raw) AS varchar) AS width, epoch_us(date_trunc('second', timestamp)) AS timestamp FROM r WHERE k % 11 <> 0""")
def _(spark, sf):
    done = N.ingest(_raw(spark, sf, BARS), as_of(), bars()).filter(F.col("error_type").isNull())
    return done.select("source_position", "event_type", "source", "source_type", "severity", "source_ip", "source_port", "username", "parser_version", F.try_element_at("metadata", F.lit("width")).alias("width"), "timestamp")


@query("registered_format_refused", f"{BARS_SQL} SELECT raw AS raw_payload, 'bars' AS source_type, 'parsing_exception' AS error_type, 'Parsing exception: no event_type' AS error_message FROM r WHERE k % 11 = 0")
def _(spark, sf):
    return N.dead_letters(N.ingest(_raw(spark, sf, BARS), as_of(), bars())).select("raw_payload", "source_type", "error_type", "error_message")


@query("dead_letter_listing", f"WITH {EV} SELECT event_id, {MIX_ERR} AS error_type FROM ev WHERE {MIX_ERR} = 'normalization_exception'")
def _(spark, sf):
    letters = N.dead_letters(N.ingest(_raw(spark, sf, MIX), as_of()).withColumn("event_id", F.concat(F.lit("evt_"), F.col("source_position"))))
    return N.query_dead_letters(letters, error_type="normalization_exception").select(F.substring("dead_letter_id", 5, 32).cast("bigint").alias("event_id"), "error_type")


@query("ecs_block", f"""WITH {EV} SELECT event_id AS source_position, source_ip AS ip, destination_port AS port, lower(protocol) AS transport, username AS user_name, 'json' AS category FROM (SELECT * REPLACE (cast(destination_port AS string) AS destination_port) FROM ev)""")
def _(spark, sf):
    expr = """concat('{"src": "', source_ip, '", "destPort": ', destination_port, ', "proto": "', protocol, '", "actor": "', username, '"}')"""
    get = lambda p: F.get_json_object("normalized_data", p)
    return N.ingest(_raw(spark, sf, expr), as_of()).select("source_position", get("$.network.source.ip").alias("ip"), get("$.network.destination.port").alias("port"), get("$.network.transport").alias("transport"),
                                                         get("$.user.name").alias("user_name"), get("$.event.category[0]").alias("category"))


@query("demo_tags", f"WITH {EV} SELECT event_id AS source_position, CASE WHEN k % 3 = 0 THEN 'lab' WHEN k % 3 = 1 THEN 'DEMONSTRATION' END AS environment, CASE WHEN k % 3 < 2 THEN 'true' END AS synthetic FROM ev")
def _(spark, sf):
    expr = """case k % 3 when 0 then concat('{"name": "n", "environment": "lab", "synthetic": true, "k": ', k, '}') when 1 then concat('Jan  9 10:15:30 h app: DEMONSTRATION ', k) else concat('Jan  9 10:15:30 h app: live ', k) end"""
    get = lambda k: F.try_element_at("metadata", F.lit(k))
    return N.ingest(_raw(spark, sf, expr), as_of()).select("source_position", get("environment").alias("environment"), get("synthetic").alias("synthetic"))


@query("lineage", f"WITH {EV} SELECT raw AS raw_input, 'v' AS source, '1.0.0' AS parser_version, count(*) AS n FROM (SELECT concat('{{\"vendor\": \"v\", \"k\": ', k, '}}') AS raw FROM ev) GROUP BY ALL")
def _(spark, sf):
    done = N.accepted(N.ingest(_raw(spark, sf, "concat('{\"vendor\": \"v\", \"k\": ', k, '}')"), as_of()))
    return N.lineage(done).groupBy("raw_input", "source", "parser_version").agg(F.count(F.lit(1)).alias("n"))


# ---- validation ----------------------------------------------------------------------------------------------
EVENT_JSON = """concat('{"event_id": "e', event_id, '", ', case when k % 10 = 1 then '' else '"source": "s", ' end, '"source_type": "t", "event_type": "', event_type, '", "timestamp": "', case when k % 10 = 2 then 'bad' else {stamp} end,
 '", "severity": "', case when k % 10 = 3 then 'urgent' else upper(severity) end, '", "raw_data": "r", "normalized_data": {}, "source_ip": "', case when k % 10 = 4 then '256.1.1.1' else source_ip end, '", "source_port": ', case when k % 10 = 5 then 70000 else source_port end,
 ', "metadata": ', case when k % 10 = 6 then '5' else '{}' end, case when k % 10 = 7 then ', "zzz": 1' else '' end, case when k % 10 = 8 then concat(', "protocol": "', repeat('p', 40), '"') else '' end, '}')"""
VAL_KIND = "CASE k % 10 WHEN 1 THEN 'source:missing' WHEN 2 THEN 'timestamp:value_error' WHEN 3 THEN 'severity:enum' WHEN 4 THEN 'source_ip:value_error' WHEN 5 THEN 'source_port:less_than_equal' WHEN 6 THEN 'metadata:value_error' WHEN 7 THEN 'zzz:extra_forbidden' WHEN 8 THEN 'protocol:string_too_long' ELSE '' END"


@query("validate_events", f"WITH {EV} SELECT event_id AS source_position, {VAL_KIND} = '' AS is_valid, {VAL_KIND} AS errors FROM ev")
def _(spark, sf):
    done = V.validate_events(_raw(spark, sf, EVENT_JSON))
    return done.select("source_position", "is_valid", F.array_join(F.transform("validation_errors", lambda e: F.concat_ws(":", e["loc"], e["type"])), ",").alias("errors"))


@query("validated_events", f"WITH {EV} SELECT concat('e', event_id) AS event_id, severity, source_ip, cast(source_port AS bigint) AS source_port, epoch_us(date_trunc('second', timestamp)) AS timestamp FROM ev WHERE {VAL_KIND} = ''")
def _(spark, sf):
    return V.validated_events(_raw(spark, sf, EVENT_JSON)).select("event_id", "severity", "source_ip", "source_port", "timestamp")


@query("norm_ip", f"""WITH {EV} SELECT event_id, CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 1 THEN source_ip WHEN k % 6 = 2 THEN concat('2001:db8::', CASE WHEN k % 6 = 2 THEN lower(to_hex(k + 1)) END) WHEN k % 6 = 3 THEN NULL ELSE source_ip END AS ip FROM ev""")
def _(spark, sf):
    from ..functions.network import norm_ip

    text = """case k % 6 when 0 then '-' when 1 then concat(source_ip, ':8080') when 2 then concat('2001:0DB8:0000:0:0:0:0:', lower(hex(k + 1))) when 3 then '300.1.1.1' when 4 then concat(' ', source_ip, ' ') else source_ip end as t"""
    return canon(spark, sf).selectExpr("event_id", text).select("event_id", norm_ip("t").alias("ip"))
