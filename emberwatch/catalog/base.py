"""Query registry and the canonical view of the test tables.

The view is given as SQL expressions that Spark and DuckDB read alike; everything built on it is
written twice, as a DataFrame job and as an independent SQL text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.bounds import before
from ..plans.fence import once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

K = "cast(regexp_extract(props, '([0-9]+)', 1) as bigint)"

#: expressions over event_id, ts, user_id, event_type (as kind), value, k
FIRST = {
    "source_ip": "concat('10.0.', user_id % 3, '.', user_id % 50 + 1)",
    "destination_ip": "case k % 4 when 0 then concat('10.1.0.', k % 3 + 1) when 1 then concat('203.0.113.', (k % 3) * 100) "
                      "when 2 then concat('198.51.100.', k) else concat('192.168.1.', k % 5) end",
    "source_port": "cast(1024 + event_id % 50000 as int)",
    "destination_port": "cast(case k % 9 when 0 then 22 when 1 then 80 when 2 then 443 when 3 then 445 when 4 then 3389 when 5 then 8080 "
                        "when 6 then 31337 when 7 then 5985 else 1024 + k end as int)",
    "protocol": "case when k % 5 = 0 then 'udp' else 'tcp' end",
    "event_type": "case kind when 'error' then case k % 3 when 0 then 'auth_failed' when 1 then 'login_failed' else 'brute_force' end "
                  "when 'click' then case k % 4 when 0 then 'port_scan' when 1 then 'lateral_movement' when 2 then 'process_creation' else 'web_access' end "
                  "when 'purchase' then case k % 3 when 0 then 'data_exfiltration' when 1 then 'ransomware' else 'c2_communication' end "
                  "when 'signup' then case k % 3 when 0 then 'phishing' when 1 then 'privilege_escalation' else 'user_account_created' end "
                  "else case k % 4 when 0 then 'session_created' when 1 then 'credential_dump' when 2 then 'beaconing' else 'file_enumeration' end end",
    "severity": "case k % 10 when 0 then 'critical' when 1 then 'high' when 2 then 'high' when 3 then 'medium' when 4 then 'medium' when 5 then 'medium' "
                "when 9 then 'informational' else 'low' end",
    "status": "case k % 6 when 0 then 'denied' when 1 then 'success' else 'ok' end",
    "action": "case k % 7 when 0 then 'blocked' else 'allowed' end",
    "bytes_out": "cast(floor(value * 1000) as bigint)",
    "username": "concat('user_', user_id)",
    "hostname": "concat('host-', user_id % 20)",
    "domain": "case k % 8 when 0 then 'c2-beacon.example.net' when 1 then 'a.fake-bank-login.xyz' when 2 then 'files.top' when 3 then 'evil.com' else 'intra.example.org' end",
    "url": "case k % 10 when 0 then 'http://shop.example.org/search?q=1 UNION SELECT name FROM t' when 1 then '/login?id=5 or 1=1' when 2 then '/x?p=../../etc/passwd' "
           "when 3 then '/x?c=<script>alert(1)</script>' when 4 then concat('/a?b=', '$', '{jndi:ldap://x/a}') when 5 then 'http://169.254.169.254/latest' "
           "when 6 then 'http://evil.c2-beacon.example.net' when 7 then 'http://10.0.0.5/admin' else concat('http://intra.example.org/p/', k) end",
    "hash": "case k % 25 when 0 then '44D88612FEA8A8F36DE82E1278ABB02F' when 1 then 'd41d8cd98f00b204e9800998ecf8427e' else md5(cast(event_id as string)) end",
    "user_agent": "case k % 6 when 0 then 'sqlmap/1.7' when 1 then 'curl/8.0' else 'Firefox/120' end",
    "dns_query": "case k % 12 when 0 then concat(md5(cast(event_id as string)), md5(cast(k as string)), '.t.example.com') "
                 "when 1 then concat(md5(cast(k as string)), '.example.com') else 'www.aaa.com' end",
    "message": "case k % 5 when 0 then 'Failed password for invalid user bob from 1.2.3.4 port 22' when 1 then 'sudo: alice : COMMAND=/bin/ls' "
               "when 2 then 'Access denied for client' else 'request served' end",
    "source": "case kind when 'error' then 'linux.sshd' when 'click' then 'suricata' else 'application.webapp' end",
    "source_type": "case kind when 'error' then 'authentication' when 'click' then 'network_ids' when 'purchase' then 'email_security' when 'signup' then 'syslog' else 'application' end",
    "windows_id": "case k % 20 when 0 then '4625' when 1 then '4672' else '' end",
    "category": "case k % 4 when 0 then 'port scan' else 'web traffic' end",
}
SECOND = {
    "raw_data": "concat('{\"message\": \"', message, '\", \"user_agent\": \"', user_agent, '\"}')",
}

#: the same view for DuckDB, as a CTE named ev (timestamp column: timestamp)
EV = (
    f"ev0 AS (SELECT event_id, ts, user_id, event_type AS kind, value, {K} AS k FROM events), "
    f"ev1 AS (SELECT event_id, ts AS \"timestamp\", user_id, kind, value, k, {', '.join(f'{e} AS {n}' for n, e in FIRST.items())} FROM ev0), "
    f"ev AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in SECOND.items())} FROM ev1)"
)

RANK = "case {c} when 'critical' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end"


def rank(c: str = "severity") -> str:
    return RANK.format(c=c)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Whole table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canon(spark: SparkSession, sf_dir: str, *columns: str, since: Column | None = None) -> DataFrame:
    """Canonical security events of the whole events table, or those from an instant on.

    Named columns are computed once, for rules that look at them many times; without names the view
    stays open to pruning and filters.
    """
    e = table(spark, sf_dir, "events")
    if since is not None:
        e = e.filter(F.col("ts") >= before(e, "ts", since))
    e = e.selectExpr("event_id", "cast(ts as timestamp) as timestamp", "user_id", "event_type as kind", "value", f"{K} as k")
    e = e.selectExpr("*", *[f"{x} as {n}" for n, x in FIRST.items() if n != "event_type"], f"{FIRST['event_type']} as event_type")
    e = e.selectExpr("*", *[f"{x} as {n}" for n, x in SECOND.items()], "map('category', category) as metadata")
    return once(e.select(*columns)) if columns else e


#: columns the analyses read
FLOW = ("event_id", "timestamp", "source_ip", "destination_ip", "destination_port", "protocol", "user_agent", "domain", "dns_query", "bytes_out")
PAIRS = ("event_id", "timestamp", "source_ip", "destination_ip", "destination_port", "bytes_out")
LOGS = ("event_id", "timestamp", "source_ip", "username", "event_type", "status", "action", "message", "windows_id")
RULES = ("event_id", "timestamp", "source", "source_type", "event_type", "status", "action", "protocol", "source_ip", "destination_ip", "username", "hostname", "domain", "url", "hash", "raw_data", "metadata")


def flat(df: DataFrame) -> DataFrame:
    """Plain comparable columns: whole numbers as bigint, instants as microseconds, fractions rounded, text lists joined."""
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(t, T.TimestampNTZType):
            c = F.unix_micros(c.cast("timestamp"))
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(t, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",") if not isinstance(t.elementType, T.StructType) else F.to_json(c)
        elif isinstance(t, T.MapType):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a job under a name, with its SQL counterpart when there is one."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: flat(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add
