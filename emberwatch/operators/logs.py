"""Log analytics on event time (LOG-01 … LOG-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.severity import severity_rank
from ..plans.blocked import sliding_sums
from ..session import cut_lineage

# What marks a failed sign-in.
AUTH_FAILURE_TYPES = ("auth_failed", "login_failed", "authentication_failure")
AUTH_FAILURE_STATUS = ("failure", "failed", "denied")
AUTH_FAILURE_ACTIONS = ("denied", "blocked")
AUTH_FAILURE_WINDOWS_IDS = ("4625", "4771", "4776")
AUTH_FAILURE_PATTERNS = (
    r"(?i)failed\s+password\s+for\s+(?:invalid\s+user\s+)?(\S+)\s+from\s+(\S+)",
    r"(?i)authentication\s+failure.*user=(\S+).*rhost=(\S+)",
    r"(?i)pam_unix.*authentication\s+failure",
    r"(?i)an\s+account\s+failed\s+to\s+log\s+on",
    r"(?i)logon\s+failure.*user.*(\S+)",
    r"(?i)(failed|invalid|bad)\s+(login|auth|password|credential)",
    r"(?i)access\s+denied",
)

# What marks a rise of privileges.
PRIVILEGE_TYPES = ("privilege_escalation", "sudo_command", "su_command")
PRIVILEGE_WINDOWS_IDS = ("4672", "4728", "4732", "4756")
PRIVILEGE_PATTERNS = (
    r"(?i)sudo.*command=",
    r"(?i)su\s*:\s*\S+\s+to\s+root",
    r"(?i)privilege\s+escalation",
    r"(?i)user\s+added\s+to\s+.*admin",
    r"(?i)security\s+group.*administrator",
)

# Assumed usual counts per window and the deviation that counts as full anomaly.
BASELINE_REQUESTS, BASELINE_FAILURES, ANOMALY_DEVIATION = 10.0, 1.0, 3.0

# Sign-in related words for the off-hours test.
AUTH_WORDS = ("auth", "login", "session")


def _absent(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def log_view(events: DataFrame) -> DataFrame:
    """Add ``message`` and ``windows_id`` from the raw payload where the frame has none."""
    cols = events.columns
    payload = X.json_object("raw_data") if "raw_data" in cols else F.lit(None)
    if "message" not in cols:
        message = F.when(payload.isNotNull(), F.coalesce(X.literal_key(payload, "message"), F.lit(""))).otherwise(F.col("raw_data"))
        events = events.withColumn("message", message)
    if "windows_id" not in cols:
        events = events.withColumn("windows_id", F.coalesce(X.literal_key(payload, "EventID"), X.literal_key(payload, "event_id")))
    return events


def _any_pattern(c: str, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.col(c).rlike(p)
    return out


def is_auth_failure() -> Column:
    """Sign-in failure test; cheap tests stand before the text patterns."""
    test = (
        F.col("event_type").isin(*AUTH_FAILURE_TYPES) | F.col("status").isin(*AUTH_FAILURE_STATUS)
        | F.col("action").isin(*AUTH_FAILURE_ACTIONS) | F.col("windows_id").isin(*AUTH_FAILURE_WINDOWS_IDS)
        | _any_pattern("message", AUTH_FAILURE_PATTERNS)
    )
    return F.coalesce(test, F.lit(False))


def is_privilege_event() -> Column:
    test = (
        F.col("event_type").isin(*PRIVILEGE_TYPES) | F.col("windows_id").isin(*PRIVILEGE_WINDOWS_IDS)
        | _any_pattern("message", PRIVILEGE_PATTERNS)
    )
    return F.coalesce(test, F.lit(False))


def tracking_key() -> Column:
    return F.coalesce(_absent(F.col("source_ip")), _absent(F.col("username")), F.lit("unknown"))


def _finding(df: DataFrame, kind: str, detection: str, severity: str, confidence: str, rule: str, source: Column,
             explanation: Column, techniques: tuple, tactics: tuple, start: Column, end: Column, actual: Column, threshold: Column) -> DataFrame:
    listed = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return df.select(
        F.concat(F.lit(kind + "_"), F.col("event_id").cast("string")).alias("finding_id"), F.lit(detection).alias("detection_type"),
        F.lit({"brute_force": "brute_force_indicator", "privilege_escalation": "privilege_escalation_indicator",
               "suspicious_rate": "rate_limit_exceeded", "off_hours_activity": "off_hours_activity", "anomaly": "anomaly_detected"}[detection]).alias("finding_type"),
        F.col("event_id").cast("string").alias("event_id"), F.col("timestamp"),
        F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), source.alias("source"), F.lit(rule).alias("rule_id"),
        start.cast("timestamp").alias("time_range_start"), end.cast("timestamp").alias("time_range_end"),
        actual.cast("double").alias("actual"), threshold.cast("double").alias("threshold"), explanation.alias("explanation"),
        listed(techniques).alias("mitre_techniques"), listed(tactics).alias("mitre_tactics"),
    )


def brute_force(events: DataFrame, threshold: int = 5, window_sec: int = 60) -> DataFrame:
    """One finding per failed sign-in at which its key has ``threshold`` or more in the window."""
    failures = log_view(events).filter(is_auth_failure()).select("event_id", "timestamp", "source_ip", "username").withColumn("tracking_key", tracking_key())
    hits = sliding_sums(cut_lineage(failures), ["tracking_key"], "timestamp", window_sec, {"failures": F.lit(1)},
                        where=F.col("failures") >= threshold, first="first_at")
    text = F.format_string(f"Detected %d auth failures from %s in {window_sec}s", F.col("failures"), F.col("tracking_key"))
    return _finding(hits, "bf", "brute_force", "high", "high", "brute_force_detector", F.coalesce("source_ip", F.lit("")), text,
                    ("T1110", "T1110.001"), ("credential-access",), F.col("first_at"), F.col("timestamp"), F.col("failures"), F.lit(threshold))


def privilege_escalation(events: DataFrame) -> DataFrame:
    hits = log_view(events).filter(is_privilege_event())
    none = F.lit(None)
    return _finding(hits, "priv", "privilege_escalation", "medium", "medium", "privilege_escalation_detector",
                    F.coalesce(_absent(F.col("source_ip")), "username", F.lit("")), F.lit("Detected privilege escalation activity"),
                    ("T1548", "T1068"), ("privilege-escalation",), none, none, none, none)


def request_rate(events: DataFrame, threshold: int = 100, window_sec: int = 60) -> DataFrame:
    rows = events.filter(F.col("source_ip") != "").select("event_id", "timestamp", "source_ip")
    hits = sliding_sums(rows, ["source_ip"], "timestamp", window_sec, {"requests": F.lit(1)}, where=F.col("requests") >= threshold, first="first_at")
    text = F.format_string(f"Source %s exceeded rate limit: %d requests in {window_sec}s", F.col("source_ip"), F.col("requests"))
    return _finding(hits, "rate", "suspicious_rate", "medium", "high", "rate_limit_detector", F.col("source_ip"), text,
                    ("T1498",), ("impact",), F.col("first_at"), F.col("timestamp"), F.col("requests"), F.lit(threshold))


def off_hours(events: DataFrame, start_hour: int = 8, end_hour: int = 18) -> DataFrame:
    related = F.lit(False)
    for word in AUTH_WORDS:
        related = related | F.col("event_type").contains(word)
    hour = F.hour("timestamp")
    hits = events.filter(related & ~((hour >= start_hour) & (hour < end_hour)))
    text = F.format_string(f"Auth activity at %02d:00 (outside business hours {start_hour}:00-{end_hour}:00)", hour)
    none = F.lit(None)
    return _finding(hits, "offhours", "off_hours_activity", "low", "medium", "off_hours_detector",
                    F.coalesce(_absent(F.col("source_ip")), "username", F.lit("")), text, (), (), none, none, hour, none)


def anomaly_scores(events: DataFrame, window_sec: int = 60) -> DataFrame:
    """Score per event from its request and failure counts within the window.

    Both counts share one pass: the failure count is taken over the same key as the request count.
    """
    rows = log_view(events).select("event_id", "timestamp", "source_ip", "username", is_auth_failure().alias("_failed"))
    rows = rows.withColumn("tracking_key", F.coalesce(_absent(F.col("source_ip")), _absent(F.col("username"))))
    rows = sliding_sums(cut_lineage(rows.filter(F.col("tracking_key").isNotNull())), ["tracking_key"], "timestamp", window_sec,
                        {"requests": F.lit(1), "failures": F.col("_failed").cast("int")})
    part = lambda value, base: F.least(F.abs(value - base) / base / ANOMALY_DEVIATION, F.lit(1.0))
    by_rate = F.when(_absent(F.col("source_ip")).isNotNull(), part(F.col("requests"), BASELINE_REQUESTS))
    by_failures = F.when(F.col("failures") > 0, part(F.col("failures"), BASELINE_FAILURES))
    count = by_rate.isNotNull().cast("int") + by_failures.isNotNull().cast("int")
    score = F.when(count > 0, (F.coalesce(by_rate, F.lit(0.0)) + F.coalesce(by_failures, F.lit(0.0))) / count)
    return rows.select("event_id", "timestamp", "source_ip", "tracking_key", "requests", "failures", score.alias("anomaly_score")).withColumn(
        "is_anomaly", F.coalesce(F.col("anomaly_score") >= 1.0 / ANOMALY_DEVIATION, F.lit(False))
    )


def anomalies(events: DataFrame, window_sec: int = 60) -> DataFrame:
    hits = anomaly_scores(events, window_sec).filter("is_anomaly")
    none = F.lit(None)
    return _finding(hits, "anomaly", "anomaly", "medium", "medium", "anomaly_detector", F.coalesce("source_ip", F.lit("")),
                    F.format_string("Anomaly detected with score %.2f", F.col("anomaly_score")), (), (), none, none, F.col("anomaly_score"), none)


def log_findings(events: DataFrame) -> DataFrame:
    """All log detections as one table."""
    out = brute_force(events)
    for job in (privilege_escalation, request_rate, off_hours, anomalies):
        out = out.unionByName(job(events))
    return out


# Order in which the detections of one event are listed.
DETECTION_POSITION = ("brute_force", "privilege_escalation", "suspicious_rate", "off_hours_activity", "anomaly")


def primary_findings(findings: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Most severe finding per batch, ties by time and check order.

    The kinds per batch are five at most, so the set stays small; the matched events are counted
    here and listed by :func:`matched_events`.
    """
    position = F.array_position(F.array(*[F.lit(d) for d in DETECTION_POSITION]), F.col("detection_type"))
    rank = F.struct(-severity_rank("severity"), F.col("timestamp"), F.col("event_id"), position)
    row = F.struct("finding_id", "finding_type", "detection_type", "severity", "event_id", "source", "explanation")
    grouped = findings.groupBy(batch).agg(
        F.min_by(row, rank).alias("p"), F.array_sort(F.collect_set("detection_type")).alias("detection_types"),
        F.count(F.lit(1)).alias("finding_count"),
    )
    several = F.concat(F.lit("Multiple detections: "), F.array_join("detection_types", ", "), F.lit(". "), F.col("p.explanation"))
    return grouped.select(
        batch, "p.finding_id", "p.finding_type", "p.detection_type", "p.severity", "p.event_id", "p.source",
        F.when(F.col("finding_count") > 1, several).otherwise(F.col("p.explanation")).alias("explanation"),
        "detection_types", "finding_count",
    )


def matched_events(findings: DataFrame, batch: str = "batch_id") -> DataFrame:
    return findings.select(batch, "event_id").distinct()
