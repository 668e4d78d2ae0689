"""Investigations, timelines and evidence (INV-01 … INV-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.severity import LEVELS, severity_rank
from .changelog import counts_by, current_state, page

# Word in an event type → kind of evidence, first one wins.
EVIDENCE_WORDS = (
    (("network", "flow"), "network_flow"), (("process",), "process_info"), (("file",), "file_artifact"), (("registry",), "registry_key"),
    (("user", "auth"), "user_activity"), (("alert",), "alert"),
)
# Word in an event type → attack vector, first one wins.
VECTORS = (
    ("phishing", "Email phishing"), ("brute", "Brute force authentication"), ("exploit", "Vulnerability exploitation"),
    ("lateral", "Lateral movement from compromised host"),
)
# Prefixes of addresses of higher criticality.
HIGH_VALUE_PREFIXES = ("10.0.0.", "192.168.1.")

# Investigation templates.
TEMPLATES = {
    "phishing": ("Phishing Investigation", (
        "Identify all recipients of the phishing email", "Check if any users clicked malicious links", "Review credential usage for affected users",
        "Scan endpoints for malware indicators", "Block sender and malicious URLs", "Reset credentials if compromise suspected"), (
        "Credentials were harvested via fake login page", "Malware was delivered via attachment", "No users interacted with the phishing email")),
    "brute_force": ("Brute Force Attack Investigation", (
        "Identify source IPs of authentication attempts", "Check for successful authentications from those IPs",
        "Review targeted accounts for signs of compromise", "Analyze timing patterns and automation indicators", "Block attacking IPs at perimeter",
        "Enforce password reset for targeted accounts"), (
        "Attack was automated credential stuffing", "Attacker gained access to one or more accounts", "Attack was unsuccessful and contained")),
    "data_exfiltration": ("Data Exfiltration Investigation", (
        "Identify unusual outbound data transfers", "Map source systems and user accounts involved", "Categorize types of data potentially exposed",
        "Review access logs for unauthorized access", "Check for C2 communication patterns", "Assess regulatory notification requirements"), (
        "Insider threat exfiltrated sensitive data", "Malware established C2 and exfiltrated data", "Legitimate business activity misclassified")),
    "ransomware": ("Ransomware Investigation", (
        "Isolate affected systems immediately", "Identify ransomware variant and IoCs", "Determine initial access vector",
        "Map lateral movement and impact scope", "Check for data exfiltration before encryption", "Assess backup availability and integrity"), (
        "Initial access via phishing email", "Initial access via exposed RDP/VPN", "Initial access via supply chain compromise")),
}

KEY = "investigation_id"


def evidence_type(c: Column | str) -> Column:
    text = F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for words, kind in EVIDENCE_WORDS:
        for w in words:
            out = out.when(text.contains(w), kind)
    return out.otherwise("log_entry")


def _filled(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def describe_event() -> Column:
    source = F.coalesce(_filled("source_ip"), _filled("source"), F.lit("unknown"))
    return F.concat_ws(" ", F.coalesce("event_type", F.lit("Unknown event")), F.concat(F.lit("from "), source),
                       F.concat(F.lit("to "), _filled("destination_ip")), F.concat(F.lit("by user "), _filled("username")))


def _level(c: str = "severity") -> Column:
    return F.when(F.lower(c).isin(*LEVELS), F.lower(c)).otherwise("medium")


def timeline_rows(events: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Events and findings of each investigation in one form, not yet ordered."""
    rows = events.select(
        KEY, "timestamp", F.col("event_id").cast("string").alias("event_id"), F.coalesce("event_type", F.lit("unknown")).alias("event_type"), describe_event().alias("description"),
        F.coalesce(_filled("source"), _filled("source_ip"), F.lit("")).alias("source"), F.coalesce(_filled("username"), F.lit("")).alias("actor"),
        F.coalesce(_filled("destination_ip"), _filled("hostname"), F.lit("")).alias("target"), evidence_type("event_type").alias("evidence_type"), _level().alias("severity"))
    if findings is None:
        return rows
    return rows.unionByName(findings.select(
        KEY, "timestamp", F.col("finding_id").cast("string").alias("event_id"), F.coalesce("finding_type", F.lit("finding")).alias("event_type"),
        F.coalesce("explanation", F.lit("Finding detected")).alias("description"), F.lit("detection").alias("source"), F.lit("").alias("actor"), F.lit("").alias("target"),
        F.lit("finding").alias("evidence_type"), _level().alias("severity")))


def forensic_timeline(events: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    return timeline_rows(events, findings).orderBy(KEY, "timestamp", "event_id")


def evidence_rows(events: DataFrame, findings: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if as_of is None else as_of
    rows = timeline_rows(events, findings)
    return rows.select(
        KEY, F.concat(F.lit("ev_"), F.substring(F.sha2(F.concat_ws("|", KEY, "evidence_type", "event_id"), 256), 1, 12)).alias("evidence_id"), "evidence_type",
        F.when(F.col("source") == "", "unknown").otherwise(F.col("source")).alias("source"), now.alias("collected_at"), "description", F.col("event_id").alias("related_event"))


def affected_assets(events: DataFrame) -> DataFrame:
    """Hosts and users per investigation with first and last sighting.

    The first mention gives role text; the last sighting is that of a later host row, so it stays
    null for what is seen once and for users.
    """
    item = lambda role, col, kind: F.when(_filled(col).isNotNull(), F.struct(F.lit(role).alias("role"), F.lit(kind).alias("asset_type"), F.col(col).alias("name")))
    rows = events.select(KEY, "timestamp", F.col("event_id"), F.explode(F.filter(F.array(
        item(0, "source_ip", "host"), item(1, "destination_ip", "host"), item(2, "username", "user")), lambda x: x.isNotNull())).alias("a")).select(KEY, "timestamp", "event_id", "a.*")
    order = F.struct("timestamp", "event_id", "role")
    host = F.col("asset_type") == "host"
    grouped = rows.groupBy(KEY, "name").agg(
        F.min_by(F.struct("role", "asset_type"), order).alias("f"), F.min("timestamp").alias("first_seen"), F.max_by("timestamp", F.when(host, order)).alias("_last"),
        F.count(F.lit(1)).alias("_n"), F.count_if(host).alias("_hosts"))
    seen_again = F.col("_hosts") - F.when(F.col("f.asset_type") == "host", 1).otherwise(0) > 0
    user = F.col("f.asset_type") == "user"
    high = F.lit(False)
    for p in HIGH_VALUE_PREFIXES:
        high = high | F.col("name").startswith(p)
    impact = F.when(user, "User account involved in activity").when(F.col("f.role") == 0, "Source of suspicious activity").otherwise("Target of suspicious activity")
    return grouped.select(
        KEY, F.when(user, F.concat(F.lit("asset_user_"), F.col("name"))).otherwise(F.concat(F.lit("asset_"), F.replace("name", F.lit("."), F.lit("_")))).alias("asset_id"),
        F.col("f.asset_type").alias("asset_type"), "name", F.when(~user & high, "high").otherwise("medium").alias("criticality"), impact.alias("impact"), "first_seen",
        F.when(seen_again, F.col("_last")).alias("last_seen"), F.col("_n").alias("mentions"))


def investigation_summary(events: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Vector, hypothesis, scope, severity and span per investigation."""
    rows = timeline_rows(events, findings)
    word = lambda w: F.max(F.lower("event_type").contains(w).cast("int"))
    actors = rows.filter(F.col("actor") != "").select(KEY, "actor").distinct().groupBy(KEY).agg(F.count(F.lit(1)).alias("user_count"))
    base = rows.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("event_count"), F.count_if(F.col("severity").isin("high", "critical")).alias("high_count"), F.count_if(F.col("severity") == "high").alias("_high"),
        F.max(severity_rank("severity")).alias("_rank"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"),
        *[word(w).alias(f"_w{i}") for i, (w, _) in enumerate(VECTORS)])
    assets = affected_assets(events).groupBy(KEY).agg(F.count(F.lit(1)).alias("asset_count"), F.count_if(F.col("criticality") == "critical").alias("_crit"))
    df = base.join(assets, KEY, "left").join(actors, KEY, "left").fillna(0, ["asset_count", "_crit", "user_count"])
    vector = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, (_, text) in enumerate(VECTORS):
        vector = vector.when(F.col(f"_w{i}") == 1, text)
    df = df.withColumn("attack_vector", vector.otherwise("Under investigation"))
    hypothesis = F.when(F.col("high_count") > 3, F.format_string(
        "Active security incident detected with %d high-severity events. Attack vector appears to be %s.", F.col("high_count"), F.lower("attack_vector"))).otherwise(F.format_string(
        "Suspicious activity detected involving %d assets. Further investigation recommended.", F.col("asset_count")))
    scope = F.format_string("Incident scope: %d assets, %d users, spanning %d events", F.col("asset_count"), F.col("user_count"), F.col("event_count"))
    severity = (
        F.when(F.col("_rank") >= 4, "critical").when((F.col("_high") > 3) | (F.col("_crit") > 0), "high")
        .when((F.col("_high") > 0) | (F.col("asset_count") > 5), "medium").otherwise("low"))
    span = (F.unix_micros("end_time") - F.unix_micros("start_time")) / 3.6e9
    return df.select(KEY, "event_count", "asset_count", "user_count", F.col("high_count").alias("high_severity_events"), "attack_vector", hypothesis.alias("hypothesis"),
                     scope.alias("scope_assessment"), severity.alias("severity"), span.alias("time_span_hours"), "start_time", "end_time")


def template_steps(spark: SparkSession) -> DataFrame:
    rows = [(k, t, i, s, f"Standard step for {k} investigation") for k, (t, steps, _) in TEMPLATES.items() for i, s in enumerate(steps, 1)]
    return spark.createDataFrame(rows, "template string, title string, step_number int, action string, reasoning string")


def template_hypotheses(spark: SparkSession) -> DataFrame:
    rows = [(k, i, h) for k, (_, _, hyps) in TEMPLATES.items() for i, h in enumerate(hyps, 1)]
    return spark.createDataFrame(rows, "template string, position int, statement string")


def open_steps(investigations: DataFrame) -> DataFrame:
    """Steps of each investigation from its template; the template table is fixed and tiny."""
    steps = F.broadcast(template_steps(investigations.sparkSession))
    return investigations.join(steps.drop("title"), "template").select(
        KEY, F.concat_ws("_", F.lit("step"), F.col(KEY).cast("string"), F.col("step_number").cast("string")).alias("step_id"), "step_number", "action", "reasoning", F.lit("pending").alias("status"))


def open_hypotheses(investigations: DataFrame) -> DataFrame:
    hyps = F.broadcast(template_hypotheses(investigations.sparkSession))
    return investigations.join(hyps, "template").select(
        KEY, F.concat_ws("_", F.lit("hyp"), F.col(KEY).cast("string"), F.col("position").cast("string")).alias("hypothesis_id"), "statement", F.lit("proposed").alias("status"), F.lit(0.0).alias("confidence"))


def step_state(steps: DataFrame, changes: DataFrame) -> DataFrame:
    return current_state(steps, changes, "step_id", [c for c in ("status", "findings") if c in changes.columns])


def hypothesis_state(hypotheses: DataFrame, changes: DataFrame) -> DataFrame:
    return current_state(hypotheses, changes, "hypothesis_id", [c for c in ("status", "confidence", "reasoning") if c in changes.columns])


def evidence_timeline(evidence: DataFrame) -> DataFrame:
    """Evidence in time order with a summary (``content`` is a string map)."""
    get = lambda k, d: F.coalesce(F.try_element_at("content", F.lit(k)), F.lit(d))
    kind = F.col("evidence_type")
    summary = (
        F.when(kind == "log_entry", get("message", "Log entry")).when(kind == "alert", get("alert_name", "Security alert"))
        .when(kind == "network_flow", F.concat(F.lit("Network flow "), get("source_ip", "?"), F.lit(" → "), get("dest_ip", "?")))
        .when(kind == "threat_intel", get("indicator", "Threat intel match")).otherwise(F.concat(kind, F.lit(" evidence"))))
    return evidence.select(KEY, "timestamp", kind.alias("type"), "source", summary.alias("summary"), "evidence_id").orderBy(KEY, "timestamp", "evidence_id")


def analysis(investigations: DataFrame, evidence: DataFrame, hypotheses: DataFrame, steps: DataFrame) -> DataFrame:
    """Counts and progress per investigation."""
    n = F.count(F.lit(1))
    ev = evidence.groupBy(KEY).agg(n.alias("evidence_count"))
    hy = hypotheses.groupBy(KEY).agg(n.alias("hypothesis_count"), F.count_if(F.col("status") == "supported").alias("supported_hypotheses"),
                                     F.count_if(F.col("status") == "refuted").alias("refuted_hypotheses"))
    st = steps.groupBy(KEY).agg(n.alias("steps_total"), F.count_if(F.col("status") == "completed").alias("steps_completed"))
    df = investigations.join(ev, KEY, "left").join(hy, KEY, "left").join(st, KEY, "left")
    df = df.fillna(0, ["evidence_count", "hypothesis_count", "supported_hypotheses", "refuted_hypotheses", "steps_total", "steps_completed"])
    share = F.coalesce(F.try_divide(F.col("steps_completed").cast("double"), F.col("steps_total").cast("double")), F.lit(0.0))
    return df.withColumn("progress_pct", F.bround(share * 100, 1))


def evidence_by_type(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy(KEY, "evidence_type").agg(F.count(F.lit(1)).alias("n"))


def list_investigations(investigations: DataFrame, status=None, priority=None, limit: int | None = None, offset: int = 0) -> DataFrame:
    return page(investigations, [F.col("created_at").desc(), F.col(KEY)], limit, offset, status=status, priority=priority)


def investigation_counts(investigations: DataFrame) -> DataFrame:
    return counts_by(investigations, "status", "priority")
