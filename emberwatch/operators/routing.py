"""Routing of events and findings, task log (RTE-01 … RTE-04, TSK-01, TSK-02, EXT-03)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import lookup
from .changelog import current_state, page


@dataclass
class Route:
    name: str
    domain: str
    priority: int
    source_types: tuple = ()
    event_types: tuple = ()
    required_fields: tuple = ()
    condition: object = None  # () -> Column


def _meta_has(*keys: str) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.map_contains_key("metadata", k)
    return out


def _cidr_context() -> Column:
    return _meta_has("cidr", "ip_range") | F.col("event_type").isin("cidr_request", "network_scan")


def _ioc_context() -> Column:
    return _meta_has("ioc_type", "threat_indicator", "matched_ioc") | F.col("hash").isNotNull()


def _correlation_context() -> Column:
    many = F.coalesce(F.try_element_at("metadata", F.lit("finding_count")).try_cast("int"), F.lit(0)) > 1
    return _meta_has("related_events", "correlation_id") | many


def _severe() -> Column:
    return F.col("severity").isin("high", "critical")


# Default routes.
DEFAULT_ROUTES = (
    Route("email_events", "email_verification", 100, ("email", "email_gateway", "email_security"),
          ("email_received", "email_scan", "phishing_alert", "spam_detected", "email_security_event")),
    Route("network_ids", "network_threat", 95, ("suricata", "ids", "nids", "network_security"),
          ("alert", "ids_alert", "intrusion_detected", "network_anomaly", "port_scan", "c2_communication")),
    Route("ioc_match", "threat_intelligence", 92, (),
          ("ioc_match", "threat_indicator", "malware_detected", "hash_match", "domain_blocklist_hit", "ip_blocklist_hit"), (), _ioc_context),
    Route("auth_logs", "log_analyzer", 90, ("authentication", "syslog", "windows_security"),
          ("auth_failed", "auth_success", "login_attempt", "logout", "session_created", "session_terminated", "privilege_escalation", "sudo_command", "account_lockout")),
    Route("vulnerability", "vulnerability", 85, ("vulnerability_scanner", "cve_feed", "nessus", "qualys"),
          ("vulnerability_found", "cve_detected", "vulnerability_scan_result", "security_advisory")),
    Route("ip_analysis", "ip_range_analyzer", 70, (), ("cidr_request", "ip_analysis_request", "network_scan"), ("source_ip",), _cidr_context),
    Route("correlation", "correlation", 60, (), ("correlated_events", "attack_chain", "multi_stage_attack"), (), _correlation_context),
    Route("investigation", "investigation", 50, (), ("incident_created", "high_severity_alert", "confirmed_breach", "data_exfiltration"), (), _severe),
    Route("application_logs", "log_analyzer", 40, ("application", "json"), ("error", "warning", "access_log", "application_event")),
)
SOURCE_DEFAULTS = {
    "email": "email_verification", "authentication": "log_analyzer", "syslog": "log_analyzer", "suricata": "network_threat",
    "application": "log_analyzer", "json": "log_analyzer",
}

# Finding type words → domain, first one wins.
FINDING_DOMAINS = (
    ("sql_injection", "log_analyzer"), ("xss", "log_analyzer"), ("brute_force", "log_analyzer"), ("malicious_ip", "threat_intelligence"),
    ("malicious_domain", "threat_intelligence"), ("malicious_hash", "threat_intelligence"), ("ioc_match", "threat_intelligence"),
    ("network_alert", "network_threat"), ("ids_alert", "network_threat"), ("vulnerability", "vulnerability"), ("phishing", "email_verification"),
    ("email", "email_verification"),
)

# Event types whose priority is raised one step.
BOOSTED = ("malware_detected", "data_exfiltration", "confirmed_breach", "ransomware", "c2_communication")
MAX_RETRIES = 3


def route_test(route: Route, columns: list[str]) -> Column:
    out = F.lit(True)
    if route.source_types:
        out = out & F.col("source_type").isin(*route.source_types)
    if route.event_types:
        out = out & F.col("event_type").isin(*route.event_types)
    for name in route.required_fields:
        here = F.map_contains_key("metadata", name)
        out = out & (F.col(name).isNotNull() | here if name in columns else here)
    if route.condition is not None:
        out = out & route.condition()
    return F.coalesce(out, F.lit(False))


def route_events(events: DataFrame, routes: tuple = DEFAULT_ROUTES) -> DataFrame:
    """Adds domain, route_name and routing_error; higher priority first, then the default of the source."""
    ordered = sorted(routes, key=lambda r: -r.priority)
    name, domain = F.when(F.lit(False), F.lit(None).cast("string")), F.when(F.lit(False), F.lit(None).cast("string"))
    for r in ordered:
        name = name.when(route_test(r, events.columns), r.name)
    routed = events.withColumn("route_name", name)
    for r in ordered:
        domain = domain.when(F.col("route_name") == r.name, r.domain)
    domain = F.coalesce(domain, lookup("source_type", SOURCE_DEFAULTS))
    routed = routed.withColumn("domain_agent", domain)
    return routed.withColumn("routing_error", F.when(F.col("domain_agent").isNull(), F.concat(F.lit("No routing rule matches event "), F.col("event_id").cast("string"))))


def finding_domain(finding_type: Column, match_count: Column) -> Column:
    text = F.lower(F.coalesce(finding_type, F.lit("")))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for word, domain in FINDING_DOMAINS:
        out = out.when(text.contains(word), domain)
    return out.when(match_count > 1, "correlation").otherwise("log_analyzer")


def task_priority() -> Column:
    base = lookup("severity", {"critical": "critical", "high": "high", "medium": "medium", "low": "low", "informational": "low"}, "medium")
    boosted = F.col("event_type").isin(*BOOSTED)
    return F.when(boosted & (base == "medium"), "high").when(boosted & (base == "low"), "medium").otherwise(base)


def make_tasks(events: DataFrame, routes: tuple = DEFAULT_ROUTES) -> DataFrame:
    """One queued task per routed event, with its domain and priority as headers."""
    routed = route_events(events, routes).filter(F.col("domain_agent").isNotNull())
    return routed.select(
        F.concat(F.lit("task_"), F.col("event_id").cast("string")).alias("task_id"), F.col("event_id").cast("string").alias("event_id"), F.col("domain_agent").alias("agent_type"),
        task_priority().alias("priority"), F.lit("queued").alias("status"), F.lit(0).alias("retry_count"), F.col("timestamp").alias("created_at"),
        F.lit(None).cast("string").alias("error"))


def routing_errors(events: DataFrame, routes: tuple = DEFAULT_ROUTES) -> DataFrame:
    return route_events(events, routes).filter(F.col("routing_error").isNotNull()).select("event_id", "source_type", "event_type", "routing_error")


def task_state(tasks: DataFrame, log: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Tasks after their log (task_id, status, changed_at, error).

    Failures beyond the allowed retries put a task into the dead letters; below, it is retried.
    """
    per = log.groupBy("task_id").agg(
        F.count_if(F.col("status") == "failed").alias("failures"), F.min(F.when(F.col("status") == "running", F.col("changed_at"))).alias("started_at"),
        F.max(F.when(F.col("status").isin("completed", "failed", "dead_letter"), F.col("changed_at"))).alias("completed_at"))
    cols = [c for c in ("status", "error") if c in log.columns]
    out = current_state(tasks, log, "task_id", cols).join(per, "task_id", "left").fillna(0, ["failures"])
    failed = F.col("status") == "failed"
    return out.withColumns({
        "retry_count": F.least("failures", F.lit(max_retries)).cast("int"),
        "status": F.when(failed & (F.col("failures") > max_retries), "dead_letter").when(failed, "retrying").otherwise(F.col("status"))}).drop("failures")


def tasks_to_retry(state: DataFrame) -> DataFrame:
    return state.filter(F.col("status") == "retrying")


def tasks_by_status(state: DataFrame, agent_type: str, status: str, limit: int | None = None) -> DataFrame:
    return page(state, [F.col("created_at"), F.col("task_id")], limit, agent_type=agent_type, status=status)


def task_metrics(state: DataFrame) -> DataFrame:
    done = F.col("status") == "completed"
    latency = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1000.0
    return state.agg(
        F.count(F.lit(1)).alias("tasks_created"), F.count_if(done).alias("tasks_completed"), F.count_if(F.col("status").isin("dead_letter", "retrying")).alias("tasks_failed"),
        F.coalesce(F.sum(F.when(done, latency)) / F.nullif(F.count_if(done), F.lit(0)), F.lit(0.0)).alias("avg_latency_ms"))


def purge_completed(state: DataFrame, as_of: Column, older_than_sec: int = 3600) -> DataFrame:
    """State without the completed tasks older than the limit."""
    old = (F.col("status") == "completed") & (F.unix_micros(as_of) - F.unix_micros("completed_at") > older_than_sec * 1_000_000)
    return state.filter(~F.coalesce(old, F.lit(False)))
