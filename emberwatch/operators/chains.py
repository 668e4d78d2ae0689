"""Entity correlation and kill-chain progress (COR-09 … COR-17)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import LEVELS, as_col, severity_rank
from ..plans.bounds import before

# Attack stages in order.
STAGES = (
    "reconnaissance", "initial_access", "execution", "persistence", "privilege_escalation", "defense_evasion", "credential_access",
    "discovery", "lateral_movement", "collection", "command_and_control", "exfiltration", "impact",
)

# Word in an event type → stage, first word wins.
STAGE_WORDS = (
    ("port_scan", "reconnaissance"), ("network_scan", "reconnaissance"), ("dns_query", "reconnaissance"), ("service_discovery", "reconnaissance"),
    ("phishing", "initial_access"), ("exploit_attempt", "initial_access"), ("brute_force", "initial_access"), ("auth_success_after_failures", "initial_access"),
    ("process_creation", "execution"), ("script_execution", "execution"), ("command_execution", "execution"),
    ("scheduled_task", "persistence"), ("registry_modification", "persistence"), ("service_installation", "persistence"),
    ("privilege_escalation", "privilege_escalation"), ("sudo_command", "privilege_escalation"), ("admin_login", "privilege_escalation"),
    ("credential_dump", "credential_access"), ("password_spray", "credential_access"), ("kerberoasting", "credential_access"),
    ("ad_enumeration", "discovery"), ("file_enumeration", "discovery"), ("network_enumeration", "discovery"),
    ("lateral_movement", "lateral_movement"), ("rdp_connection", "lateral_movement"), ("smb_connection", "lateral_movement"), ("ssh_connection", "lateral_movement"),
    ("c2_communication", "command_and_control"), ("beaconing", "command_and_control"), ("dns_tunneling", "command_and_control"),
    ("data_exfiltration", "exfiltration"), ("large_upload", "exfiltration"), ("dns_exfil", "exfiltration"),
    ("ransomware", "impact"), ("data_destruction", "impact"), ("service_disruption", "impact"),
)

# Thresholds.
ENTITY_EVENTS, ENTITY_WINDOW_SEC, CHAIN_STAGES = 5, 3600, 3


def attack_stage(c: Column | str) -> Column:
    text = F.lower(as_col(c))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for word, stage in STAGE_WORDS:
        out = out.when(text.contains(word), stage)
    return out


def stage_order(stage: Column | str) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), as_col(stage)).cast("int") - 1


def correlation_severity(top_rank: Column, count: Column) -> Column:
    return F.when(top_rank >= 4, "critical").when(top_rank == 3, "high").when(count > 10, "high").when(count > 5, "medium").otherwise("low")


def findings_as_events(findings: DataFrame) -> DataFrame:
    """Findings in event form; a severity outside the five levels counts as medium."""
    sev = F.lower("severity")
    return findings.select(
        "event_id", F.coalesce("finding_type", F.lit("unknown")).alias("event_type"), "timestamp", "source_ip", "destination_ip", "username",
        F.when(sev.isin(*LEVELS), sev).otherwise("medium").alias("severity"), "finding_id")


def _recent(events: DataFrame, as_of: Column, window_sec: int) -> DataFrame:
    return events.filter(F.col("timestamp") >= before(events, "timestamp", as_of, window_sec))


def entity_correlation(events: DataFrame, kind: str, as_of: Column, threshold: int = ENTITY_EVENTS, window_sec: int = ENTITY_WINDOW_SEC) -> DataFrame:
    """Entities with ``threshold`` or more events in the window before ``as_of``. ``kind``: source, target or user.

    Counts, extremes and the distinct partners are all combined before the shuffle; the distinct
    count runs in two steps so that one busy entity does not gather its partners in one set.
    """
    key, partner = {"source": ("source_ip", "destination_ip"), "target": ("destination_ip", "source_ip"), "user": ("username", None)}[kind]
    rows = _recent(events, as_of, window_sec).filter(F.coalesce(F.col(key), F.lit("")) != "")
    by = [F.col(key).alias("entity"), *([F.nullif(F.col(partner), F.lit("")).alias("partner")] if partner else [F.lit(None).cast("string").alias("partner")])]
    pre = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"), F.max(severity_rank("severity")).alias("rank"))
    out = pre.groupBy("entity").agg(
        F.sum("n").alias("event_count"), F.min("first_at").alias("start_time"), F.max("last_at").alias("end_time"), F.max("rank").alias("rank"),
        F.count("partner").alias("unique_partners")).filter(F.col("event_count") >= threshold)
    technique = {"source": ("T1595",), "target": (), "user": ("T1078",)}[kind]
    tactics = {"source": ("reconnaissance",), "target": (), "user": ("defense-evasion", "persistence")}[kind]
    listed = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    text = {"source": "Correlated %d events from source %s", "target": "Correlated %d events targeting %s", "user": "Correlated %d events for user %s"}[kind]
    return out.select(
        F.concat(F.lit({"source": "corr_src_", "target": "corr_tgt_", "user": "corr_user_"}[kind]), F.col("entity")).alias("finding_id"),
        F.lit({"source": "source_correlation", "target": "target_correlation", "user": "user_correlation"}[kind]).alias("finding_type"),
        F.lit(f"same_{kind}").alias("correlation_type"), "entity", correlation_severity(F.col("rank"), F.col("event_count")).alias("severity"),
        "event_count", "unique_partners", "start_time", "end_time", ((F.unix_micros("end_time") - F.unix_micros("start_time")) / 1e6).alias("time_span_sec"),
        F.format_string(text, F.col("event_count"), F.col("entity")).alias("explanation"), listed(technique).alias("mitre_techniques"), listed(tactics).alias("mitre_tactics"))


def kill_chains(events: DataFrame, keys: list[str] | None = None, min_stages: int = CHAIN_STAGES) -> DataFrame:
    """Progress through the stages per key: a stage is taken when it lies beyond the last one taken.

    The stages taken are the running maxima of the stage order, and a running maximum can only be
    the first event of its stage. So each key is first cut to the earliest event per stage, at most
    thirteen rows, with map-side combining; the running maximum is taken over those.
    """
    keys = keys or []
    staged = events.withColumn("stage", attack_stage("event_type")).filter(F.col("stage").isNotNull())
    own = [c for c in ("source_ip", "destination_ip", "username") if c in events.columns]
    first = staged.groupBy(*keys, "stage").agg(
        F.min_by(F.struct("timestamp", "event_id", *[F.col(c).alias(f"_{c}") for c in own]), F.struct("timestamp", "event_id")).alias("e"),
        F.count(F.lit(1)).alias("n"))
    rows = first.select(*keys, "stage", stage_order("stage").alias("ord"), "e.*", "n")
    item = F.struct("timestamp", "event_id", "ord", "stage", *[f"_{c}" for c in own])
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("s"), F.sum("n").alias("staged_events"))
    s = F.col("s")
    taken = F.filter(s, lambda x, i: ~F.exists(F.slice(s, F.lit(1), i), lambda y: y["ord"] >= x["ord"]))
    out = grouped.filter(F.col("staged_events") >= min_stages).withColumn("t", taken).filter(F.size("t") >= min_stages)
    gather = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform("t", lambda x: x[f"_{c}"]), lambda v: F.coalesce(v, F.lit("")) != "")))
    completeness = F.size("t") / F.lit(float(len(STAGES)))
    start, end = F.get("t", F.lit(0))["timestamp"], F.element_at("t", -1)["timestamp"]
    span = (F.unix_micros(end) - F.unix_micros(start)) / 1e6
    names = {"source_ip": "source_ips", "destination_ip": "target_ips", "username": "users"}
    return out.select(
        *keys, F.concat_ws("_", F.lit("chain"), *keys).alias("chain_id"), F.transform("t", lambda x: x["stage"]).alias("stages"),
        F.transform("t", lambda x: x["event_id"]).alias("event_ids"), start.alias("start_time"), end.alias("end_time"), span.alias("duration_sec"),
        F.size("t").alias("stage_count"), completeness.alias("completeness"), *[gather(c).alias(names[c]) for c in own])


def chain_findings(chains: DataFrame) -> DataFrame:
    text = F.format_string("Attack chain detected: %d stages over %.0fs (%.0f%% complete)", F.col("stage_count"), F.col("duration_sec"), F.col("completeness") * 100)
    return chains.select(
        F.concat(F.lit("corr_"), F.col("chain_id")).alias("finding_id"), F.lit("attack_chain").alias("finding_type"), F.lit("attack_chain").alias("correlation_type"),
        F.col("chain_id").alias("entity"), F.when(F.col("completeness") > 0.5, "critical").otherwise("high").alias("severity"),
        F.col("stage_count").cast("bigint").alias("event_count"), F.lit(None).cast("bigint").alias("unique_partners"), "start_time", "end_time",
        F.col("duration_sec").alias("time_span_sec"), text.alias("explanation"), F.array().cast("array<string>").alias("mitre_techniques"),
        F.transform("stages", lambda x: F.replace(x, F.lit("_"), F.lit("-"))).alias("mitre_tactics"))


def all_correlations(events: DataFrame, as_of: Column, keys: list[str] | None = None, threshold: int = ENTITY_EVENTS, window_sec: int = ENTITY_WINDOW_SEC) -> DataFrame:
    parts = [chain_findings(kill_chains(events, keys))] + [entity_correlation(events, k, as_of, threshold, window_sec) for k in ("source", "target", "user")]
    return reduce(DataFrame.unionByName, parts)


def primary_correlation(correlations: DataFrame, batch: list[str] | None = None) -> DataFrame:
    """Best correlation per batch (or overall): chains first, then severity, then size. No sort, one combined minimum."""
    rank = F.struct(
        (F.col("correlation_type") != "attack_chain").cast("int"), F.when(F.col("correlation_type") == "attack_chain", 0).otherwise(-severity_rank("severity")),
        F.when(F.col("correlation_type") == "attack_chain", 0).otherwise(-F.col("event_count")), F.col("finding_id"))
    best = correlations.groupBy(*(batch or [])).agg(F.min_by(F.struct("*"), rank).alias("_b"))
    return best.filter(F.col("_b").isNotNull()).select("_b.*")
