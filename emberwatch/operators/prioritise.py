"""Incident prioritisation (PRI-01 … PRI-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.severity import LEVELS, lookup, severity_name, severity_rank, severity_score

# Weights of the factors in use.
WEIGHTS = {"severity": 0.25, "affected_scope": 0.10, "attack_stage": 0.10, "confidence": 0.05, "data_sensitivity": 0.15}
STAGE_SCORES = {
    "reconnaissance": 0.2, "initial-access": 0.4, "execution": 0.5, "persistence": 0.6, "privilege-escalation": 0.7, "defense-evasion": 0.6,
    "credential-access": 0.7, "discovery": 0.5, "lateral-movement": 0.8, "collection": 0.8, "command-and-control": 0.8, "exfiltration": 0.95, "impact": 1.0,
}
CONFIDENCE_WORDS = {"high": 0.9, "medium": 0.6, "low": 0.3}

# Priority → first response, containment, resolution, escalation.
SLA = (("P1", 15, 1, 4, 30), ("P2", 30, 4, 24, 60), ("P3", 60, 8, 72, 120), ("P4", 240, 24, 168, 480), ("P5", 1440, 72, 336, 2880))
PRIORITY_SEVERITY = {"P1": "critical", "P2": "high", "P3": "medium", "P4": "low", "P5": "informational"}

# Texts.
IMPACT = {
    "ransomware": "Critical business disruption risk", "data_breach": "Potential data exposure and compliance implications",
    "phishing": "Risk of credential compromise", "malware": "System integrity at risk", "unauthorized_access": "Security boundary violation",
    "advanced_persistent_threat": "Sophisticated threat actor with persistence",
}
ADVICE = {
    "ransomware": ("Isolate affected systems immediately", "Do not pay ransom", "Preserve evidence for forensics"),
    "data_breach": ("Identify scope of exposed data", "Notify legal and compliance teams", "Prepare breach notification if required"),
    "phishing": ("Reset credentials for affected users", "Block malicious domains/IPs", "Send user awareness notification"),
    "unauthorized_access": ("Disable compromised accounts", "Review access logs", "Strengthen authentication controls"),
}
ESCALATED_CLASSES = ("ransomware", "advanced_persistent_threat", "data_breach")


def sla_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SLA), "priority string, initial_response_minutes int, containment_hours int, resolution_hours int, escalation_after_minutes int")


def merge_inputs(incidents: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Incidents with what their findings add: the highest severity and the finding types.

    ``findings`` carries incident_id, severity, finding_type. Types are collected distinct; there
    are as many as rules have kinds.
    """
    sev = F.lower("severity")
    base = incidents.withColumn("severity", F.when(sev.isin(*LEVELS), sev).otherwise("medium"))
    if findings is None:
        return base
    fsev = F.lower("severity")
    per = findings.groupBy("incident_id").agg(
        F.max(severity_rank(F.when(fsev.isin(*LEVELS), fsev).otherwise("medium"))).alias("_rank"), F.array_sort(F.collect_set("finding_type")).alias("_types"))
    out = base.join(per, "incident_id", "left")
    return out.withColumns({
        "severity": F.when(F.col("_rank") > severity_rank("severity"), severity_name("_rank")).otherwise(F.col("severity")),
        "event_types": F.concat("event_types", F.coalesce("_types", F.array().cast("array<string>")))}).drop("_rank", "_types")


def _any_word(items: str, *words: str) -> Column:
    def test(t: Column) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.lower(t).contains(w)
        return out

    return F.exists(items, test)


def _confidence(df: DataFrame) -> Column:
    if "confidence" not in df.columns:
        return F.lit(0.5)
    text = F.lower(F.col("confidence").cast("string"))
    return F.coalesce(F.col("confidence").cast("string").try_cast("double"), lookup(text, CONFIDENCE_WORDS), F.lit(0.5))


def classification() -> Column:
    ev, ta = "event_types", "mitre_tactics"
    return (
        F.when(_any_word(ev, "ransomware", "encrypt"), "ransomware").when(_any_word(ev, "phishing"), "phishing").when(_any_word(ev, "malware"), "malware")
        .when(_any_word(ta, "exfil") | _any_word(ev, "breach"), "data_breach").when(_any_word(ev, "brute", "unauthorized"), "unauthorized_access")
        .when(_any_word(ev, "dos", "denial"), "denial_of_service").when(_any_word(ev, "insider"), "insider_threat").when(_any_word(ta, "recon"), "reconnaissance")
        .when(F.exists(ta, lambda t: F.lower(t).isin("command-and-control", "lateral-movement")), "advanced_persistent_threat").otherwise("other"))


def prioritise(incidents: DataFrame) -> DataFrame:
    """Score, priority, service level, class, impact, escalation and advice per incident. No shuffle.

    Needs severity, affected_assets and affected_users (counts), event_types, mitre_tactics, and takes confidence when present.
    """
    ok = F.lower("severity").isin(*LEVELS)
    df = incidents.withColumn("severity", F.when(ok, F.lower("severity")).otherwise("medium"))
    stage = F.array_max(F.transform("mitre_tactics", lambda t: lookup(F.lower(t), STAGE_SCORES, 0.5)))
    df = df.withColumns({
        "factor_severity": severity_score("severity"), "factor_scope": F.least(F.col("affected_assets") / 10.0, F.lit(1.0)),
        "factor_stage": F.when(F.size("mitre_tactics") > 0, stage).otherwise(0.3), "factor_confidence": _confidence(df),
        "factor_sensitivity": F.when(_any_word("mitre_tactics", "exfil"), 0.9).when(_any_word("event_types", "credential"), 0.8).otherwise(0.5),
        "classification": classification()})
    total = (F.col("factor_severity") * WEIGHTS["severity"] + F.col("factor_scope") * WEIGHTS["affected_scope"] + F.col("factor_stage") * WEIGHTS["attack_stage"]
             + F.col("factor_confidence") * WEIGHTS["confidence"] + F.col("factor_sensitivity") * WEIGHTS["data_sensitivity"])
    df = df.withColumn("risk_score", F.bround(total / sum(WEIGHTS.values()) * 100, 1))
    n = F.col("affected_assets")
    df = df.withColumns({
        "priority": F.when(F.col("risk_score") >= 85, "P1").when(F.col("risk_score") >= 70, "P2").when(F.col("risk_score") >= 50, "P3").when(F.col("risk_score") >= 30, "P4").otherwise("P5"),
        "asset_criticality": F.when(n >= 10, "critical").when(n >= 5, "high").when(n >= 2, "medium").otherwise("low")})
    crit, cls, risk = F.col("asset_criticality"), F.col("classification"), F.col("risk_score")
    impact = F.concat_ws(
        ". ", lookup("classification", IMPACT), F.when(crit == "critical", "Critical assets affected").when(crit == "high", "High-value assets involved"),
        F.when(n > 5, F.concat(n.cast("string"), F.lit(" assets affected"))),
        F.when(F.col("affected_users") > 0, F.concat(F.col("affected_users").cast("string"), F.lit(" users potentially impacted"))))
    reasons = F.concat_ws(
        "; ", F.when(risk >= 90, "Risk score exceeds critical threshold"), F.when(crit == "critical", "Critical assets affected"),
        F.when(cls.isin(*ESCALATED_CLASSES), F.concat(F.lit("Incident type: "), cls)), F.when(n >= 10, "Wide-spread impact detected"))
    sla = {p: (first, cont, res, esc) for p, first, cont, res, esc in SLA}
    df = df.withColumns({
        "business_impact": F.when(impact == "", "Business impact assessment pending").otherwise(impact), "escalation_reason": reasons, "escalation_required": reasons != "",
        "finding_severity": lookup("priority", PRIORITY_SEVERITY, "medium"),
        **{name: lookup("priority", {p: v[i] for p, v in sla.items()}) for i, name in enumerate(("initial_response_minutes", "containment_hours", "resolution_hours", "escalation_after_minutes"))}})
    by_class = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, lines in ADVICE.items():
        by_class = by_class.when(cls == name, F.array(*[F.lit(x) for x in lines]))
    none = F.array().cast("array<string>")
    return df.withColumn("recommendations", F.concat(
        F.when(F.col("escalation_required"), F.array(F.lit("Immediately escalate to security leadership"))).otherwise(none),
        F.when(F.col("priority").isin("P1", "P2"), F.array(F.lit("Activate incident response team"), F.lit("Begin containment procedures"))).otherwise(none),
        F.coalesce(by_class, none),
        F.array(F.format_string("Initial response required within %d minutes", F.col("initial_response_minutes")))))
