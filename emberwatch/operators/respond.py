"""Response plans (RSP-01 … RSP-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Action → phase, title, urgency, automation, target kind, minutes.
ACTIONS = {
    "isolate_host": ("containment", "Isolate Affected Host", "immediate", "semi_automated", "host", 5),
    "disable_user": ("containment", "Disable Compromised User Account", "immediate", "approval_required", "user", 2),
    "block_ip": ("containment", "Block Malicious IP Address", "urgent", "fully_automated", "network", 1),
    "block_domain": ("containment", "Block Malicious Domain", "urgent", "fully_automated", "network", 2),
    "quarantine_email": ("containment", "Quarantine Phishing Emails", "urgent", "semi_automated", "application", 15),
    "remove_malware": ("eradication", "Remove Malware", "urgent", "semi_automated", "host", 30),
    "reset_credentials": ("eradication", "Reset User Credentials", "urgent", "approval_required", "user", 10),
    "patch_vulnerability": ("eradication", "Apply Security Patch", "standard", "manual", "host", 60),
    "remove_persistence": ("eradication", "Remove Persistence Mechanisms", "urgent", "manual", "host", 45),
    "restore_backup": ("recovery", "Restore from Backup", "standard", "manual", "host", 120),
    "reimage_host": ("recovery", "Reimage Affected Host", "standard", "manual", "host", 180),
    "restore_service": ("recovery", "Restore Network Access", "deferred", "approval_required", "network", 15),
}


def action_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in ACTIONS.items()],
                                 "action string, phase string, title string, urgency string, automation_level string, target_type string, minutes int")


def context_flags(incidents: DataFrame) -> DataFrame:
    """Threat flags from threat_type and classification texts."""
    threat, cls = F.lower(F.coalesce("threat_type", F.lit("unknown"))), F.lower(F.coalesce("classification", F.lit("other")))
    return incidents.withColumns({
        "has_malware": threat.contains("malware") | cls.contains("malware"), "has_c2": threat.contains("c2") | cls.contains("command"),
        "has_lateral_movement": threat.contains("lateral"), "has_data_exfil": threat.contains("exfil") | cls.contains("breach"),
        "has_credential_theft": threat.contains("credential") | cls.contains("phishing")})


def _action(name: str, target: Column) -> Column:
    phase, title, urgency, level, kind, minutes = ACTIONS[name]
    return F.struct(F.lit(name).alias("action"), F.lit(phase).alias("phase"), F.lit(title).alias("title"), F.lit(urgency).alias("urgency"), F.lit(level).alias("automation_level"),
                    F.lit(kind).alias("target_type"), F.lit(minutes).alias("minutes"), target.cast("string").alias("target"))


_TYPE = "array<struct<action:string,phase:string,title:string,urgency:string,automation_level:string,target_type:string,minutes:int,target:string>>"


def plan_actions(incidents: DataFrame, max_targets: int | None = None) -> DataFrame:
    """Adds ``actions``: containment, then eradication, then recovery, in order of execution.

    Needs threat_type, classification, severity and the arrays affected_hosts, affected_users,
    malicious_ips, malicious_domains. Every target gets its action, unless ``max_targets`` bounds
    the targets of one action. One projection, no shuffle.
    """
    df = context_flags(incidents)
    none = F.array().cast(_TYPE)
    targets = lambda col: F.coalesce(col, F.array().cast("array<string>"))
    each = lambda col, name: F.transform(targets(col) if max_targets is None else F.slice(targets(col), 1, max_targets), lambda t: _action(name, t)).cast(_TYPE)
    one = lambda name: F.array(_action(name, F.lit(""))).cast(_TYPE)
    when = lambda test, arr: F.when(test, arr).otherwise(none)
    c = F.col
    cls, threat, severity = F.lower(F.coalesce("classification", F.lit(""))), F.lower(F.coalesce("threat_type", F.lit(""))), F.lower("severity")
    return df.withColumn("actions", F.concat(
        each("affected_hosts", "isolate_host"), when(c("has_credential_theft"), each("affected_users", "disable_user")),
        when(c("has_c2"), each("malicious_ips", "block_ip")), each("malicious_domains", "block_domain"),
        when(cls.contains("phishing"), one("quarantine_email")),
        when(c("has_malware"), each("affected_hosts", "remove_malware")), each("affected_users", "reset_credentials"),
        when(c("has_malware") | c("has_c2"), one("remove_persistence")), when(threat.contains("exploit"), one("patch_vulnerability")),
        when(severity.isin("critical", "high") | c("has_malware"), one("restore_backup")), when(cls.contains("ransomware"), one("reimage_host")), one("restore_service")))


def action_rows(planned: DataFrame, key: str = "incident_id") -> DataFrame:
    return planned.select(key, F.posexplode("actions").alias("execution_order", "a")).select(key, (F.col("execution_order") + 1).alias("execution_order"), "a.*")


def playbooks(planned: DataFrame, key: str = "incident_id") -> DataFrame:
    """Totals per plan: minutes, immediate actions, automation, approvals, severity."""
    a = F.col("actions")
    minutes = F.aggregate(a, F.lit(0), lambda t, x: t + x["minutes"])
    immediate = F.size(F.filter(a, lambda x: x["urgency"] == "immediate"))
    approvals = F.filter(F.array(
        F.when(F.exists(a, lambda x: x["automation_level"] == "approval_required"), "Security Manager"),
        F.when(F.exists(a, lambda x: x["target_type"] == "user"), "HR Representative"), F.when(minutes > 120, "IT Operations Lead")), lambda x: x.isNotNull())
    return planned.select(
        key, F.concat(F.lit("Response Playbook - "), F.initcap(F.replace(F.coalesce("classification", F.lit("other")), F.lit("_"), F.lit(" ")))).alias("playbook_name"),
        F.size(a).alias("total_actions"), immediate.alias("immediate_actions"), F.exists(a, lambda x: x["automation_level"].isin("fully_automated", "semi_automated")).alias("automation_possible"),
        minutes.alias("total_minutes"), approvals.alias("required_approvals"), F.when(immediate > 2, "high").otherwise("medium").alias("severity"),
        F.concat(F.lit("Generated "), F.size(a).cast("string"), F.lit(" response actions ("), immediate.cast("string"), F.lit(" immediate). Estimated response time: "),
                 minutes.cast("string"), F.lit(" minutes.")).alias("explanation"))
