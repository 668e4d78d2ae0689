"""Text scans and audit roll-up (AUD-01 … AUD-04)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .changelog import counts_by, current_state

# Secret patterns.
SECRET_PATTERNS = (
    (r"""(?i)password\s*=\s*["'][^"']+["']""", "Hardcoded password"), (r"""(?i)api_key\s*=\s*["'][^"']+["']""", "Hardcoded API key"),
    (r"""(?i)secret\s*=\s*["'][^"']+["']""", "Hardcoded secret"), (r"""(?i)token\s*=\s*["'][A-Za-z0-9+/=]{20,}["']""", "Hardcoded token"),
    (r"(?i)-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----", "Private key in code"),
)
# Code patterns open to SQL injection.
SQL_PATTERNS = (
    (r"(?i)execute\([^)]*\%s", "String formatting in SQL execute"), (r'(?i)f"SELECT.*\{', "F-string in SQL query"),
    (r"(?i)\.format\(.*\).*(?:SELECT|INSERT|UPDATE|DELETE)", "Format string in SQL"), (r"(?i)\+\s*(?:request|user_input|data)", "String concatenation with user input"),
)
# Frameworks and the controls assumed per framework.
FRAMEWORKS = ("soc2", "nist_csf", "iso_27001", "pci_dss", "hipaa", "gdpr", "cis_benchmarks")
MIN_CONTROLS = 10


def secret_findings(df: DataFrame, text: str, key: str) -> DataFrame:
    """One row per text and secret kind with the number of hits; the whole text is scanned."""
    t = F.col(text)
    hits = [F.when(t.rlike(p), F.struct(F.lit(d).alias("title"), F.size(F.regexp_extract_all(t, F.lit(p), F.lit(0))).alias("instances"))) for p, d in SECRET_PATTERNS]
    rows = df.select(key, F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("h"))
    return rows.select(key, "h.title", "h.instances", F.format_string("Found %d instance(s) of %s", F.col("h.instances"), F.lower("h.title")).alias("description"),
                       F.lit("critical").alias("severity"), F.lit("secrets").alias("category"), F.lit("CWE-798").alias("cwe_id"), F.lit("open").alias("status"))


def injection_findings(df: DataFrame, text: str, key: str) -> DataFrame:
    hits = [F.when(F.col(text).rlike(p), F.lit(d)) for p, d in SQL_PATTERNS]
    rows = df.select(key, F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("description"))
    return rows.select(key, F.lit("Potential SQL Injection").alias("title"), "description", F.lit("critical").alias("severity"), F.lit("input_validation").alias("category"),
                       F.lit("CWE-89").alias("cwe_id"), F.lit("open").alias("status"))


def audit_report(checks: DataFrame, key: str = "report_id") -> DataFrame:
    """Score and risk rating per report from check outcomes (passed, severity)."""
    failed = ~F.col("passed")
    n = checks.groupBy(key).agg(
        F.count_if(F.col("passed")).alias("checks_passed"), F.count_if(failed).alias("checks_failed"), F.count_if(failed & (F.col("severity") == "critical")).alias("critical_count"),
        F.count_if(failed & (F.col("severity") == "high")).alias("high_count"))
    score = F.coalesce(F.try_divide(F.col("checks_passed").cast("double"), (F.col("checks_passed") + F.col("checks_failed")).cast("double")) * 100, F.lit(0.0))
    n = n.withColumn("overall_score", score)
    rating = (
        F.when(F.col("critical_count") > 0, "critical").when(F.col("high_count") > 2, "high").when((F.col("high_count") > 0) | (F.col("overall_score") < 70), "medium")
        .when(F.col("overall_score") < 90, "low").otherwise("minimal"))
    return n.withColumn("risk_rating", rating)


def compliance_status(checks: DataFrame, key: str = "report_id") -> DataFrame:
    """Failed controls and compliance per report and framework (``compliance_refs``: ``framework:control``)."""
    refs = checks.filter(~F.col("passed")).select(key, F.explode("compliance_refs").alias("r")).filter(F.col("r").contains(":"))
    failed = refs.select(key, F.split_part("r", F.lit(":"), F.lit(1)).alias("framework")).groupBy(key, "framework").agg(F.count(F.lit(1)).alias("controls_failed"))
    every = checks.select(key).distinct().select(key, F.explode(F.array(*[F.lit(f) for f in FRAMEWORKS])).alias("framework"))
    df = every.join(failed, [key, "framework"], "left").fillna(0, ["controls_failed"])
    total = F.greatest(F.lit(MIN_CONTROLS).cast("bigint"), F.col("controls_failed"))
    return df.select(key, "framework", total.alias("controls_checked"), (total - F.col("controls_failed")).alias("controls_passed"), "controls_failed",
                     ((total - F.col("controls_failed")) / total * 100).alias("compliance_pct"))


def finding_counts(findings: DataFrame) -> DataFrame:
    return counts_by(findings, "severity", "category", "status")


def findings_by_severity(findings: DataFrame, severity: str) -> DataFrame:
    return findings.filter(F.col("severity") == severity)


def finding_state(findings: DataFrame, changes: DataFrame, key: str = "finding_id") -> DataFrame:
    """Findings after their resolve log (status, resolution_notes)."""
    return current_state(findings, changes, key, [c for c in ("status", "resolution_notes") if c in changes.columns])
