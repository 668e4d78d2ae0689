"""Report tables and texts (RPT-01 … RPT-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Titles and fixed passages.
TITLES = {
    "incident": "Security Incident Report", "executive": "Executive Security Summary", "technical": "Technical Security Analysis",
    "investigation": "Security Investigation Report",
}
METHODOLOGY = """Investigation methodology included:
1. Evidence collection and preservation
2. Timeline reconstruction
3. Malware analysis (if applicable)
4. Network traffic analysis
5. Log correlation and analysis
6. Affected asset identification
7. Root cause determination"""
CONCLUSIONS = """Based on the investigation:
1. The incident has been characterized and documented
2. Affected assets have been identified
3. Remediation recommendations have been provided
4. Follow-up actions are recommended as outlined above"""
URGENT_ADVICE = ("Activate incident response team immediately", "Isolate affected systems from the network", "Preserve all evidence for forensic analysis")
CALM_ADVICE = ("Review affected systems for compromise indicators", "Update security monitoring rules")
ASSET_ADVICE = "Conduct thorough review of all affected assets"
USER_ADVICE = "Reset credentials for affected user accounts"
MITRE_ADVICE = "Implement mitigations for identified MITRE ATT&CK techniques"
GENERAL_ADVICE = (
    "Update security policies based on lessons learned", "Conduct security awareness training for affected teams", "Review and update incident response procedures",
)


def _listed(df: DataFrame, key: str, order: list[str], rows: int | None, fields: list[str], name: str) -> DataFrame:
    """The rows of a key as an array in order, with the key's row count. A text needs its rows together; ``rows`` bounds them before the shuffle."""
    count = df.groupBy(key).agg(F.count(F.lit(1)).alias(f"{name}_count"))
    if rows is not None:
        df = df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_rn") <= rows)
    each = F.struct(F.struct(*order).alias("_at"), *[c for c in fields])
    listed = df.groupBy(key).agg(F.array_sort(F.collect_list(each)).alias(name))
    return listed.join(count, key)


def report_data(incidents: DataFrame, events: DataFrame, findings: DataFrame, key: str = "incident_id", timeline_rows: int | None = None, finding_rows: int | None = None) -> DataFrame:
    """Incidents (id, severity, affected_assets, affected_users, mitre_techniques) with what their report shows: all, unless rows are bounded."""
    ev = _listed(events, key, ["timestamp", "event_id"], timeline_rows, ["timestamp", "event_type", "event_id"], "events")
    fi = _listed(findings, key, ["timestamp", "finding_id"], finding_rows, ["severity", "finding_type", "explanation"], "findings")
    return incidents.join(ev, key, "left").join(fi, key, "left").fillna(0, ["events_count", "findings_count"])


def _texts(xs) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def _has(name: str) -> Column:
    return F.coalesce(F.size(name) > 0, F.lit(False))


def recommendations() -> Column:
    none = F.array().cast("array<string>")
    maybe = lambda test, text: F.when(test, F.array(F.lit(text))).otherwise(none)
    start = F.when(F.lower("severity").isin("critical", "high"), _texts(URGENT_ADVICE)).otherwise(_texts(CALM_ADVICE))
    return F.concat(start, maybe(_has("affected_assets"), ASSET_ADVICE), maybe(_has("affected_users"), USER_ADVICE), maybe(_has("mitre_techniques"), MITRE_ADVICE), _texts(GENERAL_ADVICE))


def summary() -> Column:
    n = lambda c: F.col(c).cast("string")
    assets = F.coalesce(F.greatest(F.size("affected_assets"), F.lit(0)), F.lit(0))
    return F.concat_ws(
        " ", F.concat(F.lit("This report documents a security incident classified as "), F.col("severity"), F.lit(" severity.")),
        F.when(F.col("findings_count") > 0, F.concat(F.lit("Analysis identified "), n("findings_count"), F.lit(" security findings."))),
        F.when(assets > 0, F.concat(assets.cast("string"), F.lit(" assets were affected by this incident."))),
        F.when(F.col("events_count") > 0, F.concat(F.lit("The incident involved "), n("events_count"), F.lit(" security events."))),
        F.when(_has("mitre_techniques"), F.concat(F.lit("MITRE ATT&CK techniques observed: "), F.array_join("mitre_techniques", ", "), F.lit("."))),
        F.lit("Immediate remediation actions are recommended based on the findings."))


def key_findings() -> Column:
    none = F.array().cast("array<string>")
    said = F.coalesce(F.transform("findings", lambda f: f["explanation"]), F.array().cast("array<string>"))
    noted = F.filter(said, lambda t: F.coalesce(t, F.lit("")) != "")
    return F.concat(
        F.array(F.concat(F.lit("Incident severity: "), F.upper("severity"))),
        F.when(_has("affected_assets"), F.array(F.concat(F.size("affected_assets").cast("string"), F.lit(" assets identified as affected")))).otherwise(none),
        F.when(_has("mitre_techniques"), F.array(F.lit("Attack techniques mapped to MITRE ATT&CK framework"))).otherwise(none), noted)


def _numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def _passages() -> dict[str, Column]:
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("string")
    lines = F.array_join(F.transform("events", lambda e: F.concat(F.lit("["), F.date_format(e["timestamp"], "yyyy-MM-dd'T'HH:mm:ss"), F.lit("] "), e["event_type"], F.lit(": "), e["event_id"].cast("string"))), "\n")
    found = F.array_join(F.transform("findings", lambda f, i: F.concat(
        (i + 1).cast("string"), F.lit(". ["), F.upper(f["severity"]), F.lit("] "), f["finding_type"], F.lit("\n   "), F.coalesce(f["explanation"], F.lit("No details available")), F.lit("\n"))), "\n")
    joined = F.array_join("mitre_techniques", ", ")
    return {
        "summary": summary(),
        "overview": F.concat(F.lit("Severity: "), F.upper("severity"), F.lit("\nAffected Assets: "), size("affected_assets"), F.lit("\nAffected Users: "), size("affected_users"),
                             F.lit("\nTotal Events: "), F.col("events_count").cast("string")),
        "timeline": F.coalesce(F.nullif(lines, F.lit("")), F.lit("No timeline data available.")),
        "findings": F.coalesce(F.nullif(found, F.lit("")), F.lit("No findings to report.")),
        "assets": F.array_join(F.transform("affected_assets", lambda a: F.concat(F.lit("- "), a)), "\n"),
        "mitre": F.array_join(F.transform("mitre_techniques", lambda t: F.concat(F.lit("- "), t)), "\n"),
        "advice": _numbered(recommendations()),
        "key_points": F.array_join(F.transform(key_findings(), lambda k: F.concat(F.lit("• "), k)), "\n"),
        "impact": F.concat(F.lit("Assets Affected: "), size("affected_assets"), F.lit("\nUsers Affected: "), size("affected_users"), F.lit("\nBusiness continuity assessment: Under evaluation")),
        "risk": F.concat(F.lit("Current Risk Level: "), F.upper("severity"), F.lit("\nRisk factors considered: Asset criticality, data sensitivity, threat actor capability")),
        "iocs": F.lit("Indicators of Compromise identified during analysis:\n- See technical findings for detailed IoC list"),
        "chain": F.when(_has("mitre_techniques"), F.concat(F.lit("Attack chain involved the following techniques: "), joined)).otherwise("Attack chain analysis in progress."),
        "methodology": F.lit(METHODOLOGY),
        "evidence": F.concat(F.lit("Evidence analyzed: "), F.col("events_count").cast("string"), F.lit(" events, "), F.col("findings_count").cast("string"), F.lit(" findings")),
        "conclusions": F.lit(CONCLUSIONS),
    }


# Sections per report kind: id, title, passage, condition (column that must be filled).
SECTIONS = {
    "incident": (("exec_summary", "Executive Summary", "summary", None), ("overview", "Incident Overview", "overview", None), ("timeline", "Timeline of Events", "timeline", "events"),
                 ("findings", "Technical Findings", "findings", "findings"), ("assets", "Affected Assets", "assets", "affected_assets"),
                 ("mitre", "MITRE ATT&CK Mapping", "mitre", "mitre_techniques"), ("recommendations", "Recommendations", "advice", None)),
    "executive": (("key_points", "Key Points", "key_points", None), ("impact", "Business Impact", "impact", None), ("risk", "Risk Assessment", "risk", None), ("actions", "Recommended Actions", "advice", None)),
    "technical": (("tech_overview", "Technical Overview", "overview", None), ("detailed_findings", "Detailed Technical Findings", "findings", "findings"),
                  ("iocs", "Indicators of Compromise", "iocs", None), ("attack_chain", "Attack Chain Analysis", "chain", None), ("remediation", "Technical Remediation Steps", "advice", None)),
    "investigation": (("inv_summary", "Investigation Summary", "summary", None), ("methodology", "Scope and Methodology", "methodology", None), ("forensic_timeline", "Forensic Timeline", "timeline", None),
                      ("evidence", "Evidence Analysis", "evidence", None), ("conclusions", "Conclusions", "conclusions", None)),
}


def report_sections(data: DataFrame, kind: str = "incident", key: str = "incident_id") -> DataFrame:
    """One row per section: key, section_id, title, content, section_order."""
    passages = _passages()
    items = []
    for order, (sid, title, passage, needs) in enumerate(SECTIONS[kind], 1):
        row = F.struct(F.lit(sid).alias("section_id"), F.lit(title).alias("title"), passages[passage].alias("content"), F.lit(order).alias("section_order"))
        items.append(F.when(_has(needs), row) if needs else row)
    return data.select(key, F.explode(F.filter(F.array(*items), lambda s: s.isNotNull())).alias("s")).select(key, "s.*")


def report_summaries(data: DataFrame, kind: str = "incident", key: str = "incident_id") -> DataFrame:
    return data.select(key, F.concat(F.lit(TITLES[kind] + " - "), F.col(key).cast("string")).alias("title"), summary().alias("summary"), key_findings().alias("key_findings"), recommendations().alias("recommendations"))


def report_texts(data: DataFrame, kind: str = "incident", form: str = "markdown", generated_at: Column | None = None, classification: str = "CONFIDENTIAL", key: str = "incident_id") -> DataFrame:
    """One text per incident: ``markdown``, ``json`` or ``text``."""
    now = F.current_timestamp() if generated_at is None else generated_at
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss")
    passages = _passages()
    items = []
    for order, (sid, title, passage, needs) in enumerate(SECTIONS[kind], 1):
        row = F.struct(F.lit(sid).alias("id"), F.lit(title).alias("title"), passages[passage].alias("content"), F.lit(order).alias("order"))
        items.append(F.when(_has(needs), row) if needs else row)
    df = data.select(key, F.concat(F.lit("rpt_"), F.substring(F.sha2(F.concat_ws("|", F.lit(kind), F.col(key).cast("string")), 256), 1, 12)).alias("report_id"),
                     F.concat(F.lit(TITLES[kind] + " - "), F.col(key).cast("string")).alias("title"), F.filter(F.array(*items), lambda s: s.isNotNull()).alias("sections"),
                     key_findings().alias("key_findings"), recommendations().alias("recommendations"), stamp.alias("generated_at"))
    if form == "json":
        body = F.to_json(F.struct(
            F.struct("report_id", F.lit(kind).alias("report_type"), "title", "generated_at", F.lit(classification).alias("classification"), F.col(key).cast("string").alias("incident_id")).alias("metadata"),
            "key_findings", "sections", "recommendations"))
        return df.select(key, "report_id", "title", body.alias("content"))
    md = form == "markdown"
    rule = "-" * 40
    head = lambda title: F.concat(F.lit("## "), title, F.lit("\n\n")) if md else F.concat(F.lit(rule + "\n"), F.upper(title), F.lit("\n" + rule + "\n"))
    mark = F.lit("- ") if md else F.lit("* ")
    top = (
        F.concat(F.lit("# "), F.col("title"), F.lit("\n\n---\n**Report ID:** "), F.col("report_id"), F.lit("\n**Generated:** "), F.col("generated_at"),
                 F.lit(f"\n**Classification:** {classification}\n**Incident ID:** "), F.col(key).cast("string"), F.lit("\n---\n")) if md else
        F.concat(F.lit("=" * 60 + "\n"), F.upper("title"), F.lit("\n" + "=" * 60 + "\n\nReport ID: "), F.col("report_id"), F.lit("\nGenerated: "), F.col("generated_at"),
                 F.lit(f"\nClassification: {classification}\nIncident ID: "), F.col(key).cast("string"), F.lit("\n")))
    keys = F.concat(head(F.lit("Key Findings")), F.array_join(F.transform("key_findings", lambda k: F.concat(mark, k)), "\n"), F.lit("\n"))
    body = F.array_join(F.transform("sections", lambda s: F.concat(head(s["title"]), s["content"], F.lit("\n"))), "\n")
    tail = F.concat(head(F.lit("Recommendations")), _numbered(F.col("recommendations")), F.lit("\n"))
    return df.select(key, "report_id", "title", F.concat_ws("\n", top, keys, body, tail).alias("content"))


def severity_distribution(df: DataFrame, column: str = "severity") -> DataFrame:
    """Count and share in percent per level. The share is over the few grouped rows."""
    grouped = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return grouped.select(column, "n", F.format_string("%.1f%%", F.bround(F.col("n") / F.greatest(total, F.lit(1)) * 100, 1)).alias("percentage"))
