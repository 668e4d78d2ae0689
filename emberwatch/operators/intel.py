"""Threat-intelligence enrichment (TI-01 … TI-10, SRC-06, EXT-04)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.severity import as_col, lookup
from ..plans.bounds import before

# Sample provider rows: indicator, kind, reputation, tags, malware families.
SAMPLE_PROVIDER = (
    ("185.220.101.1", "ip", "malicious", ("tor_exit", "scanner"), ()),
    ("45.33.32.156", "ip", "malicious", ("c2", "emotet"), ()),
    ("192.168.1.1", "ip", "benign", ("private",), ()),
    ("evil.com", "domain", "malicious", ("phishing", "malware"), ()),
    ("malware-c2.tk", "domain", "malicious", ("c2", "apt"), ()),
    ("suspicious-login.ml", "domain", "suspicious", ("phishing",), ()),
    ("44d88612fea8a8f36de82e1278abb02f", "hash", "malicious", (), ("eicar_test",)),
    ("e99a18c428cb38d5f260853678922e03", "hash", "malicious", (), ("emotet",)),
)
# Fixed values per kind: confidence, hours since first and last sighting.
PROVIDER_CONFIDENCE = {"ip": 0.9, "domain": 0.85, "hash": 0.95}
PROVIDER_FIRST_HOURS = {"ip": 30 * 24, "domain": 14 * 24, "hash": 60 * 24}
PROVIDER_LAST_HOURS = {"ip": 1, "domain": 6, "hash": 24}

# Internal list: value, kind, category, confidence, malware family.
INTERNAL_LIST = (
    ("185.220.101.1", "ip", "c2", 0.95, None), ("45.33.32.156", "ip", "malware", 0.8, None), ("198.51.100.1", "ip", "botnet", 0.9, None),
    ("malware-c2.com", "domain", "c2", 0.95, None), ("phishing-site.net", "domain", "phishing", 0.9, None),
    ("ransomware-payment.org", "domain", "ransomware", 0.95, None),
    ("44d88612fea8a8f36de82e1278abb02f", "hash", "malware", 1.0, "EICAR-Test"),
)

# Techniques: id, name, tactic.
MITRE_TECHNIQUES = (
    ("T1566", "Phishing", "initial-access"), ("T1566.001", "Spearphishing Attachment", "initial-access"),
    ("T1071", "Application Layer Protocol", "command-and-control"), ("T1110", "Brute Force", "credential-access"),
    ("T1046", "Network Service Discovery", "discovery"), ("T1048", "Exfiltration Over Alternative Protocol", "exfiltration"),
    ("T1059", "Command and Scripting Interpreter", "execution"), ("T1078", "Valid Accounts", "defense-evasion"),
    ("T1021", "Remote Services", "lateral-movement"), ("T1486", "Data Encrypted for Impact", "impact"),
)
CATEGORY_TECHNIQUES = {"phishing": ("T1566", "T1566.001"), "c2": ("T1071",), "malware": ("T1059",), "ransomware": ("T1486",), "botnet": ("T1071",)}
EVENT_TECHNIQUES = (("auth_failed", "T1110"), ("brute_force", "T1110"), ("port_scan", "T1046"), ("lateral_movement", "T1021"), ("data_exfil", "T1048"))

# Event fields that hold indicators, per kind.
INDICATOR_FIELDS = {
    "ip": ("source_ip", "src_ip", "destination_ip", "dest_ip", "ip"), "domain": ("domain", "hostname", "host"),
    "url": ("url", "uri"), "hash": ("md5", "sha1", "sha256", "file_hash", "hash"),
}
REPUTATION_ORDER = {"malicious": 0, "suspicious": 1, "benign": 2, "unknown": 3}

_PROVIDER = "indicator string, kind string, reputation string, tags array<string>, malware_families array<string>"


def mitre_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MITRE_TECHNIQUES), "technique_id string, technique_name string, tactic string")


def sample_provider(spark: SparkSession, as_of: Column | None = None) -> DataFrame:
    """Provider table: indicator, kind, provider, reputation, tags, families, confidence, first and last sighting."""
    now = F.current_timestamp() if as_of is None else as_of
    rows = spark.createDataFrame([(v, k, r, list(t), list(m)) for v, k, r, t, m in SAMPLE_PROVIDER], _PROVIDER)
    ago = lambda table: F.timestamp_micros(F.unix_micros(now) - lookup("kind", table).cast("bigint") * 3_600_000_000)
    return rows.select("indicator", "kind", F.lit("mock_provider").alias("provider"), "reputation", "tags", "malware_families",
                       lookup("kind", PROVIDER_CONFIDENCE).alias("confidence"), ago(PROVIDER_FIRST_HOURS).alias("first_seen"), ago(PROVIDER_LAST_HOURS).alias("last_seen"))


def union_providers(*providers: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), providers)


def internal_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(INTERNAL_LIST), "value string, kind string, category string, confidence double, malware_family string")


def _hash_kind(c: Column) -> Column:
    text = F.lower(F.trim(c))
    return F.when(text.rlike("^[0-9a-f]{32}$"), "hash_md5").when(text.rlike("^[0-9a-f]{40}$"), "hash_sha1").when(text.rlike("^[0-9a-f]{64}$"), "hash_sha256")


def lookup_type(c: Column | str) -> Column:
    """Indicator kind as the lookup service sees it; a domain when nothing else fits."""
    c = as_col(c)
    return (
        F.when(c.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), "ip")
        .when(c.rlike("^[a-fA-F0-9]{32}$"), "hash_md5").when(c.rlike("^[a-fA-F0-9]{40}$"), "hash_sha1").when(c.rlike("^[a-fA-F0-9]{64}$"), "hash_sha256")
        .when(c.rlike(r"(?i)^CVE-\d{4}-\d+$"), "cve").when(c.rlike(r"^[\w\.-]+@[\w\.-]+\.\w+$"), "email")
        .when(c.startswith("http://") | c.startswith("https://"), "url").otherwise("domain")
    )


def analyst_type(c: Column | str) -> Column:
    """Indicator kind as the analysis step sees it: other order, techniques known, looser mail test."""
    c = as_col(c)
    return (
        F.when(c.rlike(r"^(\d{1,3}\.){3}\d{1,3}$"), "ip_address").when(_hash_kind(c).isNotNull(), F.concat(F.lit("file_"), _hash_kind(c)))
        .when(c.startswith("http://") | c.startswith("https://") | c.startswith("ftp://"), "url")
        .when(c.contains("@") & F.element_at(F.split(c, "@"), -1).contains("."), "email")
        .when(c.rlike(r"(?i)^CVE-\d{4}-\d+$"), "cve").when(c.rlike(r"^T\d{4}(\.\d{3})?$"), "mitre_technique").otherwise("domain")
    )


def extract_indicators(events: DataFrame) -> DataFrame:
    """(event_id, position, indicator, indicator_type): one row per filled indicator field."""
    cols, items, position = set(events.columns), [], 0
    for kind, fields in INDICATOR_FIELDS.items():
        for name in fields:
            if name in cols:
                value = F.col(name).cast("string")
                typ = lookup_type(value) if kind == "hash" else F.lit(kind)
                items.append(F.when(F.coalesce(value, F.lit("")) != "", F.struct(F.lit(position).alias("position"), value.alias("indicator"), typ.alias("indicator_type"))))
            position += 1
    return events.select("event_id", F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("i")).select("event_id", "i.*")


def _provider_key(indicator: Column, indicator_type: Column) -> tuple[Column, Column]:
    kind = F.when(indicator_type.startswith("hash"), "hash").otherwise(indicator_type)
    return kind, F.when(kind == "ip", indicator).otherwise(F.lower(indicator))


def lookup_indicators(indicators: DataFrame, provider_rows: DataFrame, providers: list[str], as_of: Column | None = None) -> DataFrame:
    """One row per indicator and provider; an unknown indicator still gets its row.

    ``indicators`` carries (indicator, indicator_type) and may carry more. The provider names are
    few and known, so each indicator is expanded to them and looked up by one left equi-join.
    """
    now = F.current_timestamp() if as_of is None else as_of
    kind, key = _provider_key(F.col("indicator"), F.col("indicator_type"))
    wanted = indicators.select("*", F.explode(F.array(*[F.lit(p) for p in providers])).alias("provider"), kind.alias("_k"), key.alias("_v"))
    rows = provider_rows.withColumnsRenamed({"indicator": "_pv", "kind": "_pk", "provider": "_pp"})
    joined = wanted.join(rows, (F.col("_v") == F.col("_pv")) & (F.col("_k") == F.col("_pk")) & (F.col("provider") == F.col("_pp")), "left")
    empty = F.array().cast("array<string>")
    return joined.select(
        *indicators.columns, "provider", F.coalesce("reputation", F.lit("unknown")).alias("reputation"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("tags", empty).alias("tags"), F.coalesce("malware_families", empty).alias("malware_families"), "first_seen", "last_seen", now.alias("retrieval_time"))


def aggregated_reputation(results: DataFrame, *keys: str) -> DataFrame:
    rank = lookup("reputation", REPUTATION_ORDER, 3)
    names = {v: k for k, v in REPUTATION_ORDER.items()}
    return results.groupBy(*keys).agg(F.min(rank).alias("_r"), F.max("confidence").alias("confidence")).select(
        *keys, lookup("_r", names).alias("reputation"), "confidence")


def enrich_events(events: DataFrame, provider_rows: DataFrame, providers: list[str], as_of: Column | None = None) -> DataFrame:
    """Event id → list of results, one entry per indicator and provider.

    Distinct indicators are looked up once, then attached to their events; an event holds at most
    fifteen indicator fields, so its list stays small.
    """
    found = extract_indicators(events)
    distinct = found.select("indicator", "indicator_type").distinct()
    results = lookup_indicators(distinct, provider_rows, providers, as_of)
    item = F.struct("position", "indicator", "indicator_type", "provider", "reputation", "confidence", "tags", "malware_families")
    return found.join(results, ["indicator", "indicator_type"]).groupBy("event_id").agg(F.array_sort(F.collect_list(item)).alias("enrichments"))


def stale_indicators(wanted: DataFrame, known: DataFrame, ttl_seconds: int = 3600, as_of: Column | None = None) -> DataFrame:
    """Indicators whose last result is missing or older than the time to live."""
    now = F.current_timestamp() if as_of is None else as_of
    fresh = known.filter(F.col("retrieval_time") >= before(known, "retrieval_time", now, ttl_seconds))
    fresh = fresh.select(F.col("indicator_type").alias("_t"), F.lower("indicator").alias("_v")).distinct()
    return wanted.join(fresh, (F.col("indicator_type") == F.col("_t")) & (F.lower("indicator") == F.col("_v")), "left_anti")


def finding_indicators(findings: DataFrame) -> DataFrame:
    """Indicators of findings, first mention per value: own list, then fields (``finding_id`` is the key)."""
    cols, parts = set(findings.columns), []
    if "iocs" in cols:
        parts.append(F.transform(F.coalesce("iocs", F.array().cast("array<string>")), lambda v: F.struct(v.alias("value"), analyst_type(v).alias("ioc_type"))))
    for name, kind in (("ip", "ip_address"), ("source_ip", "ip_address"), ("destination_ip", "ip_address"), ("domain", "domain"), ("hostname", "domain"), ("hash", None), ("url", "url")):
        if name in cols:
            value = F.col(name)
            typ = F.lit(kind) if kind else F.coalesce(F.concat(F.lit("file_"), _hash_kind(value)), F.lit("domain"))
            parts.append(F.array(F.struct(value.alias("value"), typ.alias("ioc_type"))))
    everything = F.filter(F.concat(*parts), lambda x: F.coalesce(x["value"], F.lit("")) != "")
    rows = findings.select("finding_id", F.posexplode(everything).alias("position", "i")).select("finding_id", "position", "i.*")
    return rows.groupBy("finding_id", "value").agg(F.min(F.struct("position", "ioc_type")).alias("m")).select("finding_id", "m.position", "value", "m.ioc_type")


def enrich_indicators(iocs: DataFrame, listed: DataFrame) -> DataFrame:
    """Category and confidence from the internal list: addresses as they are, names and hashes in lower case."""
    kind = F.when(F.col("ioc_type") == "ip_address", "ip").when(F.col("ioc_type").startswith("file_hash"), "hash").otherwise(F.col("ioc_type"))
    key = F.when(kind == "ip", F.col("value")).otherwise(F.lower("value"))
    rows = listed.withColumnsRenamed({"value": "_v", "kind": "_k", "confidence": "confidence_score", "category": "threat_category"})
    out = iocs.withColumns({"_kind": kind, "_key": key}).join(rows, (F.col("_kind") == F.col("_k")) & (F.col("_key") == F.col("_v")), "left")
    return out.select(*iocs.columns, F.col("_v").isNotNull().alias("is_known_malicious"), F.coalesce("threat_category", F.lit("unknown")).alias("threat_category"),
                      F.coalesce("confidence_score", F.lit(0.0)).alias("confidence_score"), "malware_family")


def threat_severity(score: Column | str) -> Column:
    score = as_col(score)
    return F.when(score >= 0.9, "critical").when(score >= 0.7, "high").when(score >= 0.4, "medium").when(score >= 0.2, "low").otherwise("informational")


def map_techniques(payload_ids: Column, categories: Column, event_type: Column) -> Column:
    """Technique ids: given ones, then by category, then by event type; only known ids, first mention kept."""
    known = [t[0] for t in MITRE_TECHNIQUES]
    none = F.array().cast("array<string>")

    def by_category(c: Column) -> Column:
        out = F.when(F.lit(False), none)
        for name, ids in CATEGORY_TECHNIQUES.items():
            out = out.when(c == name, F.array(*[F.lit(i) for i in ids]))
        return out.otherwise(none)

    hints = F.array(*[F.when(F.lower(event_type).contains(word), F.lit(tech)) for word, tech in EVENT_TECHNIQUES])
    every = F.concat(F.coalesce(payload_ids, none), F.flatten(F.transform(F.coalesce(categories, none), by_category)), F.filter(hints, lambda x: x.isNotNull()))
    return F.array_distinct(F.filter(every, lambda x: x.isin(*known)))


def threat_findings(findings: DataFrame, listed: DataFrame) -> DataFrame:
    """Threat score, severity and techniques per finding (columns mitre_techniques and event_type are used when present)."""
    cols = findings.columns
    enriched = enrich_indicators(finding_indicators(findings), listed)
    bad = F.col("is_known_malicious")
    per = enriched.groupBy("finding_id").agg(
        F.count(F.lit(1)).alias("total_iocs"), F.count_if(bad).alias("known_malicious"), F.avg(F.when(bad, F.col("confidence_score"))).alias("_avg"),
        F.array_sort(F.collect_list(F.when(bad, F.struct("position", "threat_category")))).alias("_c"),
    )
    joined = findings.join(per, "finding_id", "left")
    score = F.when(F.col("total_iocs").isNull(), 0.0).otherwise(F.coalesce("_avg", F.lit(0.1)))
    categories = F.transform("_c", lambda x: x["threat_category"])
    techniques = map_techniques(F.col("mitre_techniques") if "mitre_techniques" in cols else F.lit(None).cast("array<string>"), categories,
                                F.coalesce("event_type", F.lit("")) if "event_type" in cols else F.lit(""))
    tactics = {}
    for tech, _, tactic in MITRE_TECHNIQUES:
        tactics[tech] = tactic
    return joined.select(
        "finding_id", F.coalesce("total_iocs", F.lit(0)).alias("total_iocs"), F.coalesce("known_malicious", F.lit(0)).alias("known_malicious"),
        score.alias("threat_score"), threat_severity(score).alias("severity"), F.array_distinct(F.coalesce(categories, F.array().cast("array<string>"))).alias("threat_categories"),
        techniques.alias("mitre_techniques"), F.array_distinct(F.transform(techniques, lambda t: lookup(t, tactics))).alias("mitre_tactics"))
