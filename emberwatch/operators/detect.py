"""Rule detection over events: matches and findings (DET-01, DET-05, DET-08, DET-17 … DET-19, DET-21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.severity import severity_name, severity_rank
from ..plans.fence import once
from . import indicators as I
from .rules import Rule, condition_hit, default_rules, field_column, logsource_test

# Event columns a finding repeats.
CONTEXT = ("timestamp", "source_ip", "destination_ip", "username", "hostname", "domain")

# Finding type by tag, first one wins.
TYPE_BY_TAG = (
    (("sqli", "sql-injection"), "sql_injection_attempt"), (("xss",), "xss_attempt"),
    (("command-injection", "rce"), "command_injection_attempt"), (("log4shell", "jndi"), "log4shell_exploitation"),
    (("path-traversal", "lfi"), "path_traversal_attempt"), (("ssrf",), "ssrf_attempt"), (("brute-force",), "brute_force_indicator"),
    (("phishing",), "phishing_indicator"), (("scanner", "recon"), "reconnaissance_activity"),
)
TYPE_BY_IOC = {"ip": "malicious_ip_communication", "domain": "malicious_domain_access", "hash": "malicious_file_detected", "url": "malicious_url_access"}
TYPE_BY_RULE = (("sigma", "sigma_rule_match"), ("regex", "pattern_match"), ("ioc", "ioc_match"))

MATCH = "struct<ord:int,matched_field:string,matched_value:string,match_start:int,match_end:int>"


def _texts(values: tuple) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _match(ord_: int, field: Column, value: Column, start: Column | None = None, end: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(ord_).alias("ord"), field.cast("string").alias("matched_field"), value.cast("string").alias("matched_value"),
        (none if start is None else start).cast("int").alias("match_start"), (none if end is None else end).cast("int").alias("match_end"),
    ).cast(MATCH)


def text_matches(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Events that match, with ``_m``: their Sigma and regex matches in rule order. One scan, no shuffle.

    A first step finds only which field hit; matched texts are cut out afterwards, for rows that hit.
    """
    cols = events.columns
    if any(f.startswith("raw_") and f != "raw_string" for r in rules for f in (*r.fields, *[c.field for c in r.conditions])) and "raw_data" in cols:
        events = events.withColumn("_raw", X.json_object("raw_data"))
    hits, build = {}, []
    for order, rule in enumerate(rules):
        if not rule.enabled or rule.rule_type == "ioc":
            continue
        if rule.rule_type == "sigma":
            marks = [condition_hit(c, cols) for c in rule.conditions]
            hits[f"_h{order}"] = F.when(logsource_test(rule.logsource), F.array(*marks)) if marks else F.lit(None).cast("array<string>")
            met = F.filter(F.col(f"_h{order}"), lambda x: x.isNotNull())
            needed = len(marks) if rule.logic == "all" else 1
            names = F.filter(F.transform(F.col(f"_h{order}"), lambda x, i: F.when(x.isNotNull(), F.get(_texts(tuple(c.field for c in rule.conditions)), i))), lambda x: x.isNotNull())
            build.append(F.when(F.size(met) >= max(needed, 1), _match(order, F.get(names, F.lit(0)), F.get(met, F.lit(0)))))
        else:
            fields = [(name, field_column(name, cols)) for name in rule.fields]
            where = F.when(F.lit(False), F.lit(None).cast("int"))
            for i, (_, value) in enumerate(fields):
                where = where.when(value.rlike(rule.pattern), i)
            hits[f"_h{order}"] = where
            name, value = F.when(F.lit(False), F.lit(None).cast("string")), F.when(F.lit(False), F.lit(None).cast("string"))
            at = F.col(f"_h{order}")
            for i, (n, v) in enumerate(fields):
                name, value = name.when(at == i, n), value.when(at == i, v)
            found = F.regexp_extract(value, rule.pattern, 0)
            start = F.regexp_instr(value, F.lit(rule.pattern)) - 1
            build.append(F.when(at.isNotNull(), _match(order, name, found, start, start + F.length(found))))
    if not build:
        return events.withColumn("_m", F.array().cast(f"array<{MATCH}>"))
    marked = once(once(events).withColumns(hits))
    any_hit = F.coalesce(*[F.when(F.col(h).isNotNull(), 1) for h in hits])
    listed = F.filter(F.array(*build), lambda m: m.isNotNull())
    return marked.filter(any_hit.isNotNull()).withColumn("_m", listed).drop(*hits)


def detect(events: DataFrame, feed: DataFrame | None = None, rules: list[Rule] | None = None, engines: tuple | None = None) -> DataFrame:
    """All matches, one row per event and rule; ``engines`` limits the rule kinds."""
    rules = [r for r in (default_rules() if rules is None else rules) if engines is None or r.rule_type in engines]
    context = [c for c in CONTEXT if c in events.columns]
    meta = F.array(*[
        F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.rule_name).alias("rule_name"), F.lit(r.rule_type).alias("rule_type"), F.lit(r.severity).alias("severity"),
                 F.lit("definitive" if r.rule_type == "ioc" else "high").alias("confidence"), _texts(r.mitre_techniques).alias("mitre_techniques"),
                 _texts(r.mitre_tactics).alias("mitre_tactics"), _texts(r.tags).alias("tags"), F.lit(r.description).alias("description"))
        for r in rules
    ])
    none = F.lit(None).cast("string")
    parts = []
    if any(r.rule_type != "ioc" and r.enabled for r in rules):
        text = text_matches(events, rules).select("event_id", *context, F.explode_outer("_m").alias("m")).filter(F.col("m").isNotNull())
        parts.append(text.select("event_id", *context, "m.*", none.alias("ioc_type"), none.alias("ioc_category"), none.alias("ioc_source")))
    if feed is not None and any(r.rule_type == "ioc" and r.enabled for r in rules):
        order = {r.rule_id: i for i, r in enumerate(rules)}
        position = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("rule_id")).cast("int") - 1
        found = I.match_indicators(events, feed, rules, tuple(context))
        parts.append(found.select("event_id", *context, position.alias("ord"), "matched_field", "matched_value", F.lit(None).cast("int").alias("match_start"),
                                  F.lit(None).cast("int").alias("match_end"), "ioc_type", "ioc_category", "ioc_source"))
    if not parts:
        raise ValueError("no enabled rule for the chosen engines")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("_r", F.get(meta, F.col("ord"))).select(*out.columns, "_r.*")


def finding_type(tags: Column, ioc_types: Column, rule_types: Column) -> Column:
    """Kind of a finding from the tags, indicator kinds and rule kinds of its matches."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for names, kind in TYPE_BY_TAG:
        test = F.lit(False)
        for n in names:
            test = test | F.array_contains(tags, n)
        out = out.when(test, kind)
    first_ioc = F.get(ioc_types, F.lit(0))
    for ioc, kind in TYPE_BY_IOC.items():
        out = out.when(first_ioc == ioc, kind)
    for name, kind in TYPE_BY_RULE:
        out = out.when(F.array_contains(rule_types, name), kind)
    return out.otherwise("security_detection")


def findings(matches: DataFrame) -> DataFrame:
    """One finding per event with a match. A group holds at most one row per rule."""
    context = [c for c in CONTEXT if c in matches.columns]
    item = F.struct("ord", "mitre_techniques", "mitre_tactics", "tags", "ioc_type", "rule_type", "rule_id")
    grouped = matches.groupBy("event_id").agg(
        *[F.any_value(c).alias(c) for c in context], F.max(severity_rank("severity")).alias("_rank"), F.count(F.lit(1)).alias("match_count"),
        F.array_sort(F.collect_list(item)).alias("_i"),
    )
    gather = lambda f: F.array_distinct(F.flatten(F.transform("_i", lambda x: x[f])))
    plain = lambda f: F.filter(F.transform("_i", lambda x: x[f]), lambda x: x.isNotNull())
    return grouped.select(
        F.concat(F.lit("finding_"), F.col("event_id").cast("string")).alias("finding_id"), "event_id",
        finding_type(gather("tags"), plain("ioc_type"), plain("rule_type")).alias("finding_type"),
        severity_name("_rank").alias("severity"), F.lit("high").alias("confidence"), "match_count", *context,
        gather("mitre_techniques").alias("mitre_techniques"), gather("mitre_tactics").alias("mitre_tactics"), plain("rule_id").alias("rule_ids"),
    )


def detection_stats(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Events seen, matches, and events with a match, one row."""
    seen = events.agg(F.count(F.lit(1)).alias("events_processed"), F.lit(0).cast("bigint").alias("matches_found"), F.lit(0).cast("bigint").alias("findings_generated"))
    per_event = matches.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    found = per_event.agg(F.lit(0).cast("bigint").alias("events_processed"), F.coalesce(F.sum("n"), F.lit(0)).alias("matches_found"),
                          F.count(F.lit(1)).alias("findings_generated"))
    return seen.unionByName(found).agg(*[F.sum(c).alias(c) for c in seen.columns])
