"""Correlation of findings over time groups (COR-01 … COR-08)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.severity import severity_rank
from ..plans.blocked import next_instant, ranged, running, same, spanning, tie
from ..session import cut_lineage
from .changelog import page

# Weights of the signals.
WEIGHTS = {"shared_ip": 0.15, "shared_domain": 0.12, "shared_user": 0.15, "temporal_proximity": 0.08, "compatible_threat": 0.05}
PROXIMITY_SEC, COMPATIBLE_SCORE, CONFIDENCE_FACTOR = 300, 0.8, 1.2

# Finding columns or indicator keys per kind of shared value.
SHARED_FIELDS = {"ip": ("source_ip", "dest_ip", "ip"), "domain": ("domain", "hostname"), "user": ("username", "user", "email")}

# Finding types that go together.
COMPATIBLE = {
    "phishing": ("credential_theft", "malware", "social_engineering"), "brute_force": ("credential_theft", "unauthorized_access"),
    "c2_communication": ("malware", "data_exfiltration", "apt"), "data_exfiltration": ("c2_communication", "insider_threat"),
    "ransomware": ("malware", "data_exfiltration"), "lateral_movement": ("credential_theft", "privilege_escalation"),
}

# Words in a finding type → stage of the attack.
CHAIN_WORDS = {
    "initial_access": ("phishing", "exploit", "initial_access", "email"),
    "credential_activity": ("brute_force", "credential", "authentication", "login"),
    "suspicious_activity": ("malware", "suspicious", "anomaly", "threat"),
    "network_activity": ("c2", "network", "lateral", "scan", "exfiltration"),
    "potential_impact": ("ransomware", "impact", "data_breach", "destruction"),
}

def _by_block(keys: list[str], each):
    """Reads rows sorted by ``keys`` and ``_us`` as a stream and gives ``each`` whole blocks: rows and the bounds of the blocks.

    Only the last block of a batch is held until it is known to be whole, and it is never longer than
    the range of rows it was cut from.
    """

    def read(frames):
        import numpy as np
        import pandas as pd

        held, last = [], None
        for frame in frames:
            if not len(frame):
                continue
            cols = [pd.factorize(frame[k], use_na_sentinel=False)[0] for k in keys]
            starts = np.flatnonzero(np.any([np.r_[True, c[1:] != c[:-1]] for c in cols], axis=0))
            key_at = lambda i: tuple(None if pd.isna(frame[k].iat[i]) else frame[k].iat[i] for k in keys)  # two nulls are equal
            if held and key_at(0) != last:
                done = pd.concat(held, ignore_index=True)
                yield each(done, np.array([0, len(done)]))
                held = []
            tail, before = starts[-1], sum(map(len, held))
            if tail:
                whole = pd.concat([*held, frame.iloc[:tail]], ignore_index=True)
                yield each(whole, np.r_[0, starts[1:] + before])
                held = []
            held.append(frame.iloc[tail:])
            last = key_at(tail)
        if held:
            done = pd.concat(held, ignore_index=True)
            yield each(done, np.array([0, len(done)]))

    return read


def _anchors(window_us: int):
    """Anchors of blocks whose first instant is one: the next is the first instant beyond the reach of the last."""

    def walk(rows, bounds):
        import numpy as np

        at, picked = rows["_us"].to_numpy(), []
        for i, hi in zip(bounds[:-1], bounds[1:]):
            while i < hi:
                picked.append(i)
                i += int(np.searchsorted(at[i:hi], at[i] + window_us, side="right"))
        return rows.iloc[picked].rename(columns={"_us": "_anchor"})

    return walk


def _leaving(window_us: int):
    """For every instant of a block, taken as the block's first anchor, the anchor with which the block is left."""

    def leave(rows, bounds):
        import numpy as np

        at, reach = rows["_us"].to_numpy(), np.arange(len(rows))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            step = lo + np.searchsorted(at[lo:hi], at[lo:hi] + window_us, side="right")
            reach[lo:hi] = np.where(step < hi, step, reach[lo:hi])
        while True:  # successors doubled until each points at a last one
            further = reach[reach]
            if np.array_equal(further, reach):
                return rows.assign(_leave=at[reach])
            reach = further

    return leave


def _stream(blocks: DataFrame, by: list[str], each, added: str) -> DataFrame:
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema if added != "_anchor" or f.name != "_us")
    return blocks.repartition(*by).sortWithinPartitions(*by, "_us").mapInPandas(_by_block(by, each), schema=f"{kept}, {added} bigint")


def _entries(blocks: DataFrame, crossing: DataFrame, keys: list[str], window_us: int, partitions: int | None) -> DataFrame:
    """First anchor in each block of the keys that lie in several blocks: keys, _part, _start.

    A block is a map from the instant at which it is entered to the anchor with which it is left, and so to the
    instant at which a later block is entered. These maps are composed by doubling: after n rounds a
    map leads over 2^n blocks, and the entries reached from a key's first instant are known that far.
    """
    within = cut_lineage(blocks.join(F.broadcast(crossing), same(blocks, crossing, {k: k for k in keys}), "left_semi"))
    left = cut_lineage(_stream(within, [*keys, "_part"], _leaving(window_us), "_leave"))
    goals = left.select(*keys, "_leave", (F.col("_leave") + window_us).alias("_goal")).distinct()
    onward = next_instant(within, goals, keys, "_us", "_goal", "_next", after=True, partitions=partitions).filter(F.col("_next").isNotNull()).drop("_goal")
    leads = left.join(onward, same(left, onward, {**{k: k for k in keys}, "_leave": "_leave"})).select(*[left[k] for k in keys], left["_us"], "_next")
    leads = cut_lineage(leads)
    # only instants at which a block can be entered from outside
    firsts = within.groupBy(*keys).agg(F.min("_us").alias("_us"))
    doors = leads.select(*keys, F.col("_next").alias("_us")).unionByName(firsts).distinct()
    leads = cut_lineage(leads.join(doors, same(leads, doors, {c: c for c in [*keys, "_us"]}), "left_semi"))
    reached = cut_lineage(firsts)
    while not leads.isEmpty():
        here = same(reached, leads, {c: c for c in [*keys, "_us"]})
        step = reached.join(leads, here).select(*[reached[k] for k in keys], F.col("_next").alias("_us"))
        reached = cut_lineage(reached.unionByName(step).distinct())
        far = leads.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_us").alias("_mid"), F.col("_next").alias("_far"))
        twice = leads.join(far, same(leads, far, {**{k: f"_k{i}" for i, k in enumerate(keys)}, "_next": "_mid"}))
        leads = cut_lineage(twice.select(*keys, "_us", F.col("_far").alias("_next")))
    entered = within.join(reached, same(within, reached, {c: c for c in [*keys, "_us"]}), "left_semi")
    return entered.groupBy(*keys, "_part").agg(F.min("_us").alias("_start"))


def time_groups(findings: DataFrame, window_minutes: int = 60, key_cols: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Findings with ``group_start``: a group takes all findings within the window of its first one.

    Only the distinct instants matter. They are cut into blocks by ranges of (key, instant), whatever
    the key; a block is walked from its first anchor, which is the key's first instant or comes from the
    blocks before (:func:`_entries`). Groups of one finding are kept here and dropped by
    :func:`correlate`. Findings without a time have no group.
    """
    window_us = window_minutes * 60_000_000
    keys = list(key_cols)
    whole = [] if keys else ["_all"]
    df = findings if keys else findings.withColumn("_all", F.lit(0))
    keys = keys + whole
    instants = df.select(*keys, F.unix_micros("timestamp").alias("_us")).filter(F.col("_us").isNotNull()).distinct()
    blocks = ranged(instants, keys, ["_us"], partitions)
    crossing = cut_lineage(spanning(blocks, keys).drop("_lo").withColumn("_crosses", F.lit(True)))
    walked = blocks
    if not crossing.isEmpty():
        # both sides hold fewer than two rows for each block border
        entries = cut_lineage(_entries(blocks, crossing, keys, window_us, partitions))
        crosses = blocks.join(F.broadcast(crossing), same(blocks, crossing, {k: k for k in keys}), "left").select(*[blocks[c] for c in blocks.columns], "_crosses")
        started = crosses.join(F.broadcast(entries), same(crosses, entries, {c: c for c in [*keys, "_part"]}), "left")
        walked = started.filter(F.col("_crosses").isNull() | (F.col("_us") >= F.col("_start"))).select(*[crosses[c] for c in blocks.columns])
    anchors = _stream(walked, [*keys, "_part"], _anchors(window_us), "_anchor")
    marks = anchors.select(*keys, F.timestamp_micros("_anchor").alias("timestamp"), F.lit(0).alias("_late"), F.timestamp_micros("_anchor").alias("_a"))
    rows = df.withColumns({"_late": F.lit(1), "_a": F.lit(None).cast("timestamp"), "_tie": tie(df)})
    out = running(rows.unionByName(marks, allowMissingColumns=True), keys, ["timestamp", "_late", "_tie"], maxes={"group_start": F.col("_a")}, partitions=partitions)
    return out.filter(F.col("_late") == 1).drop("_late", "_a", "_tie", *whole)


def _valued(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def shared_values(grouped: DataFrame, by: list[str]) -> DataFrame:
    """Values held by every finding of a group: (group, kind, value); lists are spread. Counts, no set is gathered."""
    sizes = grouped.groupBy(*by).agg(F.count_distinct("finding_id").alias("_size"))
    cols = set(grouped.columns)
    items = []
    for kind, fields in SHARED_FIELDS.items():
        for name in fields:
            if name in cols:
                value = F.col(name)
                values = value.cast("array<string>") if isinstance(grouped.schema[name].dataType, T.ArrayType) else F.array(value.cast("string"))
            elif "indicators" in cols:  # a map of texts, or of lists
                values = F.try_element_at("indicators", F.lit(name))
                values = values if isinstance(grouped.schema["indicators"].dataType.valueType, T.ArrayType) else F.array(values)
            else:
                continue
            items.append(F.transform(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit("")) != ""), _valued(kind)))
    rows = grouped.select(*by, "finding_id", F.explode(F.concat(*items)).alias("i")).select(*by, "finding_id", "i.*").distinct()
    held = rows.groupBy(*by, "kind", "value").agg(F.count(F.lit(1)).alias("_held"))
    return held.join(sizes, by).filter(F.col("_held") == F.col("_size")).drop("_held", "_size")


def has_compatible(types: Column) -> Column:
    out = F.lit(False)
    for kind, partners in COMPATIBLE.items():
        out = out | (F.array_contains(types, kind) & F.arrays_overlap(types, F.array(*[F.lit(p) for p in partners])))
    return out


def attack_chain(types: Column) -> Column:
    stages = []
    for stage, words in CHAIN_WORDS.items():
        stages.append(F.when(F.exists(types, _mentioning(words)), stage))
    return F.filter(F.array(*stages), lambda s: s.isNotNull())


def _mentioning(words):
    return lambda text: _mentions(text, words)


def _mentions(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def classify(types: Column) -> Column:
    has = lambda *words: F.exists(types, _mentioning(words))
    return (
        F.when(has("ransomware"), "ransomware_attack")
        .when(has("phishing"), F.when(has("credential", "login"), "credential_phishing").otherwise("phishing_campaign"))
        .when(has("c2", "beacon"), "c2_activity").when(has("exfil", "breach"), "data_exfiltration").when(has("brute"), "brute_force_attack")
        .when(has("lateral"), "lateral_movement").otherwise("suspicious_activity")
    )


def score_groups(grouped: DataFrame, by: list[str], min_score: float = 0.3) -> DataFrame:
    """Score, severity, chain and class of every group of two findings or more.

    Finding types and sources per group are gathered as sets of short names, which the rule and
    agent lists bound; finding ids stay in the grouped table.
    """
    base = grouped.groupBy(*by).agg(
        F.count_distinct("finding_id").alias("finding_count"), F.min("timestamp").alias("time_window_start"), F.max("timestamp").alias("time_window_end"),
        F.max(severity_rank("severity")).alias("_rank"), F.collect_set(F.lower("finding_type")).alias("_types"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    ).filter(F.col("finding_count") >= 2)
    shared = shared_values(grouped, by).groupBy(*by).agg(
        *[F.count_if(F.col("kind") == k).alias(f"shared_{k}s") for k in SHARED_FIELDS])
    df = base.join(shared, by, "left").fillna(0, [f"shared_{k}s" for k in SHARED_FIELDS])
    part = lambda kind: F.least(F.col(f"shared_{kind}s") / 2.0, F.lit(1.0)) * WEIGHTS[f"shared_{kind}"]
    span = (F.unix_micros("time_window_end") - F.unix_micros("time_window_start")) / 1e6
    near = F.when(span < PROXIMITY_SEC, WEIGHTS["temporal_proximity"] * (1.0 - span / PROXIMITY_SEC)).otherwise(0.0)
    together = F.when(has_compatible(F.col("_types")), WEIGHTS["compatible_threat"] * COMPATIBLE_SCORE).otherwise(0.0)
    df = df.withColumns({"correlation_score": part("ip") + part("domain") + part("user") + near + together, "attack_chain": attack_chain(F.col("_types")),
                         "classification": classify(F.col("_types"))})
    df = df.withColumn("confidence", F.least(F.col("correlation_score") * CONFIDENCE_FACTOR, F.lit(1.0))).filter(F.col("correlation_score") >= min_score)
    severity = F.when(F.col("_rank") >= 4, "critical").when(F.col("_rank") == 3, "high").when(F.col("_rank") == 2, "medium").otherwise("low")
    noted = F.concat_ws(", ", *[F.when(F.col(f"shared_{k}s") > 0, F.concat(F.col(f"shared_{k}s").cast("string"), F.lit(f" shared {k}(s)"))) for k in SHARED_FIELDS])
    reason = F.concat_ws(
        " ", F.format_string("Correlated %d findings from %d sources.", F.col("finding_count"), F.size("sources")),
        F.when(noted != "", F.concat(F.lit("Shared indicators: "), noted, F.lit("."))),
        F.when(F.size("attack_chain") > 0, F.concat(F.lit("Attack chain stages: "), F.array_join(F.transform("attack_chain", lambda s: F.replace(s, F.lit("_"), F.lit(" "))), " → "), F.lit("."))),
        F.format_string("Correlation score: %.2f, confidence: %.2f.", F.col("correlation_score"), F.col("confidence")))
    return df.select(*by, F.concat_ws("_", F.lit("corr"), *[F.col(c).cast("string") for c in by]).alias("correlation_id"), "finding_count", "time_window_start",
                     "time_window_end", *[f"shared_{k}s" for k in SHARED_FIELDS], "correlation_score", "confidence", severity.alias("severity"), "attack_chain",
                     "classification", "sources", reason.alias("reasoning"))


def correlate(findings: DataFrame, window_minutes: int = 60, min_score: float = 0.3, key_cols: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    grouped = cut_lineage(time_groups(findings, window_minutes, key_cols, partitions))
    return score_groups(grouped, [*key_cols, "group_start"], min_score)


def correlation_by_id(correlations: DataFrame, correlation_id: str) -> DataFrame:
    return correlations.filter(F.col("correlation_id") == correlation_id)


def recent_correlations(correlations: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first."""
    return page(correlations, [F.col("time_window_end").desc(), F.col("correlation_id")], limit)
