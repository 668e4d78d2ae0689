"""Network threat analytics (NET-01 … NET-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.network import is_external, is_private
from ..functions.severity import lookup, severity_name, severity_rank
from ..functions.text import entropy
from ..plans.blocked import running, running_distinct
from ..plans.fence import once
from ..session import cut_lineage

# Ports, agents and endings tied to command-and-control traffic.
C2_PORTS = (443, 8443, 4443, 8080, 8888, 1337, 31337, 6667, 6697)
C2_PROTOCOLS = ("tcp", "https", "ssl")
C2_USER_AGENTS = ("mozilla/4.0", "python-requests", "curl", "wget", "powershell")
C2_TLDS = (".tk", ".ml", ".ga", ".cf", ".gq", ".xyz", ".top", ".work")

# Administrative services.
ADMIN_PORTS = {22: "SSH", 23: "Telnet", 135: "RPC", 139: "NetBIOS", 445: "SMB", 3389: "RDP", 5985: "WinRM-HTTP", 5986: "WinRM-HTTPS"}

# Techniques and tactics per threat.
MITRE = {
    "c2_communication": (("T1071", "T1573"), ("command-and-control",)),
    "port_scan": (("T1046",), ("discovery",)),
    "data_exfiltration": (("T1048",), ("exfiltration",)),
    "lateral_movement": (("T1021",), ("lateral-movement",)),
    "dns_tunneling": (("T1071.004",), ("command-and-control",)),
    "beaconing": (("T1071",), ("command-and-control",)),
}

# Default thresholds.
PORT_SCAN_PORTS, EXFIL_BYTES = 10, 10_000_000
BEACON_EVENTS, BEACON_GAPS, BEACON_VARIATION = 5, 3, 0.1
DNS_SUBDOMAIN_LENGTH, DNS_ENTROPY = 50, 3.5

PAIR = ["source_ip", "destination_ip"]
ORDER = ["timestamp", "event_id"]


def service_name(port: Column | str) -> Column:
    port = F.col(port) if isinstance(port, str) else port
    return lookup(port, ADMIN_PORTS, F.concat(F.lit("port-"), port.cast("string")))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def c2_port() -> Column:
    return F.coalesce(F.col("destination_port").isin(*C2_PORTS) & F.lower(_text("protocol")).isin(*C2_PROTOCOLS), F.lit(False))


def c2_agent() -> Column:
    test = F.lit(False)
    for word in C2_USER_AGENTS:
        test = test | F.lower(_text("user_agent")).contains(word)
    return test


def c2_domain() -> Column:
    test = F.lit(False)
    for tld in C2_TLDS:
        test = test | F.lower(_text("domain")).endswith(tld)
    return test


def dns_subdomain_length() -> Column:
    """Length of everything before the last two labels; 0 for short names."""
    labels = F.split(_text("dns_query"), r"\.")
    n = F.size(labels)
    return F.when(n > 2, F.length(F.array_join(F.slice(labels, 1, F.greatest(n - 2, F.lit(0))), "."))).otherwise(0)


def lateral() -> Column:
    return F.coalesce(is_private("source_ip") & is_private("destination_ip") & F.col("destination_port").isin(*ADMIN_PORTS), F.lit(False))


def port_scans(flows: DataFrame, threshold: int = PORT_SCAN_PORTS) -> DataFrame:
    """Events at which their pair has touched ``threshold`` or more distinct ports so far."""
    rows = flows.filter((_text("source_ip") != "") & (F.coalesce("destination_port", F.lit(0)) != 0)).select(*ORDER, *PAIR, "destination_port")
    return running_distinct(rows, PAIR, "destination_port", ORDER, "unique_ports").filter(F.col("unique_ports") >= threshold)


def sent_bytes(flows: DataFrame) -> Column:
    """Bytes sent by a flow: ``bytes_out``, or ``bytes_sent`` where that is empty."""
    names = [F.nullif(F.col(n), F.lit(0)) for n in ("bytes_out", "bytes_sent") if n in flows.columns]
    return F.coalesce(*names, F.lit(0))


def exfiltration(flows: DataFrame, threshold: int = EXFIL_BYTES) -> DataFrame:
    """Events at which the bytes sent by a pair to an outside address reach ``threshold``."""
    sent = sent_bytes(flows)
    rows = flows.filter((_text("source_ip") != "") & (sent != 0) & is_external("destination_ip")).select(*ORDER, *PAIR, sent.alias("_sent"))
    # the address test is not light, and dealing by ranges looks at its input twice
    return running(cut_lineage(rows), PAIR, ORDER, sums={"bytes_transferred": F.col("_sent")}).filter(
        F.col("bytes_transferred") >= threshold
    )


def _gaps(flows: DataFrame) -> DataFrame:
    rows = flows.filter((_text("source_ip") != "") & (_text("destination_ip") != "") & F.col("timestamp").isNotNull()).select(*ORDER, *PAIR)
    rows = running(rows, PAIR, ORDER, previous={"_prev": F.col("timestamp")})
    gap = (F.unix_micros("timestamp") - F.unix_micros("_prev")) / 1e6
    return rows.withColumn("gap", F.when(gap > 0, gap)).drop("_prev")


def beacon_pairs(flows: DataFrame, tolerance: float = BEACON_VARIATION, min_events: int = BEACON_EVENTS) -> DataFrame:
    """Pairs that talk at regular intervals, one row per pair over the whole table."""
    stats = _gaps(flows).groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("connection_count"), F.count("gap").alias("gap_count"),
        F.avg("gap").alias("avg_interval_sec"), F.stddev_pop("gap").alias("_sd"),
    )
    stats = stats.withColumn("variation", F.col("_sd") / F.col("avg_interval_sec")).drop("_sd")
    return stats.filter((F.col("connection_count") >= min_events) & (F.col("gap_count") >= BEACON_GAPS) & (F.col("variation") < tolerance))


def beacons(flows: DataFrame, tolerance: float = BEACON_VARIATION, min_events: int = BEACON_EVENTS) -> DataFrame:
    """Running form: events at which the intervals of their pair so far are regular."""
    gap = F.col("gap")
    rows = running(
        _gaps(flows), PAIR, ORDER,
        sums={"connection_count": F.lit(1), "gap_count": gap.isNotNull().cast("int"), "_sum": gap, "_square": gap * gap},
    )
    mean = F.col("_sum") / F.when(F.col("gap_count") > 0, F.col("gap_count"))
    variance = F.greatest(F.col("_square") / F.when(F.col("gap_count") > 0, F.col("gap_count")) - mean * mean, F.lit(0.0))
    rows = rows.withColumns({"avg_interval_sec": mean, "variation": F.sqrt(variance) / mean}).drop("_sum", "_square", "gap")
    return rows.filter((F.col("connection_count") >= min_events) & (F.col("gap_count") >= BEACON_GAPS) & (F.col("variation") < tolerance))


def _indicator(kind: str, text: Column | str, severity: str, confidence: str, contribution: float,
               source: bool = False, dest: bool = True, port: bool = False) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(kind).alias("indicator_type"), (F.lit(text) if isinstance(text, str) else text).alias("description"),
        F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), F.lit(contribution).alias("risk_contribution"),
        (F.col("source_ip") if source else none).cast("string").alias("source_ip"), (F.col("destination_ip") if dest else none).cast("string").alias("destination_ip"),
        (F.col("destination_port") if port else none).cast("int").alias("destination_port"), (F.lower("protocol") if port else none).cast("string").alias("protocol"),
    )


def _listed(*items: tuple[Column, Column]) -> Column:
    return F.filter(F.array(*[F.when(test, ind) for test, ind in items]), lambda x: x.isNotNull())


def flow_indicators() -> Column:
    """Indicators that need only the event itself, in check order."""
    port = F.col("destination_port").cast("string")
    return _listed(
        (c2_port(), _indicator("c2_communication", F.concat(F.lit("Connection to known C2 port "), port), "high", "medium", 0.3, port=True)),
        (c2_agent(), _indicator("c2_communication", "Suspicious user agent detected", "medium", "medium", 0.2)),
        (c2_domain(), _indicator("c2_communication", "Connection to suspicious TLD", "medium", "medium", 0.25)),
        (dns_subdomain_length() > DNS_SUBDOMAIN_LENGTH,
         _indicator("dns_tunneling", "Unusually long DNS subdomain (possible tunneling)", "high", "medium", 0.3, dest=False)),
        ((_text("dns_query") != "") & (entropy("dns_query") > DNS_ENTROPY),
         _indicator("dns_tunneling", "High entropy DNS query (possible tunneling)", "medium", "medium", 0.25, dest=False)),
        (lateral(), _indicator("lateral_movement", F.concat(F.lit("Internal connection on administrative port "), port), "medium", "medium", 0.2, source=True, port=True)),
    )


# Order in which the checks run.
CHECK_ORDER = ("c2_communication", "port_scan", "data_exfiltration", "dns_tunneling", "beaconing", "lateral_movement")


def network_indicators(flows: DataFrame, port_threshold: int = PORT_SCAN_PORTS, byte_threshold: int = EXFIL_BYTES) -> DataFrame:
    """Flows with all their indicators, those that need history included.

    The history checks yield few rows; they are keyed by event id, brought together and joined once.
    """
    mark = lambda df, kind, text, sev, conf, c: df.select("event_id", _history(kind, text, sev, conf, c).alias("i"))
    # the few columns that the history checks read, stored once for all of them
    seen = cut_lineage(flows.select(*ORDER, *PAIR, "destination_port", *[c for c in ("bytes_out", "bytes_sent") if c in flows.columns]))
    history = (
        mark(port_scans(seen, port_threshold), "port_scan", F.format_string("Port scan detected: %d unique ports", F.col("unique_ports")), "medium", "high", 0.25)
        .unionByName(mark(exfiltration(seen, byte_threshold), "data_exfiltration", F.lit("Large data transfer to external destination"), "high", "medium", 0.35))
        .unionByName(mark(beacons(seen), "beaconing", F.lit("Regular interval connections detected (beaconing)"), "high", "high", 0.4))
    )
    # at most three rows per event
    history = history.groupBy("event_id").agg(F.collect_list("i").alias("_history"))
    with_own = once(flows.withColumn("_own", flow_indicators()))
    none = F.array().cast(history.schema["_history"].dataType)
    position = F.array(*[F.lit(k) for k in CHECK_ORDER])
    merged = F.concat("_own", F.coalesce("_history", none))
    ordered = F.array_sort(
        F.transform(merged, lambda x, i: F.struct(F.array_position(position, x["indicator_type"]).alias("p"), i.alias("i"), x.alias("x")))
    )
    joined = with_own.join(history, "event_id", "left")
    return joined.withColumn("indicators", F.transform(ordered, lambda s: s["x"])).drop("_own", "_history")


def _history(kind: str, text: Column, severity: str, confidence: str, contribution: float) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(kind).alias("indicator_type"), text.alias("description"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"),
        F.lit(contribution).alias("risk_contribution"), F.col("source_ip"), F.col("destination_ip"),
        none.cast("int").alias("destination_port"), none.cast("string").alias("protocol"),
    )


def risk_score(indicators: Column | str) -> Column:
    items = F.col(indicators) if isinstance(indicators, str) else indicators
    return F.least(F.aggregate(items, F.lit(0.0), lambda a, x: a + x["risk_contribution"]), F.lit(1.0))


def primary_threat(indicators: Column | str) -> Column:
    """Most severe kind, then the largest contribution, then check order."""
    items = F.col(indicators) if isinstance(indicators, str) else indicators
    ranked = F.transform(items, lambda x, i: F.struct(
        (-severity_rank(x["severity"])).alias("r"), (-x["risk_contribution"]).alias("c"), i.alias("i"), x["indicator_type"].alias("k")))
    return F.array_min(ranked)["k"]


def network_findings(with_indicators: DataFrame) -> DataFrame:
    """One finding per flow that has an indicator."""
    items = F.col("indicators")
    gather = lambda f: F.array_sort(F.array_distinct(F.filter(F.transform(items, lambda x: x[f]), lambda v: v.isNotNull())))
    base = with_indicators.filter(F.size("indicators") > 0).withColumn("threat_type", primary_threat("indicators"))
    mitre = lambda i: F.when(F.lit(False), F.array().cast("array<string>"))
    techniques, tactics = mitre(0), mitre(1)
    for kind, (tech, tac) in MITRE.items():
        techniques = techniques.when(F.col("threat_type") == kind, F.array(*[F.lit(t) for t in tech]))
        tactics = tactics.when(F.col("threat_type") == kind, F.array(*[F.lit(t) for t in tac]))
    top = F.array_max(F.transform(items, lambda x: severity_rank(x["severity"])))
    return base.select(
        F.concat(F.lit("network_"), F.col("event_id").cast("string")).alias("finding_id"), F.lit("network_threat_analysis").alias("finding_type"),
        "event_id", "timestamp", severity_name(F.greatest(top, F.lit(1))).alias("severity"),
        F.when(F.size(items) > 2, "high").otherwise("medium").alias("confidence"), "threat_type", risk_score("indicators").alias("risk_score"),
        gather("source_ip").alias("source_ips"), gather("destination_ip").alias("destination_ips"), gather("destination_port").alias("ports"),
        gather("protocol").alias("protocols"),
        (F.coalesce("bytes_out", F.lit(0)) + F.coalesce("bytes_in", F.lit(0))).alias("bytes_transferred"), F.size(items).alias("indicator_count"),
        F.concat(F.lit("Network threat detected: "), F.col("threat_type")).alias("explanation"),
        techniques.alias("mitre_techniques"), tactics.alias("mitre_tactics"), "indicators",
    )
