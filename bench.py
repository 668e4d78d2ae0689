"""Runs the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Every query is run in full (all rows and columns are produced). The first run of a query is
recorded under ``cold``; ``queries`` holds the second. ``events_per_second`` relates the rows of
the events table to the time of the queries that read it.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "log_brute_force", "log_anomaly_scores", "log_primary_findings", "net_port_scan", "net_exfiltration", "net_beacon_pairs", "net_findings",
    "detect_regex", "detect_sigma", "detect_indicators", "detect_findings", "parse_syslog", "parse_json", "parse_web_access", "ingest_summary", "validate_events",
    "email_findings", "intel_enrich_events", "intel_threat_findings", "kill_chains", "correlate_same_user", "correlations", "alert_priority", "incident_priorities",
    "investigation_summary", "affected_assets", "response_playbooks", "report_sections", "order_statistics", "evaluate_runs", "audit_secrets", "route_events", "top_k_documents",
)


def main() -> None:
    from emberwatch.catalog import QUERIES
    from emberwatch.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("emberwatch-bench", master=f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):  # the settings name none: one machine runs all
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    cold, warm = {}, {}
    for name in names:
        for run in range(repeats):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = round(time.time() - start, 3)
            cold.setdefault(name, took)
            warm[name] = took
    total = round(sum(warm.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": warm, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")),
        "events": events, "events_per_second": {n: round(events / warm[n]) for n in names if n not in ("email_findings", "audit_secrets", "top_k_documents", "order_statistics")},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
