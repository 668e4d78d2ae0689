"""Metrics and evaluation (MET-01 … MET-08, EVL-01 … EVL-03)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.blocked import sliding_sums
from ..plans.bounds import before
from .changelog import counts_by

# Upper bounds of the latency histogram, seconds.
LATENCY_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
#: bins of one pass of the order statistics
BINS = 4096
EPS_WINDOW_SEC, ERROR_WINDOW_SEC, LATENCY_SAMPLES = 5, 60, 1000


def ingest_snapshot(ingested: DataFrame) -> DataFrame:
    """(dimension, value, n, rate): totals, acceptance in percent, accepted events by source type and severity."""
    ok = F.col("error_type").isNull()
    totals = ingested.agg(F.count(F.lit(1)).alias("events_received"), F.count_if(ok).alias("events_accepted"), F.count_if(~ok).alias("events_rejected"))
    rate = F.bround(F.col("events_accepted") / F.greatest("events_received", F.lit(1)) * 100, 2)
    rows = totals.select(F.inline(F.array(*[
        F.struct(F.lit("total").alias("dimension"), F.lit(c).alias("value"), F.col(c).alias("n"), F.when(F.lit(c == "events_accepted"), rate).alias("rate")) for c in totals.columns])))
    by = counts_by(ingested.filter(ok), "source_type", "severity").filter(F.col("dimension") != "total")
    return rows.unionByName(by.withColumn("rate", F.lit(None).cast("double")))


def events_per_second(events: DataFrame, as_of: Column, ts: str = "timestamp", window_sec: int = EPS_WINDOW_SEC) -> DataFrame:
    """Rate over the window that ends at ``as_of``; the bounds reach the scan."""
    recent = events.filter(F.col(ts).between(before(events, ts, as_of, window_sec), before(events, ts, as_of)))
    return recent.agg(F.bround(F.count(F.lit(1)) / float(window_sec), 2).alias("events_per_second"))


def throughput_windows(events: DataFrame, ts: str = "timestamp", window_sec: int = EPS_WINDOW_SEC) -> DataFrame:
    """Rate per tumbling window; the same plan runs on a stream."""
    return events.groupBy(F.window(ts, f"{window_sec} seconds").alias("w")).agg(F.count(F.lit(1)).alias("events")).select(
        F.col("w.start").alias("window_start"), "events", (F.col("events") / float(window_sec)).alias("events_per_second"))


def order_statistics(df: DataFrame, value: str, shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Exact nearest-rank statistics ``sorted[min(int(n * p), n - 1)]``, one row.

    A sketch brackets each rank. A bracket is then counted in ``BINS`` equal bins, combined before the
    shuffle, and narrowed to the least and greatest value of the bin that holds the rank, until these
    are one value. Nothing is sorted, and a pass brings back one row per bin that has rows.
    """
    base = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    eps = 3.0 / accuracy
    ends = [F.percentile_approx("v", F.array(*[F.lit(min(max(p + s * eps, 0.0), 1.0)) for p in shares.values()]), F.lit(accuracy)) for s in (-1, 1)]
    frame = base.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), ends[0].alias("from"), ends[1].alias("to")).first()
    n = frame["n"]
    # per share: rank, bracket, rows known to lie below it (None: not counted yet)
    open_, done = {}, dict.fromkeys(shares)
    for i, (name, p) in enumerate(shares.items()):
        if n:
            lo = frame["lo"] if p - eps <= 0 else frame["from"][i]
            hi = frame["hi"] if p + eps >= 1 else frame["to"][i]
            open_[name] = (min(math.floor(n * p), n - 1), lo, hi, None)
    while open_:
        marks = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for name, (_, lo, hi, _) in open_.items()])
        spread = base.select("v", F.explode(F.filter(marks, lambda m: F.col("v") <= m["hi"])).alias("m"))
        place = F.floor((F.col("v") - F.col("m.lo")) / (F.col("m.hi") - F.col("m.lo")) * BINS)
        place = F.when(F.col("v") < F.col("m.lo"), -1).when(F.col("m.hi") > F.col("m.lo"), F.least(F.greatest(place, F.lit(0)), F.lit(BINS))).otherwise(0)
        counted = spread.groupBy(F.col("m.name").alias("name"), place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        bins = sorted(counted.collect(), key=lambda r: (r["name"], r["bin"]))  # BINS + 2 rows a share at most
        for name, (rank, lo, hi, _) in list(open_.items()):
            seen = 0
            for r in (r for r in bins if r["name"] == name):
                if seen + r["c"] > rank:
                    if r["bin"] < 0:  # the sketch was off: the rank lies below the bracket
                        open_[name] = (rank, frame["lo"], r["hi"], None)
                    elif r["lo"] == r["hi"] or (r["lo"], r["hi"]) == (lo, hi) and not r["hi"] - r["lo"] < float("inf"):
                        done[name] = r["lo"]
                        del open_[name]
                    else:
                        open_[name] = (rank, r["lo"], r["hi"], seen)
                    break
                seen += r["c"]
            else:  # or above it
                open_[name] = (rank, lo, frame["hi"], None)
    return df.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(name) for name, v in done.items()])


def _joined(one: DataFrame, other: DataFrame, names: list[str]) -> DataFrame:
    """Two one-row frames side by side."""
    return one.withColumns({n: other.select(n).scalar() for n in names})


def latency_stats(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value).cast("double")
    zero = lambda c: F.bround(F.coalesce(c, F.lit(0.0)), 3)
    base = df.agg(zero(F.avg(v)).alias("avg_ms"), zero(F.min(v)).alias("min_ms"), zero(F.max(v)).alias("max_ms"))
    p = order_statistics(df, value, {"p95_ms": 0.95, "p99_ms": 0.99})
    p = p.select(*[zero(F.col(c)).alias(c) for c in p.columns])
    return _joined(base, p, ["p95_ms", "p99_ms"])


def recent_latency(df: DataFrame, value: str, ts: str, tie: str, samples: int = LATENCY_SAMPLES) -> DataFrame:
    """Variant over the newest samples: below 20 (100) samples p95 (p99) is the maximum. The sample size is the feature."""
    last = df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(samples).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("s"))
    n = F.size("s")
    at = lambda p: F.get("s", F.floor(n * F.lit(p)).cast("int"))
    top = F.element_at("s", -1)
    return last.select(
        (F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / n).alias("avg_latency_ms"), F.get("s", F.floor(n / 2).cast("int")).alias("p50_latency_ms"),
        F.when(n >= 20, at(0.95)).otherwise(top).alias("p95_latency_ms"), F.when(n >= 100, at(0.99)).otherwise(top).alias("p99_latency_ms"), top.alias("max_latency_ms"))


def performance_profile(df: DataFrame, value: str, duration_seconds: float, is_error: Column) -> DataFrame:
    n = F.count(F.lit(1))
    base = df.agg(
        n.alias("total_events"), (n / float(duration_seconds) if duration_seconds > 0 else F.lit(0.0)).alias("events_per_second"), F.avg(value).alias("avg_latency_ms"),
        F.max(F.col(value).cast("double")).alias("max_latency_ms"), F.coalesce(F.count_if(is_error) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("error_rate"))
    p = order_statistics(df, value, {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95, "p99_latency_ms": 0.99})
    return _joined(base, p, p.columns)


def recent_error_rate(df: DataFrame, as_of: Column, is_error: Column, ts: str = "timestamp", window_sec: int = ERROR_WINDOW_SEC) -> DataFrame:
    recent = df.filter(F.col(ts) > before(df, ts, as_of, window_sec))
    n = F.count(F.lit(1))
    return recent.agg(n.alias("samples"), F.coalesce(F.count_if(is_error) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("error_rate"))


def mean_throughput(df: DataFrame, count: Column, ts: str = "timestamp") -> DataFrame:
    span = (F.max(F.unix_micros(ts)) - F.min(F.unix_micros(ts))) / 1e6
    return df.agg(F.when(span > 0, F.sum(count) / span).otherwise(0.0).alias("ops_per_second"))


def latency_histogram(df: DataFrame, seconds: Column, *labels: str) -> DataFrame:
    """Cumulative bucket counts per label set, plus the open bucket, total and sum."""
    out = df.groupBy(*labels).agg(
        *[F.count_if(seconds <= b).alias(f"_b{i}") for i, b in enumerate(LATENCY_BOUNDS)], F.count(seconds).alias("_n"), F.sum(seconds).alias("_s"))
    items = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("cumulative_count")) for i, b in enumerate(LATENCY_BOUNDS)]
    items.append(F.struct(F.lit("+Inf").alias("le"), F.col("_n").alias("cumulative_count")))
    return out.select(*labels, F.inline(F.array(*items)))


def counters(df: DataFrame, *labels: str) -> DataFrame:
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("total"))


def quota_checks(log: DataFrame, identifier: str, limit: int, ts: str = "timestamp", window_sec: int = 60) -> DataFrame:
    """Requests in the sliding window per identifier at each request; an entry exactly one window old has left it."""
    rows = sliding_sums(log, [identifier], ts, window_sec, {"current_count": F.lit(1)}, open_start=True)
    return rows.withColumns({"is_allowed": F.col("current_count") <= limit, "remaining": F.greatest(F.lit(limit) - F.col("current_count"), F.lit(0))})


def confusion(df: DataFrame, predicted: Column, actual: Column, *keys: str) -> DataFrame:
    """Confusion matrix and derived rates per key; an empty denominator gives 0."""
    tp, fp, tn, fn = (F.count_if(t).cast("bigint") for t in (predicted & actual, predicted & ~actual, ~predicted & ~actual, ~predicted & actual))
    m = df.groupBy(*keys).agg(tp.alias("true_positives"), fp.alias("false_positives"), tn.alias("true_negatives"), fn.alias("false_negatives"))
    return with_rates(m)


def with_rates(m: DataFrame) -> DataFrame:
    c = F.col
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    total = c("true_positives") + c("false_positives") + c("true_negatives") + c("false_negatives")
    m = m.withColumns({
        "precision": ratio(c("true_positives"), c("true_positives") + c("false_positives")), "recall": ratio(c("true_positives"), c("true_positives") + c("false_negatives")),
        "accuracy": ratio(c("true_positives") + c("true_negatives"), total), "false_positive_rate": ratio(c("false_positives"), c("false_positives") + c("true_negatives")),
        "false_negative_rate": ratio(c("false_negatives"), c("false_negatives") + c("true_positives"))})
    return m.withColumn("f1_score", ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")))


def evaluate_runs(labels: DataFrame, detections: DataFrame) -> DataFrame:
    """Runs evaluated from labels (run_id, event_id, expected, processed_at, latency_ms) and detections (run_id, event_id)."""
    hit = detections.select("run_id", "event_id").distinct().withColumn("_hit", F.lit(True))
    joined = labels.join(hit, ["run_id", "event_id"], "full")
    predicted, actual = F.coalesce("_hit", F.lit(False)), F.coalesce("expected", F.lit(False))
    seen = F.col("expected").isNotNull()
    span = (F.max(F.unix_micros("processed_at")) - F.min(F.unix_micros("processed_at"))) / 1e6
    n = F.count_if(seen)
    m = joined.groupBy("run_id").agg(
        F.count_if(predicted & actual).alias("true_positives"), F.count_if(predicted & ~actual).alias("false_positives"), F.count_if(~predicted & ~actual).alias("true_negatives"),
        F.count_if(~predicted & actual).alias("false_negatives"), n.alias("events_processed"), F.count_if(predicted).alias("detections_count"),
        F.when(span > 0, n / span).otherwise(0.0).alias("throughput_eps"), F.coalesce(F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))), F.lit(0.0)).alias("avg_latency_ms"))
    return with_rates(m)


def evaluation_report(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count(F.lit(1)).alias("total_runs"), F.sum("events_processed").alias("total_events_processed"), F.sum("detections_count").alias("total_detections"),
        F.avg("precision").alias("avg_precision"), F.avg("recall").alias("avg_recall"), F.avg("f1_score").alias("avg_f1_score"), F.avg("throughput_eps").alias("avg_throughput_eps"))
