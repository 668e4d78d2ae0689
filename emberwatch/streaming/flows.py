"""Streaming jobs over the batch operators (ST-01 … ST-03, ST-07 … ST-10, EXT-05, SNK-01 … SNK-03)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import intel as T
from ..operators import logs as L
from ..operators import normalize as N
from ..operators.cases import make_alerts
from ..operators.metrics import throughput_windows
from ..sources.sinks import write_dead_letters, write_events
from .state import sliding_alerts


def _start(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool, name: str | None = None):
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _stored(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """Ids and dates that earlier batches have stored."""
    if not _exists(spark, path):
        return None
    return spark.read.schema("event_id string, ingest_batch long, event_date date").parquet(path).filter(F.col("ingest_batch") < batch_id)


def _high_water(spark: SparkSession, path: str, batch_id: int):
    """Largest event time of the batches before this one; none at the start. Marks that cannot be read are an error."""
    if not _exists(spark, path):
        return None
    seen = spark.read.schema("high timestamp, ingest_batch long").parquet(path)
    return seen.filter(F.col("ingest_batch") < batch_id).agg(F.max("high").alias("h")).first()[0]


def split_late(events: DataFrame, high_water, delay_sec: int) -> tuple[DataFrame, DataFrame]:
    """(on time, late) against the largest event time seen before."""
    if high_water is None:
        return events, events.filter(F.lit(False))
    floor = F.unix_micros(F.lit(high_water)) - delay_sec * 1_000_000
    return events.filter(F.unix_micros("timestamp") >= floor), events.filter(F.unix_micros("timestamp") < floor)


def start_ingest(raw: DataFrame, events_path: str, dead_path: str, checkpoint: str, as_of: Column | None = None, delay_sec: int | None = None, marks_path: str | None = None, available_now: bool = False):
    """Payload stream → events and dead letters. Each batch is parsed once and written twice.

    An id is stored once: ids of earlier batches are left out by an anti join that reads the dates at
    hand only, and of these the id column alone.

    With ``delay_sec`` and ``marks_path``, rows older than the largest event time of earlier
    batches by more than the delay go to the dead letters as ``late_event``. Batches overwrite their
    own partitions, so a batch run again after a failure leaves one copy.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = N.ingest(batch, as_of).persist()
        try:
            ok, letters = N.accepted(done), N.dead_letters(done)
            if delay_sec is not None:
                high = _high_water(spark, marks_path, batch_id)
                ok, late = split_late(ok, high, delay_sec)
                letters = letters.unionByName(late.select(
                    F.concat(F.lit("dlq-"), F.substring("event_id", 5, 32)).alias("dead_letter_id"), F.col("ingestion_timestamp").alias("timestamp"), "source", "source_type",
                    F.lit("late_event").alias("error_type"), F.lit("Event is older than the watermark").alias("error_message"), F.col("raw_data").alias("raw_payload")))
                N.accepted(done).agg(F.max("timestamp").alias("high")).withColumn("ingest_batch", F.lit(batch_id)).write.mode("overwrite").option(
                    "partitionOverwriteMode", "dynamic").partitionBy("ingest_batch").parquet(marks_path)
            write_events(ok, events_path, _stored(spark, events_path, batch_id), batch_id)
            write_dead_letters(letters, dead_path, batch_id)
        finally:
            done.unpersist()

    return _start(raw, work, checkpoint, available_now)


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row per event id within the watermark."""
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["event_id"])


def collapsed_alerts(findings: DataFrame, keys: tuple = ("rule_id", "source_ip"), period: str = "60 seconds") -> DataFrame:
    """First alert per rule and entity; repeats within the period are dropped."""
    return findings.withWatermark("timestamp", period).dropDuplicatesWithinWatermark(list(keys))


def start_detection(events: DataFrame, matches_path: str, findings_path: str, checkpoint: str, feed_path: str | None = None, rules=None, available_now: bool = False):
    """Detection per micro-batch; the indicator feed is read anew each time, so changes to it take effect."""

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        feed = spark.read.parquet(feed_path) if feed_path else None
        found = D.detect(batch, feed, rules).persist()
        try:
            put = lambda df, path: df.withColumn("ingest_batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ingest_batch").parquet(path)
            put(found, matches_path)
            put(D.findings(found), findings_path)
        finally:
            found.unpersist()

    return _start(events, work, checkpoint, available_now)


def start_enrichment(events: DataFrame, provider_path: str, providers: list[str], out_path: str, checkpoint: str, available_now: bool = False):
    """Enrichment per micro-batch against the provider table as it is at that moment."""

    def work(batch: DataFrame, batch_id: int) -> None:
        table = batch.sparkSession.read.parquet(provider_path)
        T.enrich_events(batch, table, providers).withColumn("ingest_batch", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("ingest_batch").parquet(out_path)

    return _start(events, work, checkpoint, available_now)


def start_alerts(findings: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False):
    """Alerts of each micro-batch handed to a user function. A failing handler fails the batch, which is then run again."""
    return _start(findings, lambda batch, batch_id: handler(make_alerts(batch), batch_id), checkpoint, available_now)


def brute_force_stream(events: DataFrame, threshold: int = 5, window_sec: int = 60, delay: str = "10 minutes") -> DataFrame:
    failures = L.log_view(events).filter(L.is_auth_failure()).withColumn("tracking_key", L.tracking_key())
    return sliding_alerts(failures, "tracking_key", threshold, window_sec, delay)


def request_rate_stream(events: DataFrame, threshold: int = 100, window_sec: int = 60, delay: str = "10 minutes") -> DataFrame:
    return sliding_alerts(events.filter(F.col("source_ip") != ""), "source_ip", threshold, window_sec, delay)


def live_throughput(events: DataFrame, window_sec: int = 5, delay: str = "1 minute") -> DataFrame:
    return throughput_windows(events.withWatermark("timestamp", delay), window_sec=window_sec)
