"""Sinks (SNK-01 … SNK-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.bounds import before


def stored_form(events: DataFrame) -> DataFrame:
    """Event rows as stored: plain text payloads wrapped as JSON, metadata as JSON text."""
    raw = F.when(F.try_parse_json("raw_data").isNotNull() & F.trim("raw_data").startswith("{"), F.col("raw_data")).otherwise(F.to_json(F.struct(F.col("raw_data").alias("raw"))))
    return events.withColumns({"raw_data": raw, "metadata_payload": F.to_json("metadata"), "event_date": F.to_date("timestamp")}).drop("metadata")


def write_events(events: DataFrame, path: str, known: DataFrame | None = None, batch_id: int | None = None) -> None:
    """Insert events once per id, by date.

    Duplicates inside the input are dropped; ids in ``known`` are left out by an anti join limited
    to the dates at hand. Files are levelled by size, so a heavy day becomes many. A streaming batch overwrites only its own partitions, so a replay is harmless.
    """
    rows = stored_form(events).dropDuplicates(["event_id"])
    if known is not None:
        rows = rows.join(known.select("event_id", "event_date"), ["event_date", "event_id"], "left_anti")
    if batch_id is None:
        rows.hint("rebalance", "event_date").sortWithinPartitions("event_date", "severity", "event_type").write.mode("append").partitionBy("event_date").parquet(path)
    else:
        rows.withColumn("ingest_batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ingest_batch", "event_date").parquet(path)


def write_dead_letters(letters: DataFrame, path: str, batch_id: int | None = None) -> None:
    if batch_id is None:
        letters.write.mode("append").partitionBy("error_type").parquet(path)
    else:
        letters.withColumn("ingest_batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ingest_batch", "error_type").parquet(path)


def messages(df: DataFrame, key: str, headers: dict[str, Column] | None = None) -> DataFrame:
    """Rows as messages: text key, JSON value, optional headers."""
    cols = [F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value")]
    if headers:
        cols.append(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("binary").alias("value")) for k, v in headers.items()]).alias("headers"))
    return df.select(*cols)


def publish(df: DataFrame, key: str, topic: str | None = None, servers: str | None = None, path: str | None = None, headers: dict[str, Column] | None = None) -> None:
    """Send rows to a topic, or to a folder when a path is given."""
    out = messages(df, key, headers)
    if path is not None:
        out.write.mode("append").parquet(path)
    else:
        out.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("includeHeaders", bool(headers)).save()


def fan_out(tasks: DataFrame, path: str) -> None:
    """Task rows split by agent type, so each consumer reads its own folder."""
    tasks.write.mode("append").partitionBy("agent_type").parquet(path)


def recent_events(events: DataFrame, as_of: Column | None = None, ttl_seconds: int = 3600) -> DataFrame:
    """Six columns of the events ingested within the time to live."""
    now = F.current_timestamp() if as_of is None else as_of
    at = "ingestion_timestamp"
    return events.filter(F.col(at).between(before(events, at, now, ttl_seconds), before(events, at, now))).select("event_id", "timestamp", "source", "source_type", "event_type", "severity")
