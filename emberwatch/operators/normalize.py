"""Parsed fields → canonical events and dead letters (NRM-01 … NRM-04, VAL-02 … VAL-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .changelog import page
from .parse import Format, parse_payloads

# Version of the common schema the event block follows.
ECS_VERSION = "8.11.0"

# Longest text each column takes.
MAX_LENGTH = {
    "source": 128, "source_type": 64, "event_type": 128, "username": 128, "hostname": 255,
    "domain": 255, "hash": 128, "protocol": 32, "action": 64, "status": 64,
}

EVENT_COLUMNS = (
    "event_id", "timestamp", "source", "source_type", "event_type", "severity", "raw_data", "normalized_data",
    "source_ip", "destination_ip", "source_port", "destination_port", "username", "hostname", "domain", "url",
    "hash", "protocol", "action", "status", "asset_id", "metadata", "parser_version", "ingestion_timestamp",
)


def ecs_block() -> Column:
    """Common-schema JSON; blocks without content are left out."""
    col = F.col
    given = lambda *names: F.coalesce(*[col(n).cast("string") for n in names]).isNotNull()
    end = lambda side: F.when(
        given(f"{side}_ip", f"{side}_port"), F.struct(col(f"{side}_ip").alias("ip"), col(f"{side}_port").alias("port"))
    )
    proto = F.lower(col("protocol"))
    block = F.struct(
        F.lit(ECS_VERSION).alias("ecs_version"),
        F.struct(
            F.lit("event").alias("kind"), F.array("format").alias("category"), F.array("event_type").alias("type"),
            F.coalesce("action", F.lit("unknown")).alias("action"), F.coalesce("status", F.lit("unknown")).alias("outcome"),
        ).alias("event"),
        F.when(
            given("source_ip", "destination_ip", "source_port", "destination_port", "protocol"),
            F.struct(proto.alias("transport"), proto.alias("protocol"), end("source").alias("source"), end("destination").alias("destination")),
        ).alias("network"),
        F.when(given("hostname"), F.struct(col("hostname"), col("hostname").alias("name"))).alias("host"),
        F.when(given("username", "domain"), F.struct(col("username").alias("name"), col("domain"))).alias("user"),
        F.when(given("url"), F.struct(col("url").alias("original"))).alias("url"),
        F.when(given("hash"), F.struct(F.struct(col("hash").alias("sha256")).alias("hash"))).alias("file"),
        F.when(
            col("format") == "suricata",
            F.struct(
                F.try_element_at("metadata", F.lit("signature")).alias("signature"),
                F.try_element_at("metadata", F.lit("category")).alias("category"), col("action"), col("protocol"),
            ),
        ).alias("suricata"),
    )
    return F.to_json(block)


def demo_tags() -> Column:
    """Marks of generated data, added to the metadata and never overwriting it."""
    v = F.col("_v")
    text_demo = ~F.col("_object") & F.col("raw").contains("DEMONSTRATION")
    env = F.when(F.col("_object"), X.not_blank(X.literal_key(v, "environment"))).when(text_demo, "DEMONSTRATION")
    synthetic = F.when(
        F.when(F.col("_object"), F.lower(X.literal_key(v, "synthetic")) == "true").otherwise(text_demo), "true"
    )
    added = F.map_filter(
        F.create_map(F.lit("environment"), env, F.lit("synthetic"), synthetic, F.lit("parser_name"), F.col("parser_name")),
        lambda k, x: x.isNotNull(),
    )
    own = F.map_filter("metadata", lambda k, x: k != "parser_name")
    fresh = F.map_filter(added, lambda k, x: ~F.map_contains_key(own, k))
    return F.map_concat(own, fresh)


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """Reproducible id from the row's own content, so a replay names the same thing."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32))


def ingest(raw: DataFrame, as_of: Column | None = None, formats: dict[str, Column | Format] | None = None) -> DataFrame:
    """Raw payloads → canonical columns plus ``error_type`` / ``error_message`` (null when accepted).

    One pass without a shuffle; split it with :func:`accepted` and :func:`dead_letters`.
    ``raw`` may carry ``source_position`` (offset, or file and line) to tell equal payloads apart.
    """
    now = F.current_timestamp() if as_of is None else as_of
    parsed = parse_payloads(raw, as_of, formats)
    position = F.col("source_position").cast("string") if "source_position" in raw.columns else F.lit("")
    bad_length = F.filter(
        F.array(*[F.when(F.length(c) > n, F.lit(c)) for c, n in MAX_LENGTH.items()]), lambda c: c.isNotNull()
    )
    error_type = (
        F.when(F.col("format") == "unknown", "unknown_source_format")
        .when(F.col("parse_error").isNotNull(), "parsing_exception")
        .when(F.size(bad_length) > 0, "normalization_exception")
    )
    error_message = (
        F.when(F.col("format") == "unknown", "Could not auto-detect telemetry source format")
        .when(F.col("parse_error").isNotNull(), F.col("parse_error"))
        .when(F.size(bad_length) > 0, F.concat(F.lit("Normalization exception: too long: "), F.array_join(bad_length, ", ")))
    )
    keep = [c for c in raw.columns if c not in ("raw", "source_type", "payload_kind")]
    return parsed.select(
        *keep,
        stable_id("evt_", F.coalesce("source", F.lit("")), "raw", position).alias("event_id"),
        "timestamp", "source", "source_type", "event_type", "severity",
        F.col("raw").alias("raw_data"), ecs_block().alias("normalized_data"),
        "source_ip", "destination_ip", "source_port", "destination_port", "username", "hostname", "domain", "url",
        "hash", "protocol", "action", "status", F.lit(None).cast("string").alias("asset_id"),
        demo_tags().alias("metadata"), "parser_version", now.alias("ingestion_timestamp"),
        "format", error_type.alias("error_type"), error_message.alias("error_message"),
    )


def accepted(ingested: DataFrame) -> DataFrame:
    return ingested.filter(F.col("error_type").isNull()).select(*EVENT_COLUMNS)


def dead_letters(ingested: DataFrame) -> DataFrame:
    """Rejected payloads, the raw text kept whole."""
    return ingested.filter(F.col("error_type").isNotNull()).select(
        F.concat(F.lit("dlq-"), F.substring("event_id", 5, 32)).alias("dead_letter_id"),
        F.col("ingestion_timestamp").alias("timestamp"),
        F.coalesce("source", "format").alias("source"), F.col("format").alias("source_type"),
        "error_type", "error_message", F.col("raw_data").alias("raw_payload"),
    )


def lineage(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", F.col("raw_data").alias("raw_input"), F.col("normalized_data").alias("normalized_representation"),
        "parser_version", "source", "ingestion_timestamp",
    )


def ingest_summary(ingested: DataFrame) -> DataFrame:
    """Totals of a batch, one row."""
    ok = F.col("error_type").isNull()
    return ingested.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected")
    )


def query_dead_letters(letters: DataFrame, limit: int | None = None, error_type: str | None = None, offset: int = 0) -> DataFrame:
    """Newest first."""
    return page(letters, [F.col("timestamp").desc(), F.col("dead_letter_id")], limit, offset, error_type=error_type)
