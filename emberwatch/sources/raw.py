"""Raw payload readers (SRC-01 … SRC-03)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parse import PARSERS


def _labelled(df: DataFrame, source_type: str | None, source_identifier: str | None) -> DataFrame:
    return df.withColumns({"source_type": F.lit(source_type).cast("string"), "source_identifier": F.lit(source_identifier).cast("string")})


def read_raw_batch(spark: SparkSession, path: str, source_type: str | None = None, source_identifier: str | None = None, whole_files: bool = False) -> DataFrame:
    """One payload per line (or per file). Bytes that are no UTF-8 keep their place as replacement marks.

    The position is the file name and the byte offset of the block the line was read from plus the
    line's own content, enough to name a payload again on replay.
    """
    lines = spark.read.text(path, wholetext=whole_files)
    rows = lines.select(F.col("value").alias("raw"), F.input_file_name().alias("source_position")).filter(F.trim("raw") != "")
    return _labelled(rows, source_type, source_identifier)


def raw_from_bytes(df: DataFrame, column: str, source_type: str | None = None) -> DataFrame:
    """Binary payloads as text; what cannot be decoded is kept with replacement marks."""
    text = F.coalesce(F.try_validate_utf8(F.col(column).cast("string")), F.make_valid_utf8(F.col(column).cast("string")))
    return _labelled(df.withColumn("raw", text), source_type, None)


def read_raw_stream(spark: SparkSession, path: str | None = None, kafka: dict | None = None, source_type: str | None = None, max_files: int = 1000, max_offsets: int | None = None) -> DataFrame:
    """Stream of payloads from a folder of text files or from a topic.

    ``kafka`` holds the connector's options (servers, subscribe); the newest offsets are the default start.
    """
    if kafka is not None:
        reader = spark.readStream.format("kafka").option("startingOffsets", "latest")
        if max_offsets:
            reader = reader.option("maxOffsetsPerTrigger", max_offsets)
        rows = reader.options(**kafka).load().select(
            F.col("value").cast("string").alias("raw"), F.concat_ws("/", "topic", "partition", "offset").alias("source_position"))
    else:
        rows = spark.readStream.option("maxFilesPerTrigger", max_files).text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("source_position"))
    return _labelled(rows.filter(F.trim("raw") != ""), source_type, None)


def bound_reader(source_type: str):
    """Reader pinned to one format, so that detection is skipped; an explicit format overrides it."""
    if source_type not in PARSERS:
        raise ValueError(f"unknown format {source_type}")

    def read(spark: SparkSession, path: str, override: str | None = None, source_identifier: str | None = None) -> DataFrame:
        return read_raw_batch(spark, path, override or source_type, source_identifier or f"{source_type}_collector")

    return read


read_syslog, read_json, read_suricata, read_application, read_authentication, read_email = (
    bound_reader(t) for t in ("syslog", "json", "suricata", "application", "authentication", "email"))
