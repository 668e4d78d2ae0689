"""Validation of canonical events given as JSON (VAL-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.network import norm_ip
from ..functions.severity import LEVELS
from ..plans.fence import once

# Limits of the canonical event.
MAX_BYTES = 1_048_576
REQUIRED = ("event_id", "timestamp", "source", "source_type", "event_type", "severity", "raw_data", "normalized_data")
TEXT_LIMITS = {
    "event_id": (1, 128), "source": (1, 128), "source_type": (1, 64), "event_type": (1, 128), "username": (0, 128), "hostname": (0, 255),
    "domain": (0, 255), "url": (0, None), "hash": (0, 128), "protocol": (0, 32), "action": (0, 64), "status": (0, 64), "asset_id": (0, 128),
    "parser_version": (0, 32),
}
FIELD_ORDER = (
    "event_id", "timestamp", "source", "source_type", "event_type", "severity", "raw_data", "normalized_data", "source_ip", "destination_ip",
    "source_port", "destination_port", "username", "hostname", "domain", "url", "hash", "protocol", "action", "status", "asset_id", "metadata",
    "parser_version", "ingestion_timestamp",
)


def _error(loc: str, msg: Column | str, kind: str) -> Column:
    return F.struct(F.lit(loc).alias("loc"), (F.lit(msg) if isinstance(msg, str) else msg).alias("msg"), F.lit(kind).alias("type"))


def _field_error(name: str) -> Column:
    """First thing wrong with one field of the opened payload ``_v``; null when it is fine."""
    v = F.col("_v")
    kind, text = X.json_type(v, name), F.trim(X.literal_key(v, name))
    here = X.has_key(v, name)
    null = kind == "VOID"
    required = name in REQUIRED
    out = F.when(~here, _error(name, "Field required", "missing") if required else F.lit(None))
    is_text, is_object = kind == "STRING", kind.startswith("OBJECT")
    whole = kind == "BIGINT"
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    if name in ("timestamp", "ingestion_timestamp"):
        bad = F.when(null, "Value error, Timestamp cannot be None").when(is_text & (text == ""), "Value error, Timestamp string cannot be empty").when(
            is_text & X.parse_iso(text).isNull(), F.concat(F.lit("Value error, Invalid timestamp format: '"), text, F.lit("' (expected ISO 8601)"))).when(
            ~is_text & ~number, F.concat(F.lit("Value error, Invalid timestamp type: "), kind))
        return out.when(bad.isNotNull(), _error(name, bad, "value_error"))
    if name == "severity":
        return out.when(~is_text | ~F.coalesce(F.lower(text).isin(*LEVELS), F.lit(False)),
                        _error(name, "Input should be 'informational', 'low', 'medium', 'high' or 'critical'", "enum"))
    if name in ("source_ip", "destination_ip"):
        return out.when(null, None).when(~is_text, _error(name, "Value error, IP address must be a string", "value_error")).when(
            (text != "") & (norm_ip(text).isNull() | text.rlike(r"^[^\[:]*:[^:]*$")), _error(name, F.concat(F.lit("Value error, Invalid IP address: '"), text, F.lit("'")), "value_error"))
    if name in ("source_port", "destination_port"):
        port = text.try_cast("bigint")
        return out.when(null, None).when(~(whole | is_text) | port.isNull(), _error(name, "Input should be a valid integer", "int_parsing")).when(
            port < 0, _error(name, "Input should be greater than or equal to 0", "greater_than_equal")).when(
            port > 65535, _error(name, "Input should be less than or equal to 65535", "less_than_equal"))
    if name == "metadata":
        return out.when(~is_object & ~null, _error(name, "Value error, metadata must be a dictionary", "value_error"))
    if name == "normalized_data":
        return out.when(~is_object, _error(name, "Value error, normalized_data must be a dictionary", "value_error"))
    if name == "raw_data":
        return out.when(~is_object & ~is_text, _error(name, "Input should be a valid dictionary or string", "dict_type"))
    low, high = TEXT_LIMITS[name]
    out = out.when(F.lit(not required and name != "parser_version") & null, None)
    out = out.when(~is_text, _error(name, "Input should be a valid string", "string_type"))
    if low:
        out = out.when(F.length(text) < low, _error(name, f"String should have at least {low} character", "string_too_short"))
    if high is not None:
        out = out.when(F.length(text) > high, _error(name, f"String should have at most {high} characters", "string_too_long"))
    return out


def validate_events(raw: DataFrame, column: str = "raw", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Adds is_valid, error_message and validation_errors (loc, msg, type) to JSON events. No shuffle."""
    opened = once(raw.withColumns({"_t": F.trim(column), "_v": X.json_object(column)}))
    v = F.col("_v")
    unknown = F.transform(
        F.array_except(F.coalesce(F.json_object_keys("_t"), F.array().cast("array<string>")), F.array(*[F.lit(f) for f in FIELD_ORDER])),
        lambda k: F.struct(k.alias("loc"), F.lit("Extra inputs are not permitted").alias("msg"), F.lit("extra_forbidden").alias("type")))
    fields = F.filter(F.array(*[_field_error(f) for f in FIELD_ORDER]), lambda e: e.isNotNull())
    size = F.length(column)
    one = lambda msg, kind: F.array(_error("payload", msg, kind))
    too_big = F.concat(F.lit("Payload size "), size.cast("string"), F.lit(f" bytes exceeds maximum allowed limit of {max_bytes} bytes"))
    errors = (
        F.when(F.col(column).isNull(), one("Payload is None", "value_error")).when(size > max_bytes, one(too_big, "oversized_payload"))
        .when(v.isNull(), one(F.coalesce(X.json_error("_t"), F.lit("Malformed JSON payload")), "type_error")).otherwise(F.concat(fields, unknown)))
    done = once(opened.withColumn("validation_errors", errors).drop("_t", "_v"))
    first = F.get("validation_errors", F.lit(0))
    message = F.when(F.size("validation_errors") == 0, None).when(first["loc"] == "payload", first["msg"]).otherwise(
        F.format_string("Validation failed: %d error(s) found", F.size("validation_errors")))
    return done.withColumns({"is_valid": F.size("validation_errors") == 0, "error_message": message})


def validated_events(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Valid events as typed columns, addresses in canonical form, severity in lower case."""
    ok = once(validate_events(raw, column).filter("is_valid").withColumn("_v", X.json_object(column)))
    v = F.col("_v")
    text = lambda n: F.trim(X.literal_key(v, n))
    ts = lambda n: F.when(X.is_number(v, n), X.epoch_timestamp(X.literal_key(v, n, "double"))).otherwise(X.parse_iso(text(n)))
    kinds = {"timestamp": ts("timestamp"), "ingestion_timestamp": F.coalesce(ts("ingestion_timestamp"), F.current_timestamp()), "severity": F.lower(text("severity")),
             "source_ip": norm_ip(text("source_ip")), "destination_ip": norm_ip(text("destination_ip")),
             "source_port": text("source_port").try_cast("int"), "destination_port": text("destination_port").try_cast("int"),
             "parser_version": F.coalesce(text("parser_version"), F.lit("1.0.0")),
             "metadata": F.coalesce(F.from_json(text("metadata"), "map<string,string>"), F.create_map().cast("map<string,string>"))}
    return ok.select(*[kinds.get(n, text(n)).alias(n) for n in FIELD_ORDER])
