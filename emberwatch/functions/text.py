"""Text, variant-path and timestamp helpers (SCA-03, 07, 10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .severity import as_col

# Date layouts tried after ISO-8601.
SYSLOG_LAYOUT = "yyyy MMM d HH:mm:ss"
ACCESS_LOG_LAYOUT = "dd/MMM/yyyy:HH:mm:ss xxx"

_ISO = (
    r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,6})?)?)?"
    r"(?:[+-]\d{2}:\d{2})?$"
)


def group(c: Column | str, pattern: str, index: int) -> Column:
    """Regex group; null (not '') when the group took no part in the match."""
    return F.nullif(F.regexp_extract(as_col(c), pattern, index), F.lit(""))


def groups(c: Column | str, pattern: str, count: int) -> Column:
    """All groups of a pattern that starts with ``^``, found in one go: item i is group i, '' when it took no part. Without a match there is no item 1."""
    text, mark = as_col(c), "\x01"
    found = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(mark + mark.join(f"${i}" for i in range(1, count + 1)) + mark)), mark, -1)
    # a text that holds the mark itself is read group by group
    each = F.array(F.lit(""), *[F.regexp_extract(text, pattern, i) for i in range(1, count + 1)])
    return F.when(text.contains(mark), F.when(text.rlike(pattern), each)).otherwise(found)


def not_blank(c: Column) -> Column:
    """Null for the values that count as absent in an ``a or b`` chain."""
    return F.when(~c.isin("", "[]", "{}"), c)


def first_of(*cols: Column) -> Column:
    return F.coalesce(*[not_blank(c) for c in cols])


def json_object(c: Column | str) -> Column:
    """Text → variant when it is a JSON object, else null (PRS-01)."""
    text = F.trim(as_col(c))
    return F.when(text.startswith("{"), F.try_parse_json(text))


def json_error(c: Column | str) -> Column:
    """Reason why a text is no JSON object; null when it is one."""
    text = F.trim(as_col(c))
    parsed = F.try_parse_json(text)
    return (
        F.when(text.isNull(), "Unsupported payload type: NoneType")
        .when(text == "", "Empty payload string")
        .when(parsed.isNull(), "Invalid JSON syntax")
        .when(~text.startswith("{"), "Expected JSON object/dict")
    )


def path(v: Column, dotted: str, kind: str = "string") -> Column:
    """Nested value of a variant: ``a.b`` walks objects."""
    steps = "".join(f"['{p}']" for p in dotted.split("."))
    return F.try_variant_get(v, "$" + steps, kind)


def literal_key(v: Column, key: str, kind: str = "string") -> Column:
    """Value under one key, the key taken whole even when it holds dots."""
    return F.try_variant_get(v, f"$['{key}']", kind)


def has_key(v: Column, key: str) -> Column:
    """Key present, a JSON null included."""
    return F.coalesce(F.try_variant_get(v, f"$['{key}']", "variant").isNotNull(), F.lit(False))


def json_type(v: Column, key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$['{key}']", "variant"))


def is_number(v: Column, key: str) -> Column:
    return json_type(v, key).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")


def epoch_timestamp(n: Column) -> Column:
    """Epoch seconds, or milliseconds above 1e11."""
    seconds = F.when(n > 1e11, n / 1000.0).otherwise(n)
    return F.timestamp_micros((seconds * 1e6).cast("bigint"))


def _iso_text(c: Column) -> Column:
    text = F.regexp_replace(F.trim(c), "Z$", "+00:00")
    return F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")


def parse_iso(c: Column | str) -> Column:
    """Strict ISO-8601 (validator form): null when malformed."""
    text = F.regexp_replace(F.trim(as_col(c)), "Z$", "+00:00")
    return F.when(text.rlike(_ISO), F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp"))


def parse_ts(c: Column | str, as_of: Column, numeric: Column | None = None) -> Column:
    """Lenient timestamp; falls back to ``as_of`` (which also gives the year of syslog dates)."""
    text = _iso_text(as_col(c))
    year = F.date_format(as_of, "yyyy")
    blanks = F.regexp_replace(text, r"\s+", " ")
    tries = [
        F.when(text.rlike(_ISO), F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp")),
        F.when(text.rlike(r"^[A-Z][a-z]{2}\s"), F.try_to_timestamp(F.concat_ws(" ", year, blanks), F.lit(SYSLOG_LAYOUT))),
        F.when(text.rlike(r"^\d{2}/"), F.try_to_timestamp(text, F.lit(ACCESS_LOG_LAYOUT))),
        as_of,
    ]
    if numeric is not None:
        return F.when(numeric.isNotNull(), epoch_timestamp(numeric)).otherwise(F.coalesce(*tries))
    return F.coalesce(*tries)


def entropy(c: Column | str) -> Column:
    """Shannon entropy in bits of the lower-cased text."""
    text = F.lower(as_col(c))
    n = F.length(text)

    def term(ch: Column) -> Column:
        share = (n - F.length(F.replace(text, ch, F.lit("")))) / n.cast("double")
        return -share * F.log2(share)

    chars = F.filter(F.array_distinct(F.split(text, "")), lambda x: x != "")
    return F.when(n > 0, F.aggregate(F.transform(chars, term), F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)


def text_of(v: Column) -> Column:
    """Text of any variant: lists joined by a blank, everything else cast."""
    items = F.try_variant_get(v, "$", "array<string>")
    return F.coalesce(F.array_join(items, " "), F.try_variant_get(v, "$", "string"))


def flat_field(v: Column, dotted: str) -> Column:
    """Text of a flattened field: ``a.b`` walks objects, lists are joined by a blank, and ``a.b_str`` is a list of texts so joined."""
    value = text_of(path(v, dotted, "variant"))
    if not dotted.endswith("_str"):
        return value
    items = path(v, dotted.removesuffix("_str"), "variant")
    texts = F.try_variant_get(items, "$", "array<string>")
    kind = F.schema_of_variant(items)
    return F.coalesce(value, F.when((kind == "ARRAY<STRING>") | ((kind == "ARRAY<VOID>") & (F.size(texts) == 0)), F.array_join(texts, " ")))


def flatten_keys(df: DataFrame, column: str, prefix: str, keep: list[str]) -> DataFrame:
    """Every field of a JSON object at any depth as a row: ``keep`` columns, ``field`` (dotted) and ``value`` as text.

    Objects are opened level by level, so the rounds grow with the depth of the data. Lists are joined by a
    blank; lists of texts are also given as ``<field>_str``. JSON nulls are fields with a null value; empty objects have none.
    """
    spark = df.sparkSession
    level = df.select(*keep, F.lit(prefix).alias("field"), json_object(column).alias("_v")).filter("_v IS NOT NULL")
    done = []
    while True:
        opened = level.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()).select("key", "value")).select(
            *keep, F.concat("field", F.lit("."), "key").alias("field"), F.col("value").alias("_v"), F.schema_of_variant("value").startswith("OBJECT").alias("_open"))
        opened = cut_lineage(opened)
        done.append(opened.filter(~F.col("_open")).drop("_open"))
        level = opened.filter("_open").drop("_open")
        if level.isEmpty():
            break
    leaves = done[0]
    for more in done[1:]:
        leaves = leaves.unionByName(more)
    texts = F.try_variant_get("_v", "$", "array<string>")
    listed = (F.schema_of_variant("_v") == "ARRAY<STRING>") | ((F.schema_of_variant("_v") == "ARRAY<VOID>") & (F.size(texts) == 0))
    joined = leaves.filter(listed).select(*keep, F.concat("field", F.lit("_str")).alias("field"), F.array_join(texts, " ").alias("value"))
    return leaves.select(*keep, "field", text_of(F.col("_v")).alias("value")).unionByName(joined)
