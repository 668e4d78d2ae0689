"""Indicator feeds and rule files (SRC-04, SRC-05)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.network import norm_ip
from ..operators.indicators import network_key
from ..operators.rules import Rule, compile_sigma

FEED_SCHEMA = "value string, kind string, category string, source string"

# Indicators used when a feed is empty.
SAMPLE_INDICATORS = {
    "ip": ("203.0.113.100", "203.0.113.200", "198.51.100.100", "198.51.100.200", "192.0.2.100", "192.0.2.200", "45.33.32.156"),
    "domain": ("malware-test.example.com", "phishing-demo.example.org", "c2-beacon.example.net", "evil-download.test.local",
               "fake-bank-login.xyz", "credential-harvest.test"),
    "hash": ("44d88612fea8a8f36de82e1278abb02f", "3395856ce81f2b7382dee72602f798b642f14140",
             "275a021bbfb6489e54d471899f7db9d1663fc695ec2fe2a2c4538aabf651fd0f", "d41d8cd98f00b204e9800998ecf8427e",
             "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"),
}


def sample_feed(spark: SparkSession) -> DataFrame:
    rows = [(v, kind, None, None) for kind, values in SAMPLE_INDICATORS.items() for v in values]
    return spark.createDataFrame(rows, FEED_SCHEMA)


def parse_feed(lines: DataFrame) -> DataFrame:
    """Lines (``value`` text, ``file`` name) → valid indicators; comments, blanks and bad values are dropped."""
    name = F.lower(F.element_at(F.split("file", "/"), -1))
    kind = F.when(name.contains("ip"), "ip").when(name.contains("domain"), "domain").when(name.contains("hash"), "hash")
    line = F.trim("value")
    part = lambda i: F.nullif(F.trim(F.split_part(line, F.lit(","), F.lit(i))), F.lit(""))
    rows = lines.filter((line != "") & ~line.startswith("#")).select(
        part(1).alias("value"), kind.alias("kind"), part(2).alias("category"), F.when(part(2).isNotNull(), F.coalesce(part(3), F.lit("blocklist"))).alias("source"))
    value = F.when(F.col("kind") == "ip", F.col("value")).otherwise(F.lower("value"))
    valid = (
        F.when(F.col("kind") == "ip", F.when(F.col("value").contains("/"), network_key(F.col("value"))).otherwise(norm_ip("value")).isNotNull())
        .when(F.col("kind") == "hash", value.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"))
        .when(F.col("kind") == "domain", value.isNotNull())
    )
    return rows.filter(F.coalesce(valid, F.lit(False))).select(value.alias("value"), "kind", "category", "source")


def read_ioc_feed(spark: SparkSession, path: str, fallback: DataFrame | None = None) -> DataFrame:
    """Indicator files of a folder (or one file), the kind taken from the file name.

    An empty feed stays empty, unless a ``fallback`` is given for it; that test reads one row.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    feed = parse_feed(lines)
    return fallback if fallback is not None and feed.isEmpty() else feed


def add_indicators(feed: DataFrame, values: list[tuple]) -> DataFrame:
    """Feed with further (value, kind, category, source) rows."""
    return feed.unionByName(feed.sparkSession.createDataFrame(values, FEED_SCHEMA))


def read_sigma_rules(spark: SparkSession, path: str) -> tuple[list[Rule], list[str]]:
    """Rules of all YAML files below ``path`` and the names of files that could not be read.

    Rule files are configuration: small, few, and needed on the driver to build the plan.
    """
    import yaml

    files = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{yml,yaml}").text(path, wholetext=True)
        .select("value", F.input_file_name().alias("file")).orderBy("file")
    )
    rules: dict[str, Rule] = {}
    skipped = []
    for row in files.toLocalIterator():
        try:
            spec = yaml.safe_load(row.value)
            if isinstance(spec, dict):
                rule = compile_sigma(spec)
                rules[rule.rule_id] = rule
        except Exception:
            skipped.append(row.file)
    return list(rules.values()), skipped
