"""Indicator lookups against a feed (DET-10 … DET-16).

Every event yields a few lookup keys: the address itself and its masked forms, a domain with its
parent names, a hash, a link's host. One equi-join against the feed finds all hits. The feed is
stored first, so its bytes are known before the events are read: a small one is sent to all tasks and no
lookup is shuffled; with a large one the adaptive join splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.network import domain_suffixes, host_of, ipv4_number, ipv6_hextets, let, norm_ip
from ..plans.fence import once
from ..session import cut_lineage, has_checkpoint_dir
from .rules import Rule, field_column


def _cut(value: Column, gone: Column) -> Column:
    """A number without its last bits."""
    return F.call_function("shiftleft", F.call_function("shiftright", value, gone), gone)


def _halves(ip: Column) -> Column:
    """An IPv6 address as two whole numbers."""

    def half(groups: Column, first: int) -> Column:
        part = lambda i: F.conv(F.get(groups, F.lit(first + i)), 16, 10).cast("bigint")
        return F.shiftleft(part(0), 48).bitwiseOR(F.shiftleft(part(1), 32)).bitwiseOR(F.shiftleft(part(2), 16)).bitwiseOR(part(3))

    return let(ipv6_hextets(ip), lambda g: F.when(g.isNotNull(), F.struct(half(g, 0).alias("hi"), half(g, 4).alias("lo"))))


def _prefix4(number: Column, length: Column) -> Column:
    return _cut(number, F.lit(32) - length).cast("string")


def _prefix6(halves: Column, length: Column) -> Column:
    # a shift by 64 would be none at all, so the empty and the full prefix of a half are told apart
    def kept(value: Column, bits: Column) -> Column:
        return F.when(bits <= 0, F.lit(0).cast("bigint")).when(bits >= 64, value).otherwise(_cut(value, F.lit(64) - bits))

    return F.concat(kept(halves["hi"], length).cast("string"), F.lit(","), kept(halves["lo"], length - 64).cast("string"))


def network_key(value: Column) -> Column:
    """``a.b.c.d/n`` → key ``32/n:number``, for IPv6 ``128/n:number,number``; null when it is no network."""
    ip, length = F.split_part(value, F.lit("/"), F.lit(1)), F.split_part(value, F.lit("/"), F.lit(2)).try_cast("int")
    six = ip.contains(":")
    number = F.when(six, let(_halves(ip), lambda h: _prefix6(h, length))).otherwise(_prefix4(ipv4_number(ip), length))
    width = F.when(six, 128).otherwise(32)
    return F.when(length.between(0, width), F.concat(width.cast("string"), F.lit("/"), length.cast("string"), F.lit(":"), number))


def feed_keys(feed: DataFrame) -> DataFrame:
    """Feed rows (value, kind, category, source) → one row per lookup key."""
    value = F.trim("value")
    is_net = value.contains("/")
    key = (
        F.when(F.col("kind") == "ip", F.when(is_net, network_key(value)).otherwise(norm_ip(value)))
        .when(F.col("kind") == "domain", F.lower(value)).when(F.col("kind") == "hash", F.lower(value))
    )
    kind = F.when((F.col("kind") == "ip") & is_net, "network").otherwise(F.col("kind"))
    return feed.select(kind.alias("key_kind"), key.alias("key")).filter(F.col("key").isNotNull()).distinct()


def feed_context(feed: DataFrame) -> DataFrame:
    """Context by the exact text of an indicator: a parent-name or network hit has none. Later lines win."""
    own = feed.filter(F.col("category").isNotNull()).select(
        F.when(F.col("kind") == "ip", F.trim("value")).otherwise(F.lower(F.trim("value"))).alias("_ctx"), "kind", "category", "source")
    order = F.when(F.col("kind") == "ip", 0).when(F.col("kind") == "domain", 1).otherwise(2)
    best = own.groupBy("_ctx").agg(F.min_by(F.struct("category", "source"), order).alias("c"))
    return best.select("_ctx", F.col("c.category").alias("ioc_category"), F.col("c.source").alias("ioc_source"))


def network_lengths(feed: DataFrame) -> DataFrame:
    """Distinct (address width, prefix length) pairs of the feed: at most 162 rows."""
    keys = feed_keys(feed).filter(F.col("key_kind") == "network")
    return keys.select(F.split_part("key", F.lit(":"), F.lit(1)).alias("w")).distinct().select(
        F.struct(F.col("w").alias("name"), F.col("w").startswith("128/").alias("six"), F.split_part("w", F.lit("/"), F.lit(2)).cast("int").alias("length")).alias("w"))


def lookup_keys(value: Column, ioc_type: str, widths: Column | None = None) -> Column:
    """Keys under which ``value`` may be listed: array of (key_kind, key)."""
    one = lambda kind, key: F.struct(F.lit(kind).alias("key_kind"), key.alias("key"))
    if ioc_type == "ip":
        ip = norm_ip(value)

        def nets(six: bool, number: Column) -> Column:
            prefix = _prefix6 if six else _prefix4
            wanted = F.filter(F.coalesce(widths, F.array().cast(_WIDTHS)), lambda w: w["six"] == six)
            found = let(number, lambda x: F.transform(wanted, lambda w: one("network", F.concat(w["name"], F.lit(":"), prefix(x, w["length"])))))
            return F.coalesce(found, F.array().cast(_KEYS))

        exact = F.array(one("ip", ip))
        if widths is not None:
            # the address becomes a number once, whatever the count of prefix lengths
            exact = F.concat(exact, F.when(ip.contains(":"), nets(True, _halves(ip))).otherwise(nets(False, ipv4_number(ip))))
        return F.when(ip.isNotNull(), exact)
    if ioc_type == "domain":
        return F.transform(domain_suffixes(value), lambda d: one("domain", d))
    if ioc_type == "url":
        host = host_of(value)
        return F.when(host != "", F.transform(domain_suffixes(host), lambda d: one("domain", d)))
    return F.array(one("hash", F.lower(F.trim(value))))


_KEYS = "array<struct<key_kind:string,key:string>>"
_WIDTHS = "array<struct<name:string,six:boolean,length:int>>"


#: bytes of a feed up to which it is sent to all tasks
SENT_BYTES = 32 << 20


def stored_feed(feed: DataFrame) -> tuple[DataFrame, bool]:
    """The feed computed once, and whether it is small enough to be sent whole. Without a checkpoint folder it is used as it is."""
    if not has_checkpoint_dir(feed.sparkSession):
        return feed, False
    feed = cut_lineage(feed)
    size = feed.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in feed.columns), F.lit(64)).cast("bigint"))).first()[0]
    return feed, (size or 0) <= SENT_BYTES


def match_indicators(events: DataFrame, feed: DataFrame, rules: list[Rule], carry: tuple = ()) -> DataFrame:
    """(event_id, rule_id, matched_field, matched_value, ioc_type, ioc_category, ioc_source), one row per event and rule.

    Only the event id, the looked-up texts and the ``carry`` columns travel; most rows find nothing and end at the join.
    """
    carry = [c for c in carry if c in events.columns]
    rules = [r for r in rules if r.rule_type == "ioc" and r.enabled]
    cols = events.columns
    if "raw_data" in cols:
        events = events.withColumn("_raw", X.json_object("raw_data"))
    feed, small = stored_feed(feed)
    sent = F.broadcast if small else (lambda df: df)
    needed = {f.split(".")[0] for r in rules for f in r.fields} | {"_raw", "_w"}
    # scalar subquery of at most 162 short texts
    widths = network_lengths(feed).agg(F.collect_set("w").alias("w")).scalar() if any(r.ioc_type == "ip" for r in rules) else None
    if widths is not None:
        events = events.withColumn("_w", widths)
    events = once(events.select("event_id", *carry, *[c for c in (*cols, "_raw", "_w") if c in events.columns and c not in carry and c != "event_id" and c in needed]))
    tries = []
    for order, rule in enumerate(rules):
        for position, name in enumerate(rule.fields):
            text = F.trim(field_column(name, cols))
            keys = lookup_keys(text, rule.ioc_type, F.col("_w") if rule.ioc_type == "ip" else None)
            tries.append(F.struct(
                F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.ioc_type).alias("ioc_type"), F.lit(position).alias("position"),
                F.lit(name).alias("matched_field"), text.alias("matched_value"), F.when(text != "", keys).cast(_KEYS).alias("keys")))
    looked = events.select("event_id", F.struct(*carry).alias("_c") if carry else F.lit(None).alias("_c"), F.explode(F.array(*tries)).alias("t")).select("event_id", "_c", "t.*")
    looked = looked.select("event_id", "_c", "rule_id", "ioc_type", "position", "matched_field", "matched_value", F.explode("keys").alias("k"))
    hits = looked.join(sent(feed_keys(feed)), (F.col("k.key_kind") == F.col("key_kind")) & (F.col("k.key") == F.col("key")))
    first = hits.groupBy("event_id", "rule_id").agg(
        F.min_by(F.struct("matched_field", "matched_value", "ioc_type", "_c"), F.col("position")).alias("m"))
    out = first.select(
        "event_id", "rule_id", "m.matched_field", "m.matched_value", "m.ioc_type", *[F.col(f"m._c.{c}").alias(c) for c in carry],
        F.when(F.col("m.ioc_type") == "ip", F.col("m.matched_value")).otherwise(F.lower("m.matched_value")).alias("_ctx"))
    return out.join(sent(feed_context(feed)), "_ctx", "left").drop("_ctx")
