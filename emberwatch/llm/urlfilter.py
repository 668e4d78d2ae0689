"""URL rules judged through a cascade of Bloom filters.

The keys a rule list could name are finite for a given corpus: for every address, its host cut to as
many labels as some rule has, with the start of its path as long as some rule's. That is the corpus's
complete key universe. Level 1 of a cascade encodes the listed keys; level 2 the keys of the universe
that level 1 takes for listed but are not; level 3 the listed keys that level 2 takes for those, and so
on until a level errs no more. Membership of every key of the universe is then exact, and judging an
address needs no join: only the filters, whose size follows the rule list and is checked.

Defined results: a null address, or one without ``://``, has an empty host and path and fits no rule; an
address that fits no rule has a null rule and the filter's verdict for keys that are not listed; among
the rules that fit, the longest wins; repeated rules count once; an empty rule list lets all pass; columns of the input named
host, path, rule or verdict give way to the results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import columns, written

BITS_A_KEY = 10
HASHES = 5
#: a level larger than this is not sent to the tasks; the keys are joined instead, with the same result
MAX_BYTES = 64 << 20


def with_host_and_path(df: DataFrame, url_col: str) -> DataFrame:
    """Columns host and path beside the others.

    Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z in lower case. Path: on to ``?``, ``#``
    or the end. Without ``://`` both are empty.
    """
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("host", "path", "rule", "verdict")], host.alias("host"), path.alias("path"))


def shapes(rules: Iterable[tuple[str, str]]) -> list[tuple[int, int]]:
    """The (labels of the host, length of the path) that occur among the rules, longest first."""
    return sorted({(h.count(".") + 1, len(p)) for h, p in rules}, key=lambda s: (-s[1], -s[0]))


def candidates(labels: int, length: int) -> Column:
    """The key an address has for one shape, or null if it is too short for it."""
    host = F.substring_index("host", ".", -labels)
    enough = (F.size(F.split("host", r"\.")) >= labels) & (F.length("path") >= length) & (F.col("host") != "")
    return F.when(enough, F.concat(host, F.substring("path", 1, length)))


def hashes(key: Column, level: int) -> Column:
    return F.array(F.xxhash64(F.lit(2 * level), key), F.xxhash64(F.lit(2 * level + 1), key))


def positions(pair: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions by double hashing of two 64-bit hashes a key."""
    h = np.ascontiguousarray(pair).view(np.uint64)
    with np.errstate(over="ignore"):
        return (h[:, :1] + np.arange(HASHES, dtype=np.uint64)[None, :] * (h[:, 1:] | np.uint64(1))) % np.uint64(bits)


class Cascade:
    """Levels of (bits, packed array). A key that stops passing at an even level is listed, at an odd level not."""

    def __init__(self, levels: list[tuple[int, np.ndarray]]):
        self.levels = levels

    def passes(self, level: int, pair: np.ndarray) -> np.ndarray:
        bits, words = self.levels[level]
        at = positions(pair, bits)
        return ((words[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def listed(self, pairs: np.ndarray) -> np.ndarray:
        """pairs: keys x levels x 2."""
        inside = np.zeros(len(pairs), bool)
        alive = np.arange(len(pairs))
        for level in range(len(self.levels)):
            ok = self.passes(level, pairs[alive, level])
            inside[alive[~ok]] = level % 2 == 1
            alive = alive[ok]
        inside[alive] = len(self.levels) % 2 == 1
        return inside


def _filter_of(keys: DataFrame, level: int) -> tuple[int, np.ndarray] | None:
    """One level over the keys, built where they are: tasks give the bytes they set, combined before they meet."""
    n = keys.count()
    bits = max(64, n * BITS_A_KEY)
    if bits > 8 * MAX_BYTES:
        return None

    def where(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = positions(np.stack(pdf["h"].to_numpy()), bits).ravel() if len(pdf) else np.zeros(0, np.uint64)
            byte, bit = (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            yield pd.DataFrame({"byte": byte, "bit": bit.astype(np.int32)})

    words = np.zeros(bits // 8 + 1, np.uint8)
    set_bits = keys.select(hashes(F.col("key"), level).alias("h")).mapInPandas(where, "byte bigint, bit int")
    for r in set_bits.groupBy("byte").agg(F.bit_or("bit").alias("bit")).toLocalIterator():  # at most MAX_BYTES bytes
        words[r["byte"]] = r["bit"]
    return bits, words


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade | None:
    """The cascade for the listed keys over the universe; both have one column, key. None if a level is too large."""
    spark = listed.sparkSession
    listed = written(listed.distinct(), "listed-keys")
    rest = universe.join(listed, "key", "left_anti")
    levels: list[tuple[int, np.ndarray]] = []
    take, other = listed, rest
    while True:
        level = _filter_of(take, len(levels))
        if level is None:
            return None
        levels.append(level)
        here = spark.sparkContext.broadcast(Cascade(levels))
        at = len(levels) - 1

        def errs(batches: Iterator[pd.DataFrame], here=here, at=at) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pdf.loc[here.value.passes(at, np.stack(pdf["h"].to_numpy())), ["key"]]

        wrong = written(other.select("key", hashes(F.col("key"), at).alias("h")).mapInPandas(errs, "key string"), "filter-errors")
        if wrong.isEmpty():
            return Cascade(levels)
        take, other = wrong, take


def judge(urls: DataFrame, rules: dict[tuple[str, str], str], url_col: str = "url", unlisted: str = "allow") -> DataFrame:
    """All columns of ``urls`` with host, path, rule and verdict. ``rules``: (host, path) to verdict.

    The universe is every key of every address, made distinct; one cascade for each verdict.
    """
    spark: SparkSession = urls.sparkSession
    parsed = with_host_and_path(urls, url_col)
    shape = shapes(rules)
    if not shape:
        return parsed.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(unlisted))
    keys = F.array_compact(F.array(*[candidates(*s) for s in shape]))
    universe = written(with_host_and_path(columns(urls, url=url_col), "url").select(F.explode(keys).alias("key")).distinct(), "url-keys")
    table = spark.createDataFrame([(h + p, v) for (h, p), v in rules.items()], "key string, verdict string")
    verdicts = sorted(set(rules.values()))
    cascades = [build_cascade(table.filter(F.col("verdict") == v).select("key"), universe) for v in verdicts]
    if None in cascades:
        return _joined(parsed, table, shape, unlisted)
    held = spark.sparkContext.broadcast(cascades)
    depth = max(len(c.levels) for c in cascades)

    @F.pandas_udf("int")
    def which(h: pd.Series) -> pd.Series:
        """The number of the verdict whose list has the key, -1 for none."""
        out = np.full(len(h), -1)
        some = h.notna().to_numpy()
        if some.any():
            pairs = np.stack(h[some].to_numpy()).reshape(-1, depth, 2)
            for v, cascade in enumerate(held.value):
                out[np.flatnonzero(some)[cascade.listed(pairs)]] = v
        return pd.Series(out, dtype="int32")

    keyed = parsed.withColumn("_keys", F.array(*[candidates(*s) for s in shape]))
    each = F.transform("_keys", lambda k: F.when(k.isNotNull(), F.concat(*[hashes(k, level) for level in range(depth)])))
    judged = keyed.withColumn("_hashes", each)
    for i in range(len(shape)):
        judged = judged.withColumn(f"_v{i}", which(F.col("_hashes")[i]))
    hits = F.array_compact(F.array(*[F.when(F.col(f"_v{i}") >= 0, F.struct(F.length(F.col("_keys")[i]).alias("n"), F.col("_keys")[i].alias("key"), F.col(f"_v{i}").alias("v"))) for i in range(len(shape))]))
    top = F.array_max(hits)
    named = F.array(*[F.lit(v) for v in verdicts])
    return judged.withColumn("_top", top).select(
        *[F.col(f"`{c}`") for c in parsed.columns], F.col("_top.key").alias("rule"), F.coalesce(F.get(named, F.col("_top.v")), F.lit(unlisted)).alias("verdict"))


def _joined(parsed: DataFrame, table: DataFrame, shape: list[tuple[int, int]], unlisted: str) -> DataFrame:
    """The same result by joins on the keys, for rule lists whose filters are too large to send."""
    out = parsed.withColumn("_top", F.lit(None).cast("struct<n int, key string, verdict string>"))
    for s in shape:
        found = table.dropDuplicates(["key"]).select(F.col("key").alias("_k"), F.struct(F.length("key").alias("n"), "key", "verdict").alias("_hit"))
        out = out.withColumn("_k", candidates(*s)).join(found, "_k", "left").withColumn("_top", F.array_max(F.array_compact(F.array("_top", "_hit")))).drop("_k", "_hit")
    return out.select(*[F.col(f"`{c}`") for c in parsed.columns], F.col("_top.key").alias("rule"), F.coalesce("_top.verdict", F.lit(unlisted)).alias("verdict"))
