"""Windows over time that stay parallel when one key, or one instant, owns a large share of the rows.

A plain window sends a whole key to one task. Here rows are dealt by ranges of (key, order), so a task
holds a fixed share of the rows whatever their key or instant. A running value is then a prefix scan on
two levels: every range sums up its rows, the few ranges of a key are scanned, and each range starts from
what the ranges before it hand over. A sliding value is the difference of two running values, taken per
instant. The results equal those of the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: rows of one instant that one task joins with the instant's result; more are split
SPLIT_ROWS = 1 << 20


def micros(ts: Column | str) -> Column:
    return F.unix_micros(ts)


def tie(df: DataFrame) -> Column:
    """Hash of a row, to order rows of one instant. Maps and variants, which cannot be hashed, are left out."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))])


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """The rows dealt by ranges of (keys, order), with the number of their range in ``_part``.

    Stored, so that a range keeps its rows however often it is read or computed again.
    """
    count = [] if partitions is None else [partitions]
    return cut_lineage(df.repartitionByRange(*count, *keys, *order).withColumn("_part", F.spark_partition_id()))


def same(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> Column:
    """Equality of columns of two sides, nulls being equal."""
    out = F.lit(True)
    for a, b in pairs.items():
        out = out & left[a].eqNullSafe(right[b])
    return out


def spanning(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that lie in several ranges, with their first range. At most one key goes on over each border."""
    per = blocks.groupBy(*keys).agg(F.min("_part").alias("_lo"), F.max("_part").alias("_hi"))
    return per.filter(F.col("_lo") < F.col("_hi")).drop("_hi")


_COMBINE = {
    "s": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "m": (F.max, F.greatest),
    "x": (F.bit_xor, lambda a, b: F.coalesce(a.bitwiseXOR(b), a, b)),
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    xors: dict[str, Column] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Running sums, maxima and exclusive-ors up to each row (itself included) and values of the row before.

    ``order`` should be a total order: rows it does not tell apart stay in one range. What the ranges
    hand over is a row for each border that a key crosses, so it is fewer rows than there are ranges.
    """
    running_kinds = {"s": sums or {}, "m": maxes or {}, "x": xors or {}}
    named = [(kind, n, c) for kind, items in running_kinds.items() for n, c in items.items()]
    previous = previous or {}
    rows = ranged(
        df.select("*", *[c.alias(f"_{kind}_{n}") for kind, n, c in named], *[F.struct(c.alias("v")).alias(f"_p_{n}") for n, c in previous.items()]),
        keys, order, partitions)
    totals = rows.groupBy(*keys, "_part").agg(
        F.lit(1).alias("_one"), *[_COMBINE[kind][0](f"_{kind}_{n}").alias(f"_{kind}_{n}") for kind, n, _ in named],
        *[F.max_by(f"_p_{n}", F.struct(*order)).alias(f"_p_{n}") for n in previous])
    by_part = Window.partitionBy(*keys).orderBy("_part")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_kpart"), F.row_number().over(by_part).alias("_nth"),
        *[_COMBINE[kind][0](f"_{kind}_{n}").over(before).alias(f"_c{kind}_{n}") for kind, n, _ in named],
        *[F.lag(f"_p_{n}").over(by_part).alias(f"_cp_{n}") for n in previous],
    ).filter(F.col("_nth") > 1)
    link = {**{k: f"_k{i}" for i, k in enumerate(keys)}, "_part": "_kpart"}
    both = rows.join(F.broadcast(carry), same(rows, carry, link), "left")
    here = Window.partitionBy(*keys, "_part").orderBy(*[F.col(c).asc() for c in order])
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[_COMBINE[kind][1](_COMBINE[kind][0](f"_{kind}_{n}").over(upto), F.col(f"_c{kind}_{n}")).alias(n) for kind, n, _ in named],
        *[F.coalesce(F.lag(f"_p_{n}").over(here), F.col(f"_cp_{n}"))["v"].alias(n) for n in previous])


def sliding_sums(
    df: DataFrame, keys: Sequence[str], ts: str, seconds: int, sums: dict[str, Column], open_start: bool = False,
    where: Column | None = None, first: str | None = None, partitions: int | None = None,
) -> DataFrame:
    """Whole-number sums over ``[ts - seconds, ts]`` per key, both ends included (the start not, if ``open_start``).

    Rows of one instant have one result, so they are summed first. Instants and the starts of their
    windows then share one scan; the window is the difference of the two running sums. Time is linear
    in the rows however dense a key is. ``where``, over the sums, keeps only the rows whose window passes,
    and ``first`` adds the earliest instant in the window.
    """
    width = seconds * 1_000_000
    rows = df.withColumn("_us", micros(ts))
    instants = cut_lineage(rows.groupBy(*keys, "_us").agg(*[F.sum(c).alias(f"_v_{n}") for n, c in sums.items()], F.count(F.lit(1)).alias("_n")))
    values = [f"_v_{n}" for n in sums]
    points = instants.select(*keys, F.col("_us").alias("_at"), F.lit(1).alias("_kind"), F.col("_us").alias("_for"), *values)
    # sums before a window: a closed start stands before the instants at the same time, an open one after them
    starts = instants.filter(F.col("_us").isNotNull()).select(
        *keys, (F.col("_us") - width).alias("_at"), F.lit(2 if open_start else 0).alias("_kind"), F.col("_us").alias("_for"))
    seen = running(points.unionByName(starts, allowMissingColumns=True), keys, ["_at", "_kind"], sums={n: F.col(f"_v_{n}") for n in sums}, partitions=partitions)
    signed = lambda n: F.coalesce(F.when(F.col("_kind") == 1, F.col(n)).otherwise(-F.col(n)), F.lit(0))
    window = seen.groupBy(*keys, F.col("_for").alias("_us")).agg(*[F.sum(signed(n)).cast("bigint").alias(n) for n in sums])
    if where is not None:
        window = window.filter(where)
    if first:
        window = window.withColumn("_start", F.col("_us") - width)
        window = next_instant(instants, window, keys, "_us", "_start", "_first", after=open_start, partitions=partitions).withColumn(first, F.timestamp_micros("_first"))
    added = [*sums, *([first] if first else [])]
    window = window.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_us").alias("_kus"), *added)
    link = {**{k: f"_k{i}" for i, k in enumerate(keys)}, "_us": "_kus"}
    pieces = math.ceil((instants.agg(F.max("_n")).first()[0] or 0) / SPLIT_ROWS)  # one number
    if pieces > 1:
        rows = rows.withColumn("_piece", F.pmod(tie(df), F.lit(pieces)))
        held = rows.select(*keys, "_us", "_piece").distinct()
        window = held.join(window, same(held, window, link)).select(*window.columns, F.col("_piece").alias("_kpiece"))
        link["_piece"] = "_kpiece"
    return rows.join(window, same(rows, window, link)).select(*[rows[f"`{c}`"] for c in df.columns], *added)


def next_instant(points: DataFrame, probes: DataFrame, keys: Sequence[str], us: str, at: str, name: str, after: bool, partitions: int | None = None) -> DataFrame:
    """``probes`` with the earliest ``us`` of their key's ``points`` from ``at`` on (``after``: beyond it), in whole microseconds.

    In mirrored time the wanted instant is the last one seen before the probe, a running maximum; the
    probe's own columns ride along.
    """
    seen = points.select(*keys, (-F.col(us)).alias("_neg"), F.lit(1).alias("_kind")).distinct()
    asked = probes.select(*keys, (-F.col(at)).alias("_neg"), F.lit(0 if after else 2).alias("_kind"), tie(probes).alias("_tie"), F.struct(*[F.col(f"`{c}`") for c in probes.columns]).alias("_h"))
    merged = seen.unionByName(asked, allowMissingColumns=True)
    done = running(merged, keys, ["_neg", "_kind", "_tie"], maxes={"_last": F.when(F.col("_kind") == 1, F.col("_neg"))}, partitions=partitions)
    return done.filter(F.col("_kind") != 1).select("_h.*", (-F.col("_last")).alias(name))


def first_seen(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Earliest row per (key, value): the order columns of that row. Map-side combined."""
    return (
        df.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_o"))
        .select(*keys, value, *[F.col("_o")[c].alias(c) for c in order])
    )


def running_distinct(
    df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], name: str, partitions: int | None = None
) -> DataFrame:
    """Number of distinct values seen so far per key, as a running sum of first sightings."""
    marks = first_seen(df, keys, value, order).select(*keys, *order, F.lit(1).alias("_first"))
    # a first sighting is one of the rows itself; it goes in as a row of its own just before it
    rows = df.withColumn("_first", F.lit(0)).unionByName(marks, allowMissingColumns=True).withColumn("_mark", 1 - F.col("_first"))
    out = running(rows, keys, [*order, "_mark"], sums={name: F.col("_first")}, partitions=partitions)
    return out.filter(F.col("_first") == 0).drop("_first", "_mark")
