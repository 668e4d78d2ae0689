"""Sharding by fixed virtual slots, DataFrame functions only.

Every row hashes into one of ``SLOTS`` virtual slots, and stays there for good. What moves between
shards is a slot: a stored map names the shard of each slot, and rebalancing edits that map into a
new version. The map is edited from the bytes that each slot holds, so the law kept is ``bytes``:
shards of near-equal size. The slot table has a fixed number of rows, the only thing that the driver
sees.

Defined results: a null text has no bytes (size ``OVERHEAD``, checksum 0); rows with a null id are
spread by their place in the input; an empty table gives no rows and a map of empty slots; equal rows
share a slot and get different places; columns other than those named are not read.
"""

from __future__ import annotations

import bisect
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import columns, written

SLOTS = 4096
#: parts of a slot that are numbered in tasks of their own
CELLS = 64
OVERHEAD = 16


def uniform_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 1: slots dealt round."""
    return [s % shards for s in range(slots)]


def rebalanced(shard_of: list[int], size: list[int], shards: int) -> list[int]:
    """The map edited until neither moving nor swapping slots between the fullest and another shard evens them out."""
    held = [sorted((size[s], s) for s in range(len(size)) if shard_of[s] == k and size[s]) for k in range(shards)]
    load = [sum(b for b, _ in h) for h in held]
    out = list(shard_of)

    def move(entry, a, b):
        held[a].remove(entry)
        bisect.insort(held[b], entry)
        load[a] -= entry[0]
        load[b] += entry[0]
        out[entry[1]] = b

    while True:
        top = max(range(shards), key=lambda k: (load[k], k))
        for low in sorted(range(shards), key=lambda k: (load[k], k)):
            gap = load[top] - load[low]
            if gap <= 0:
                return out
            # the one slot, or the swap, that comes nearest to half the gap
            i = bisect.bisect_right(held[top], (gap // 2, len(size)))
            found = min(((abs(gap - 2 * e[0]), e, None) for e in held[top][max(0, i - 1): i + 1]), default=(gap, None, None), key=lambda x: x[0])
            for e in held[top]:
                j = bisect.bisect_right(held[low], (e[0] - gap // 2, len(size)))
                for f in held[low][max(0, j - 1): j + 1]:
                    if 0 < e[0] - f[0] < gap and abs(gap - 2 * (e[0] - f[0])) < found[0]:
                        found = (abs(gap - 2 * (e[0] - f[0])), e, f)
            if found[0] < gap:
                move(found[1], top, low)
                if found[2]:
                    move(found[2], low, top)
                break
        else:
            return out


def grown(shard_of: list[int], size: list[int], shards: int) -> list[int]:
    """The map with one shard more: slots move into the new shard only, from the fullest shards, up to its fair share."""
    out, load = list(shard_of), [0] * shards
    for s, k in enumerate(shard_of):
        load[k] += size[s]
    held = [sorted(((size[s], s) for s in range(len(size)) if shard_of[s] == k and size[s]), reverse=True) for k in range(shards)]
    share, taken = sum(load) / (shards + 1), 0
    while True:
        top = max(range(shards), key=lambda k: (load[k], k))
        fit = next((e for e in held[top] if taken + e[0] <= share), None)
        if fit is None or load[top] <= share:
            return out
        held[top].remove(fit)
        load[top] -= fit[0]
        taken += fit[0]
        out[fit[1]] = shards


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Each row's size, checksum, slot and cell; the text is read once and not carried on."""
    rows = columns(docs, id=id_col, text=text_col).select(
        "id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("crc"), F.monotonically_increasing_id().alias("at"),
    )
    rows = written(rows, "sharding-rows")
    return rows.select(
        "id", (F.col("bytes") + OVERHEAD).alias("size"), "crc", "at",
        F.pmod(F.xxhash64(F.coalesce("id", "at"), "crc"), F.lit(slots)).cast("int").alias("virtual_slot"),
        F.pmod(F.xxhash64("at"), F.lit(CELLS)).cast("int").alias("cell"),
    )


def slot_maps(spark: SparkSession, size: list[int], shards: int) -> DataFrame:
    """The stored maps: version 1 as dealt, version 2 rebalanced, version 3 with one shard more."""
    first = uniform_map(shards, len(size))
    second = rebalanced(first, size, shards)
    third = grown(second, size, shards)
    rows = [[v, s, k, size[s]] for v, m in ((1, first), (2, second), (3, third)) for s, k in enumerate(m)]
    parsed = F.from_json(F.lit(json.dumps(rows)), "array<array<bigint>>")
    table = spark.range(1).select(F.explode(parsed).alias("r")).select(
        F.col("r")[0].cast("int").alias("version"), F.col("r")[1].cast("int").alias("virtual_slot"), F.col("r")[2].cast("int").alias("shard"), F.col("r")[3].alias("bytes"))
    return written(table, "slot-map")


def sharded(docs: DataFrame, shards: int = 40, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", version: int = 2) -> DataFrame:
    """Rows with their shard under one version of the map, and their place in the shard, gapless from 0.

    Returns id, size, crc, virtual_slot, shard, place. Places: cells are counted (a fixed number of
    rows), summed over the shards, and rows numbered within a cell.
    """
    rows = slotted(docs, id_col, text_col, slots)
    cells = written(rows.groupBy("virtual_slot", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "sharding-cells")
    size = [0] * slots
    for r in cells.groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes")).collect():  # at most SLOTS rows
        size[r["virtual_slot"]] = r["bytes"]
    shard_of = slot_maps(docs.sparkSession, size, shards).filter(F.col("version") == version).select("virtual_slot", "shard")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.join(F.broadcast(shard_of), "virtual_slot").select("virtual_slot", "cell", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("virtual_slot", "cell").orderBy("id", "crc", "at")
    # starts: SLOTS * CELLS rows at most
    return rows.withColumn("nth", F.row_number().over(within)).join(F.broadcast(starts), ["virtual_slot", "cell"]).select(
        "id", "size", "crc", "virtual_slot", "shard", (F.col("start") + F.col("nth") - 1).alias("place"))
