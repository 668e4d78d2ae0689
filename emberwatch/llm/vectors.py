"""Vectors packed into blocks, and the pairing of query blocks with data blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import columns, written

BLOCK = 4096
QUERIES_A_BLOCK = 2048
#: ids and float64 vectors of one dimension; block: the number of the partition
PACKED = "block int, dim int, ids binary, data binary"


def usable(df: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> DataFrame:
    """Rows with an id and a vector of finite components (and, if asked, not all zero), as doubles."""
    v = F.col("v")
    ok = v.isNotNull() & F.col("id").isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    if nonzero:
        ok = ok & F.exists(v, lambda x: x != 0)
    rows = columns(df, id=id_col, v=vector_col).select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v"))
    return rows.filter(ok)


def packed(rows: DataFrame, size: int | None, change: Callable[[np.ndarray], np.ndarray] | None = None, name: str = "blocks") -> DataFrame:
    """The rows of each partition as blocks of ``size`` vectors (one block a partition and dimension if None), without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = TaskContext.get().partitionId(), {}

        def block(dim, ids, vectors):
            ids, m = np.asarray(ids, np.int64), np.asarray(vectors, np.float64).reshape(len(ids), dim)
            by_id = np.argsort(ids, kind="stable")
            return pd.DataFrame({"block": [at], "dim": [dim], "ids": [ids[by_id].tobytes()], "data": [(change(m[by_id]) if change else m[by_id]).tobytes()]})

        for pdf in batches:
            for i, v in zip(pdf["id"], pdf["v"]):
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
                if size and len(ids) >= size:
                    yield block(len(v), *held.pop(len(v)))
        for dim, (ids, vectors) in sorted(held.items()):
            yield block(dim, ids, vectors)

    return written(rows.mapInPandas(run, PACKED), name)


def unpacked(row, what=("ids", "data")) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[what[0]], np.int64)
    return ids, np.frombuffer(row[what[1]], np.float64).reshape(len(ids), -1)


def query_blocks(rows: DataFrame, change=None) -> tuple[DataFrame, int]:
    """The query set in blocks of about ``QUERIES_A_BLOCK``, and the number of blocks."""
    n = max(1, math.ceil(rows.count() / QUERIES_A_BLOCK))
    return packed(rows.repartition(n), None, change, "query-blocks"), n


def paired(blocks: DataFrame, queries: DataFrame, n_queries: int) -> DataFrame:
    """Every data block beside every query block of its dimension: an equi-join on the query block's number.

    A second key deals the data blocks of one query block to many tasks; query blocks are copied for
    each of its values. Columns: ids, data, dim, q_ids, q_data, part (the second key).
    """
    ways = max(1, 2 * blocks.sparkSession.sparkContext.defaultParallelism)
    left = blocks.withColumn("part", F.pmod(F.xxhash64("block", "ids"), F.lit(ways)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    right = queries.select(F.col("block").alias("q"), "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return left.join(right, ["q", "part", "dim"])
