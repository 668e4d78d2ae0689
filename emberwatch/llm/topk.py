"""Exact top-k by inner product: tiled matrix products, a partial selection per tile, merged lists.

Data and queries are packed into blocks; every pair of blocks is one tile, a matrix product whose k
best columns per query leave the task. Lists are merged as a tree. Components are whole numbers, so
scores are exact: float64 products while they stay below 2**53, Python's integers otherwise (kept
within 64 bits at the end).

Defined results: rows with a null id, a null vector or null or non-finite components take no part;
vectors of different lengths do not meet; a query's own row is left out by its id; ties go to the
smaller id; a query with fewer candidates gets them all; repeated ids are candidates of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import merged_lists
from .vectors import BLOCK, packed, paired, query_blocks, unpacked, usable

SCALE = 1024
#: products of whole numbers are exact in float64 up to here
EXACT = 2.0**53
LIST = "query_id bigint, vec_id bigint, score bigint, part int"


def scaled(m: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as whole doubles."""
    return np.floor(SCALE * m)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of two sets of whole vectors."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    if np.abs(q).max() * np.abs(x).max() * q.shape[1] < EXACT:
        return (q @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(q) @ whole(x).T, -(2**63), 2**63 - 1).astype(np.int64)


def tile_best(q_ids: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> Iterator[tuple]:
    """The k best (id, score) of each query; ids ascend, so equal scores stay in order of id."""
    for i, q in enumerate(q_ids):
        free = np.flatnonzero(ids != q)
        s = score[i, free]
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            keep = s >= least
            free, s = free[keep], s[keep]
        first = np.argsort(-s.astype(np.float64) if len(s) and np.abs(s).max() < EXACT else np.array([-int(v) for v in s], object), kind="stable")[:k]
        yield q, ids[free[first]], s[first]


def top_products(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query row (``is_query`` over column id)."""
    rows = usable(df, id_col, vector_col, nonzero=False)
    blocks = packed(rows, BLOCK, scaled, "data-blocks")
    queries, n = query_blocks(rows.filter(is_query), scaled)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                ids, x = unpacked(row)
                q_ids, q = unpacked(row, ("q_ids", "q_data"))
                found = [(np.full(len(i), a), i, s) for a, i, s in tile_best(q_ids, ids, products(q, x), k)]
                if found:
                    a, i, s = (np.concatenate(c) for c in zip(*found))
                    yield pd.DataFrame({"query_id": a, "vec_id": i, "score": s, "part": row["part"]})

    lists = paired(blocks, queries, n).mapInPandas(search, LIST)
    return merged_lists(lists, "query_id", [F.col("score").desc(), F.col("vec_id")], k, "part").select("query_id", "rank", "vec_id", "score")
