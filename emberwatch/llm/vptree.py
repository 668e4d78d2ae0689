"""Nearest neighbours with one vantage-point tree per shard of vectors.

A shard is a block of vectors; its tree splits at the median distance to a vantage point and keeps,
for both halves, the least and greatest distance. By the triangle inequality a half cannot hold a
vector nearer than the gap between the query's distance and that range. A half is passed over when
``factor`` times this bound exceeds the query's k-th distance so far: factor 1 is exact search,
larger factors prune more. All queries of a block walk a tree together.

Defined results: rows with a null id, or a vector that is null, empty, zero or has null or non-finite
components take no part; vectors of different lengths do not meet; the query's own row is left out by
its id; ties go to the smaller id; a query with fewer candidates gets them all.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import merged_lists, written
from .vectors import BLOCK, packed, paired, query_blocks, unpacked, usable

LEAF = 64
LIST = "query_id bigint, vec_id bigint, score double, part int"
#: pruning allows for rounding, so that ties are never lost
SLACK = 1e-9


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances, from differences, in double precision."""
    out = np.empty((len(q), len(x)))
    for a in range(0, len(q), 128):
        d = q[a:a + 128, None, :] - x[None, :, :]
        out[a:a + 128] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def build(x: np.ndarray, rows: np.ndarray | None = None):
    """A tree over the rows of x: a leaf is an array of rows, a node (vantage row, two halves as (least, greatest, tree))."""
    rows = np.arange(len(x)) if rows is None else rows
    if len(rows) <= LEAF:
        return rows
    # the row farthest from an arbitrary one lies at the rim, where halves separate best
    vantage = rows[int(np.argmax(distances(x[rows[:1]], x[rows])[0]))]
    rest = rows[rows != vantage]
    d = distances(x[vantage][None], x[rest])[0]
    order = np.argsort(d, kind="stable")
    cut = len(order) // 2
    return vantage, [(d[part[0]], d[part[-1]], build(x, rest[part])) for part in (order[:cut], order[cut:])]


class Search:
    """k nearest rows of x for every query at once."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, factor: float):
        self.x, self.ids, self.q, self.q_ids, self.k, self.factor = x, ids, q, q_ids, k, factor
        self.d = np.full((len(q), k), np.inf)
        self.found = np.full((len(q), k), np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
        """Candidates of some queries; kept in order of distance, then id."""
        ids = np.broadcast_to(self.ids[rows], d.shape)
        d = np.where(ids == self.q_ids[at][:, None], np.inf, d)
        d, ids = np.hstack([self.d[at], d]), np.hstack([self.found[at], ids])
        first = np.lexsort((ids, d), axis=1)[:, : self.k]
        self.d[at], self.found[at] = np.take_along_axis(d, first, 1), np.take_along_axis(ids, first, 1)

    def walk(self, tree, at: np.ndarray) -> None:
        if not len(at):
            return
        if isinstance(tree, np.ndarray):
            self.add(at, tree, distances(self.q[at], self.x[tree]))
            return
        vantage, halves = tree
        d = distances(self.q[at], self.x[[vantage]])
        self.add(at, np.array([vantage]), d)
        d = d[:, 0]
        bounds = [np.maximum(0, np.maximum(low - d, d - high)) for low, high, _ in halves]
        inner_first = bounds[0] <= bounds[1]
        for who, order in ((inner_first, (0, 1)), (~inner_first, (1, 0))):
            for side in order:
                near = self.factor * bounds[side] <= self.d[at, -1] * (1 + SLACK) + SLACK
                self.walk(halves[side][2], at[who & near])


def nearest(df: DataFrame, is_query: Column, k: int = 10, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row (``is_query`` over column id)."""
    rows = usable(df, id_col, vector_col, nonzero=True)
    queries, n = query_blocks(rows.filter(is_query))

    def plant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(tree=[pickle.dumps(build(unpacked(r)[1])) for r in pdf.to_dict("records")])

    shards = written(packed(rows, BLOCK, None, "shards").mapInPandas(plant, "block int, dim int, ids binary, data binary, tree binary"), "vp-trees")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                ids, x = unpacked(row)
                q_ids, q = unpacked(row, ("q_ids", "q_data"))
                s = Search(x, ids, q, q_ids, k, factor)
                s.walk(pickle.loads(row["tree"]), np.arange(len(q)))
                i, j = np.nonzero(np.isfinite(s.d))
                yield pd.DataFrame({"query_id": q_ids[i], "vec_id": s.found[i, j], "score": s.d[i, j], "part": row["part"]})

    lists = paired(shards, queries, n).mapInPandas(search, LIST)
    return merged_lists(lists, "query_id", [F.col("score"), F.col("vec_id")], k, "part").select("query_id", "rank", "vec_id", "score")
