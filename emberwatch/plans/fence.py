"""Evaluation fence between two steps of a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame) -> DataFrame:
    """Columns computed here are computed once, and only those that are read above.

    Catalyst rewrites a filter on a computed column into the column's definition and evaluates that
    again; with rules built from many patterns this doubles at every step. No filter or projection is moved
    through a generator with a random argument; it gives one row for a row, without a shuffle or a copy
    to disk. Columns that nobody reads are still pruned below it.
    """
    return df.select("*", F.explode(F.array(F.rand(0))).alias("_fence")).drop("_fence")
