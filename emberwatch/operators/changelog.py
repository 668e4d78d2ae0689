"""State kept as an append-only change log (ALR-02, INC-02, INV-07, TSK-01).

A change row holds the id, the time and only the columns it changes (the rest null). The current
state is the initial row overlaid with, per column, the newest change that set it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_state(initial: DataFrame, changes: DataFrame, key: str, columns: list[str], at: str = "changed_at", order: str | None = None) -> DataFrame:
    """Latest value per column and key. One combined aggregate; a key's changes are never gathered."""
    rank = F.struct(*[F.col(c) for c in ([at, order] if order else [at])])
    newest = changes.groupBy(key).agg(
        F.max(at).alias("_at"),
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(f"_n_{c}") for c in columns])
    joined = initial.join(newest, key, "left")
    out = joined.withColumns({c: F.coalesce(F.col(f"_n_{c}"), F.col(c)) if c in initial.columns else F.col(f"_n_{c}") for c in columns})
    if "updated_at" in initial.columns:
        out = out.withColumn("updated_at", F.coalesce("_at", "updated_at"))
    else:
        out = out.withColumn("updated_at", F.col("_at"))
    return out.drop("_at", *[f"_n_{c}" for c in columns])


def page(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0, **equal) -> DataFrame:
    """Filter by equality (None is no filter), order, skip, take. Without a limit all rows come."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    df = df.orderBy(*order)
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    """(dimension, value, n): the total and one count per value of each column. The total is there for no rows too.

    Rows are counted by all columns together, in one pass, and the few counts summed up per column.
    """
    each = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    by_value = each.select(F.explode(pairs).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n")).select("p.dimension", "p.value", "n")
    total = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("dimension"), F.lit(None).cast("string").alias("value"), "n")
    return by_value.unionByName(total)
