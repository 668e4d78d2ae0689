"""Time bounds in a form that reaches the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def before(df: DataFrame, ts: str, as_of: Column, seconds: float = 0) -> Column:
    """The instant ``seconds`` before ``as_of``, in the type of column ``ts``.

    Compared with the bare column, it becomes a constant that the reader checks against its statistics.
    """
    bound = as_of.cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    return bound.cast(df.schema[ts].dataType)
