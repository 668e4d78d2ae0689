"""Helpers of this subpackage: written tables that cut lineage, and merged top lists."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where that is unset, a temporary folder serves a session with a local master; a cluster must set it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="run-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: whether the shuffle files of a query go when it has ended
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, and safe when executors are lost.

    What was shuffled for it is removed at once, not when the driver's memory is next cleaned.
    A ``small`` table goes into no more files than two for each core of the cluster.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANED)
    spark.conf.set(CLEANED, "true")
    try:
        (df.coalesce(2 * spark.sparkContext.defaultParallelism) if small else df).write.parquet(path)
    finally:
        spark.conf.set(CLEANED, was)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes ``written`` tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: size up to which a side of a join is sent to all tasks; beyond, both sides are shuffled
SENT_BYTES = 64 << 20


def sent(df: DataFrame, size: int) -> DataFrame:
    """A side of a join, sent whole if its size in bytes is within the bound."""
    return F.broadcast(df) if size <= SENT_BYTES else df


def columns(df: DataFrame, **named: str) -> DataFrame:
    """Only the columns an operator reads, under its own names: other columns can then never clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in named.items()])


def best(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group. Spark cuts each task's rows to ``k`` a group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def merged_lists(df: DataFrame, query: str, order: list[Column], k: int, part: str) -> DataFrame:
    """Top lists of many parts merged as a tree: lists of the parts with one number first, then those of a query."""
    first = best(df, [query, part], order, k).drop("rank")
    return best(first, [query], order, k).drop(part)
