"""Session set-up and the few settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: settings every job assumes; none of them fixes a size that depends on the data
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # no call-site capture per Column: plans here are built from many small expressions
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # keyed streams keep maps and timers, which only this state store holds
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app_name: str = "emberwatch", master: str | None = None, **extra: str) -> SparkSession:
    """Create (or reuse) a session; the cluster's own settings win unless given in ``extra``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def has_checkpoint_dir(spark: SparkSession) -> bool:
    return bool(spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share, as ``spark.checkpoint.dir`` names it; iterative jobs need one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
