"""Session settings and durable intermediate results."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "corpusloom", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution.

    Master and shuffle partitions are set only where they are given here, so
    that those of spark-submit or the cluster hold; without any master the
    session runs on this machine.
    """
    builder = SparkSession.builder.appName(app)
    if master or not (SparkConf().contains("spark.master") or os.environ.get("MASTER") or SparkContext._active_spark_context):
        builder = builder.master(master or "local[*]")
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k: str(v) for k, v in conf.items()}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints.

    A folder of this machine is taken only in local mode where none is named, as in tests.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "corpusloom-checkpoints")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a copy in the cluster's shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


#: Tables stored by this process, dropped when it ends.
_STORED: set[str] = set()


def _drop(path: str) -> None:
    jvm = SparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(SparkContext._active_spark_context._jsc.hadoopConfiguration() if SparkContext._active_spark_context else jvm.org.apache.hadoop.conf.Configuration()).delete(place, True)
    _STORED.discard(path)


@atexit.register
def _drop_all() -> None:
    for path in list(_STORED):
        try:
            _drop(path)
        except Exception:  # the cluster is gone; the folder is left to its owner
            return


def stored(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Cut the lineage by a table written to the cluster's shared folder, and drop the one it replaces.

    Unlike a checkpoint it starts with its true size: the size a checkpoint
    inherits is the product of all joins before it, which grows without bound in
    loops. What is not replaced may be read until the process ends, and is dropped then.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark).rstrip('/')}/corpusloom-{uuid.uuid4().hex}"
    _STORED.add(path)
    df.write.parquet(path)
    if replaces is not None and (old := getattr(replaces, "stored_in", None)):
        _drop(old)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_in = path
    return out
