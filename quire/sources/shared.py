"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_cleared: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only on a local master where that is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application wrote; results that read them must have been consumed."""
    _delete(spark, f"{shared_dir(spark)}/quire-{spark.sparkContext.applicationId}")


def _at_exit(spark: SparkSession) -> None:
    """A session that was stopped, or whose JVM is gone, leaves its tables to whoever tidies the folder."""
    if spark.sparkContext._jsc is not None:
        with contextlib.suppress(Py4JError, OSError):
            clear(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, is computed once.

    Tables of an application lie in one folder of its own, which goes with
    `clear`, when the driver ends and its session still runs, or a table at a
    time with `discard`.
    """
    spark = df.sparkSession
    application = spark.sparkContext.applicationId
    if application not in _cleared:
        _cleared.add(application)
        atexit.register(_at_exit, spark)
    path = f"{shared_dir(spark)}/quire-{application}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes a table that `written` made and nothing will read any more."""
    _delete(table.sparkSession, table.written_at)
