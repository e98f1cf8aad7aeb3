"""Tables written between the rounds of an iteration, in the folder that all machines share; and small inputs dealt to all cores."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame

#: Written tables, with the JVM and the settings to delete them by.
_open: dict[str, tuple] = {}
#: An input of fewer bytes for each core, in fewer partitions than there are cores, is dealt out anew before costly expressions.
SMALL = 32 << 20


def _shared(spark) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, in local mode only, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = f"file://{tempfile.gettempdir()}/codeloom-rounds"
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows of df from a written table, and its path."""
    path = folder_of(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def folder_of(spark, name: str) -> str:
    """A new folder among the written tables, deleted when the driver ends."""
    path = f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"
    _open[path] = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    return path


def drop(*paths: str) -> None:
    """Deletes written tables that nothing reads any more."""
    for path in paths:
        if path in _open:
            jvm, settings = _open.pop(path)
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(settings).delete(where, True)


@atexit.register
def drop_rest() -> None:
    """Deletes what is left when the driver ends: results are plans, so the tables they read live as long as they may be used."""
    for path in list(_open):
        try:
            drop(path)
        except (Py4JError, OSError):
            return  # the JVM is gone


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if it is small and its files are fewer: one file of one row group would keep one core busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SMALL * cores or not 0 < len(df.inputFiles()) < cores:
        return df
    return df.repartition(cores)
