"""Written tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from py4j.protocol import Py4JError, Py4JNetworkError
from pyspark.sql import DataFrame, SparkSession

#: Written tables that a result may still read, with the JVM and the settings to delete them by.
_open: dict[str, tuple] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, in local mode only, a temporary one of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = f"file://{tempfile.gettempdir()}/codeloom-checkpoints"
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows of df, written once and read again, so that what follows doesn't compute them anew; and their path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/codeloom-{name}-{uuid.uuid4().hex}"
    _open[path] = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that nothing reads any more."""
    for path in paths:
        _delete(path, *_open.pop(path, (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())))


def _delete(path: str, jvm, settings) -> None:
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(settings).delete(where, True)


@atexit.register
def drop_rest() -> None:
    """Deletes what is left when the driver ends: a result is a plan, so the tables it reads live as long as it may be used."""
    for path, where in list(_open.items()):
        try:
            _delete(path, *where)
        except (Py4JError, Py4JNetworkError, OSError):
            return  # the JVM is gone
        _open.pop(path, None)
