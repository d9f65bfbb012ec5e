"""Tables written to the shared folder: derived once, read by all that follows.

The folder is the one every executor sees, `spark.checkpoint.dir`.  Only a local session, whose
executor is the driver itself, gets one of its own where that is unset; on a cluster executors
would write where nobody else reads, so it must be named there.  What is put in the folder is
deleted when the application ends, or by `drop`.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions that name none, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as the session names it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = spark.sparkContext.applicationId
    if own not in _own:
        _own[own] = tempfile.mkdtemp(prefix="tidewell-")
    return _own[own]


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder's name below the shared one; it goes when the application ends."""
    folder = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    fs, path = _path(spark, folder)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def drop(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that nothing reads any more."""
    fs, path = _path(spark, folder)
    fs.delete(path, True)


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """`df` written as Parquet (below `folder`, else in a folder of its own) and read back: later
    readers take the columns they need, and nothing before it is computed again."""
    spark = df.sparkSession
    path = f"{folder or scratch(spark, 'table')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
