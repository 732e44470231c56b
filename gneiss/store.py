"""Cutting lineage with tables in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
import warnings

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Seconds of work after which the driver lets go of shuffle files of steps that nothing refers to any more.
RELEASE_AFTER = 2.0
_worked = 0.0


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where that is unset, a session without other machines, as in tests,
    gets a temporary folder; on a cluster executors would not see each other's files, so there it is an error."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named
    if not (at := sc._jsc.sc().getCheckpointDir()).isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gneiss-checkpoint-"))
        at = sc._jsc.sc().getCheckpointDir()
    return at.get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, written as a Parquet table to the shared folder and read back.

    Readers after it depend on files that outlive any executor. ``free`` deletes the table. After some seconds of
    work Spark's cleaner is asked to drop what nothing refers to any more; small steps in a row do not wait for it.
    """
    global _worked
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/gneiss-{uuid.uuid4().hex}"
    begin = time.monotonic()
    df.write.parquet(path)
    _worked += time.monotonic() - begin
    if _worked > RELEASE_AFTER:
        for _ in range(2):  # the first frees what the session holds for Python objects that are gone
            gc.collect()
            spark.sparkContext._jvm.System.gc()
        _worked = 0.0
    out = spark.read.schema(df.schema).parquet(path)
    out._gneiss_path = path
    return out


def free(df: DataFrame) -> None:
    """Deletes the table that ``cut`` wrote, once nothing reads it any more. Failing that costs disk, not the job."""
    path = getattr(df, "_gneiss_path", None)
    if path is None:
        return
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Py4JError as e:
        warnings.warn(f"{path} is left over: {e}", stacklevel=2)
