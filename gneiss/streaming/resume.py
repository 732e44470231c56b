"""Incremental work: only what has no output yet, as a batch or as a stream of new files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def not_yet(rows: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Rows whose key has no output under ``path``; all of them if there is no output at all."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return rows
    return rows.join(spark.read.parquet(path).select(*key).distinct(), key, "left_anti")


def follow(spark: SparkSession, folder: str, schema: StructType | str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, kind: str = "json", stream: Callable[[DataFrame], DataFrame] | None = None, files: int | None = None):
    """Runs ``work`` on files as they arrive and appends the result; the checkpoint remembers what was done, so each
    file counts once however often this is stopped and started again. ``stream`` is work on the stream itself, with
    state; ``files`` bounds how many a micro-batch takes, oldest first."""
    source = spark.readStream.schema(schema).format(kind)
    new = (source.option("maxFilesPerTrigger", files) if files else source).load(folder)
    if stream:
        new = stream(new)

    def step(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return new.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
