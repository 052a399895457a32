"""Micro-batch append, keyed dedup and windowed counts with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tacticmill.session import shared_path


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 1, glob: str | None = None) -> DataFrame:
    """A Parquet folder as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def first_by_key(stream: DataFrame, keys: list[str], time: str, late: str = "3650 days") -> DataFrame:
    """Keyed dedup whose state expires behind the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, key: str, value: str, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    w = stream.withWatermark(time, late).groupBy(F.window(time, length), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), key, "n", "total")


def drain(stream: DataFrame, out: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs a stream over all that is there and gives the table it wrote; the checkpoint lies beside it, so a rerun goes on."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}.checkpoint").trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", out).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def append_unseen(keys: list[str], out: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends the rows whose key is not in the table yet; a batch delivered twice adds nothing."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(out)
        fresh = batch.dropDuplicates(keys)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(out).select(*keys), keys, "left_anti")
        fresh.write.mode("append").parquet(out)

    return sink


def fresh_output(spark: SparkSession, label: str) -> str:
    return shared_path(spark, label)
