"""Streaming forms of the pipeline: exact copies, growing counts and windows, all with bounded state and a checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import text as tx


def read(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def first_copies(stream: DataFrame, text: str, time: str, late: str = "7 days") -> DataFrame:
    """The first row of each text, as far back as the watermark."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).withColumn("fp", F.md5(text))
    return rows.dropDuplicatesWithinWatermark(["fp"])


def clean(stream: DataFrame, text: str, low: int = 5, high: int = 200) -> DataFrame:
    return stream.withColumn(text, tx.collapse_blanks(F.col(text))).filter(tx.is_valid(F.col(text), low, high))


def counts(stream: DataFrame, label: str) -> DataFrame:
    return stream.groupBy(label).agg(F.count("*").alias("n"))


def windowed(stream: DataFrame, time: str, label: str, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Counts per window and label; a window closes when the watermark passes it."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, width).start.alias("start"), label).agg(F.count("*").alias("n"))


def run(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs all there is to the end, exactly once across restarts, into a Parquet folder."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
