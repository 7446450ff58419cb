"""Collections over time as a stream: each file of a folder is one point of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def stream(spark: SparkSession, folder: str, schema: T.StructType | str, kind: str = "parquet", files_per_batch: int = 1, **options: str) -> DataFrame:
    """A streaming table of the files of a folder, ``files_per_batch`` of them a batch, with ``__file__``."""
    r = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).options(**options)
    return r.load(folder).withColumn("__file__", F.col("_metadata.file_name"))


def windowed(events: DataFrame, time: str, every: str, late: str, keys: list[str], aggregates: list) -> DataFrame:
    """Aggregates per time window and key, with a watermark for late rows; for batches as well."""
    base = events.withWatermark(time, late) if events.isStreaming else events
    return base.groupBy(F.window(time, every).alias("window"), *keys).agg(*aggregates)
