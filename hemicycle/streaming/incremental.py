"""Resumable incremental processing: a file stream, each batch labelled and merged into a table by key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hemicycle.sources.tables import exists, upsert


def process_new(spark: SparkSession, source: str, schema: StructType | str, work: Callable[[DataFrame], DataFrame], target: str, keys: Sequence[str], checkpoint: str, order: str | None = None) -> None:
    """Run work over the files that have come since the last call and upsert its rows; what is done stays done."""

    def merge(batch: DataFrame, _: int) -> None:
        upsert(work(batch), target, keys, order)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()


def not_yet(rows: DataFrame, target: str, key: str) -> DataFrame:
    """Rows whose key the target lacks."""
    spark = rows.sparkSession
    return rows.join(spark.read.parquet(target).select(key).distinct(), key, "left_anti") if exists(spark, target) else rows


def windowed_counts(events: DataFrame, at: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: event counts and sums by tumbling window, late rows up to the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
