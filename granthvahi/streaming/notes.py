"""Notes and events as streams: imported once, counted in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_notes(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Each note once, however often it is sent within ``late`` of event time; the state
    holds keys of that stretch only. Works on a batch as well."""
    if not stream.isStreaming:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def counts_by_window(stream: DataFrame, time: str, keys: list[str], length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows per window and key; a window is given out when no more late rows can come."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = rows.groupBy(F.window(time, length).alias("_w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("_w.start").alias("window_start"), *keys, "n")


def append_new(batch: DataFrame, target: str, keys: list[str]) -> None:
    """For foreachBatch: appends rows whose key the target doesn't hold yet, so that a
    batch that runs twice adds nothing the second time."""
    spark = batch.sparkSession
    try:
        seen = spark.read.parquet(target).select(*keys)
        batch = batch.join(seen, keys, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    batch.dropDuplicates(keys).write.mode("append").parquet(target)
