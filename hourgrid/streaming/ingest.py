"""Incremental landing of reading pages with Structured Streaming.

New page files appear in a landing folder as the download runs.  The stream
explodes and parses them and appends the long readings to a Parquet table;
the checkpoint makes every file count exactly once, so a rerun (or a lost
executor) never duplicates or drops rows.  ``trigger(availableNow=True)``
processes what is there and stops, which suits a batch scheduler.

:func:`stream_hours` is the streaming form of the long -> wide step: readings
may arrive late, so an hour is emitted once the event-time watermark has
passed it (append mode), with the same first-by-arrival rule as the batch pivot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.operators.reshape import arrival_order, parse_readings
from hourgrid.schemas import ENERGY_KEYS
from hourgrid.sources.pages import WHOLE_BYTES, documents, rows_of


def page_stream(spark: SparkSession, landing_dir: str, max_files: int = 1000, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Streaming DataFrame of parsed readings from page files under ``landing_dir``: small files whole, larger
    ones by line, in splits (``sources.pages``)."""
    reader = lambda: spark.readStream.option("maxFilesPerTrigger", max_files)
    # lines of one split share its start; a stream cannot number rows
    return parse_readings(rows_of(documents(reader, landing_dir, number=F.col("_metadata.file_block_start"), whole_bytes=whole_bytes)))


def ingest_pages(
    spark: SparkSession,
    landing_dir: str,
    out_path: str,
    checkpoint: str,
    partition_by: str = "respondent",
    whole_bytes: int = WHOLE_BYTES,
) -> str:
    """Append every not-yet-seen page file under ``landing_dir`` to ``out_path``
    (Parquet, partitioned by ``partition_by``) and stop when caught up."""
    q = (
        page_stream(spark, landing_dir, whole_bytes=whole_bytes)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .partitionBy(partition_by)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out_path)
    )
    q.awaitTermination()
    return out_path


def stream_hours(
    readings: DataFrame,
    types: Mapping[str, str],
    lateness: str,
    keys: Sequence[str] = tuple(ENERGY_KEYS),
) -> DataFrame:
    """Watermarked streaming pivot: one wide row per hour, emitted when final.

    Readings that come more than ``lateness`` behind the newest are left out (Spark counts them
    as ``numRowsDroppedByWatermark``); the batch pivot takes them all."""
    keys = list(keys)
    ok = F.col("value").isNotNull() & F.col("type_name").isin(list(types))
    # watermarks need TIMESTAMP: an LTZ copy of the hour (same instant under the UTC session)
    d = readings.filter(ok).withColumn("_event_time", F.col("period").cast("timestamp"))
    d = d.withWatermark("_event_time", lateness)
    order = arrival_order(readings)
    aggs = [F.min_by(F.col("value"), F.when(F.col("type_name") == F.lit(t), order)).alias(c) for t, c in types.items()]
    return d.groupBy("_event_time", *keys).agg(*aggs).drop("_event_time")
