"""Hourly weather text files: metadata lines, a header line, then
``YEAR,MO,DY,HR,ALLSKY_SFC_SW_DWN,T2M,WSC`` rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.operators.ordered import DEFAULT_BLOCK_ROWS, blocked, keep_home, over_blocks
from hourgrid.operators.sinks import write_if_absent
from hourgrid.functions.timeparse import hour_from_parts
from hourgrid.schemas import WEATHER_CSV_DDL, WEATHER_VALUES

# A data line starts with a 4-digit year and three integers.
DATA_LINE = r"^\s*\d{4}\s*,\s*\d+\s*,\s*\d+\s*,\s*\d+\s*,"
# Region code inside a landed file name.
REGION_IN_NAME = r"weather_power_([^/.]+)\.csv"


def parse_weather_lines(lines: DataFrame, region: Column, missing_sentinel: float | None = None) -> DataFrame:
    """Keep data lines (so the length of the metadata header does not matter and the
    files stay splittable), parse them with a fixed schema, add region and hour."""
    d = lines.filter(F.col("value").rlike(DATA_LINE))
    d = d.select(F.from_csv(F.col("value"), WEATHER_CSV_DDL, {"ignoreLeadingWhiteSpace": "true"}).alias("w"), region.alias("region"))
    d = d.select("w.*", "region")
    if missing_sentinel is not None:
        d = d.withColumns({c: F.when(F.col(c) != F.lit(missing_sentinel), F.col(c)) for c in WEATHER_VALUES})
    return d.withColumn("datetime", hour_from_parts("year", "mo", "dy", "hr"))


def read_weather_text(
    spark: SparkSession,
    path: str,
    missing_sentinel: float | None = None,
    region_pattern: str = REGION_IN_NAME,
    region: str | None = None,
    regions: Sequence[str] | None = None,
) -> DataFrame:
    """Read every weather file under ``path`` at once.  The region comes from the
    argument ``region``, a ``region=<code>`` folder (read as text: ``007`` stays), or
    else the file name; a name that does not match raises.  ``regions`` keeps those
    only, and reads their folders only where there are such."""
    raw = spark.read.text(path)
    if region is not None:
        code = F.lit(region)
    elif "region" in raw.columns:
        raw = spark.read.schema("value STRING, region STRING").text(path)
        code = F.col("region")
    else:
        raw = raw.withColumn("_file", F.col("_metadata.file_path"))
        found = F.regexp_extract(F.col("_file"), region_pattern, 1)
        why = F.concat(F.lit("no region in the file name: "), F.col("_file"))
        code = F.when(found == "", F.raise_error(why)).otherwise(found)
    if regions is not None:
        raw = raw.where(code.isin(list(regions)))
    return parse_weather_lines(raw, code, missing_sentinel)


def write_weather(weather: DataFrame, path: str) -> str:
    """Weather hours as Parquet by region, in time order within each file, written once."""
    return write_if_absent(weather.sortWithinPartitions("region", "datetime"), path)


def time_gaps(df: DataFrame, step: str = "1 hour", keys: Sequence[str] = ("region",), ts: str = "datetime", start: str | None = None, end: str | None = None, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """(keys, gap_start, gap_end, n_missing): times ``step`` apart that a series lacks, such as those of a chunk whose
    request failed; between its first and last row, and from ``start`` and up to ``end`` (not included) where given.
    A series is never one task (``ordered``); repeated times are no gap."""
    keys, one = list(keys), F.expr(f"INTERVAL {step}")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = df.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).cast("timestamp_ntz").alias("_t"))
    d = blocked(rows, keys, "_t", before=1, block_rows=block_rows)
    d = keep_home(d.withColumn("_p", F.lag("_t").over(over_blocks(d, keys, "_t"))))
    lacks = d.where(F.col("_t") > F.col("_p") + one).select(*keys, (F.col("_p") + one).alias("gap_start"), F.col("_t").alias("gap_end"))
    ends = rows.groupBy(*keys).agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    if start is not None:
        at = F.lit(start).cast("timestamp_ntz")
        lacks = lacks.union(ends.where(F.col("_first") > at).select(*keys, at, "_first"))
    if end is not None:
        at = F.lit(end).cast("timestamp_ntz")
        lacks = lacks.union(ends.where(F.col("_last") + one < at).select(*keys, F.col("_last") + one, at))
    length = micros(F.lit("1970-01-01").cast("timestamp_ntz") + one)
    return lacks.withColumn("n_missing", F.ceil((micros(F.col("gap_end")) - micros(F.col("gap_start"))) / length))


def render_weather_lines(weather: DataFrame, header_lines: int = 14) -> DataFrame:
    """Weather rows -> text lines per region as the service writes them: metadata
    lines, the column header, then comma-separated rows (used to land test files)."""
    body = weather.select(
        "region",
        F.concat_ws(
            ",",
            *[F.col(c).cast("string") for c in ["year", "mo", "dy", "hr", "allsky_sfc_sw_dwn", "t2m", "wsc"]],
        ).alias("value"),
        F.lit(2).alias("_part"),
        F.col("datetime").alias("_t"),
    )
    regions = weather.select("region").distinct()
    meta = regions.select(
        "region",
        F.explode(
            F.array(
                *[F.lit(f"-BEGIN HEADER- line {i}" if i == 0 else f"meta {i}: value") for i in range(header_lines - 1)],
                F.lit("-END HEADER-"),
            )
        ).alias("value"),
        F.lit(0).alias("_part"),
        F.lit(None).cast("timestamp_ntz").alias("_t"),
    )
    head = regions.select(
        "region", F.lit("YEAR,MO,DY,HR,ALLSKY_SFC_SW_DWN,T2M,WSC").alias("value"), F.lit(1).alias("_part"),
        F.lit(None).cast("timestamp_ntz").alias("_t"),
    )
    return meta.unionByName(head).unionByName(body)


def land_weather(weather: DataFrame, path: str, header_lines: int = 14) -> str:
    """Write rendered weather text, one folder per region, rows in time order within
    each file.  Only a sort inside partitions: no shuffle, no global order, and a
    large region is written by many tasks."""
    lines = render_weather_lines(weather, header_lines)
    (
        lines.sortWithinPartitions("region", "_part", "_t")
        .select("region", "value")
        .write.mode("overwrite")
        .partitionBy("region")
        .text(path)
    )
    return path
