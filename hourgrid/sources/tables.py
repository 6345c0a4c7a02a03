"""Readers of landed tables: energy hours (CSV), model tables (Parquet by region), coordinates (CSV)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourgrid.operators.sinks import read_table
from hourgrid.schemas import COORDS, DBL, ENERGY_KEYS, ENERGY_TYPES, FUEL_TYPES, STR, TS

ENERGY_COLS = [*ENERGY_KEYS, *ENERGY_TYPES.values(), *FUEL_TYPES.values()]


def energy_schema(values: Sequence[str] = (*ENERGY_TYPES.values(), *FUEL_TYPES.values())) -> T.StructType:
    return T.StructType([T.StructField("period", TS), *[T.StructField(c, STR) for c in ENERGY_KEYS[1:]], *[T.StructField(c, DBL) for c in values]])


def read_energy_csv(spark: SparkSession, path: str, regions: Sequence[str] | None = None, values: Sequence[str] = (*ENERGY_TYPES.values(), *FUEL_TYPES.values())) -> DataFrame:
    """Energy hours from CSV files with a header, columns by position, one schema for all files.
    A line that does not fit raises.  ``region`` is the ``region=<code>`` folder (read as text,
    and pruned by ``regions``) or else the respondent."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
    schema = energy_schema(values)
    in_folders = "region" in spark.read.text(path).columns
    df = reader.schema(schema.add("region", STR) if in_folders else schema).csv(path)
    if not in_folders:
        df = df.withColumn("region", F.col("respondent"))
    return df if regions is None else df.where(F.col("region").isin(list(regions)))


def read_model_table(spark: SparkSession, path: str, regions: Sequence[str] | None = None) -> DataFrame:
    """A model table that was written by region; ``regions`` prune its folders."""
    return read_table(spark, path, regions=regions)


def read_coords_csv(spark: SparkSession, path: str) -> DataFrame:
    """Site coordinates from a CSV file with many columns, found by the names of its header."""
    wide = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    return wide.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in COORDS.fields])


__all__ = ["energy_schema", "read_coords_csv", "read_energy_csv", "read_model_table"]
