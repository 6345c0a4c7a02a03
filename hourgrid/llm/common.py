"""Helpers shared by the operators: staged tables, safe column names, ASCII words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.session import checkpoint_root

#: Rows of one Arrow batch sent to Python: texts can be long, so batches stay small.
BATCH_ROWS = 512


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: the lineage is
    cut, the rows are computed once and survive a lost executor.  What was shuffled on the way
    goes as soon as the table is written."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/hourgrid-llm/{name}-{uuid.uuid4().hex[:12]}"
    with _settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


@contextmanager
def released(*tables: DataFrame) -> Iterator[None]:
    """Remove the files of these staged tables at the end, once what reads them is written, too."""
    yield
    remove(*tables)


def remove(*tables: DataFrame) -> None:
    """Remove the files of staged tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores put in front until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a row number, written once.  The numbers follow the splits of one scan, which
    follow the cores registered when it is planned: a second scan may number other rows so.
    Every later read of the written table gives the same ones."""
    return staged(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def with_row_place(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name``, a struct of two numbers that tells its rows apart in every scan: file and place
    in it where ``df`` reads Parquet files, else a row number written once (:func:`with_row_id`)."""
    try:
        return df.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")))
    except AnalysisException:
        at = fresh(df, "row")
        return with_row_id(df, at).withColumn(name, F.struct(F.lit(0).cast("long").alias("f"), F.col(at).alias("i"))).select(*df.columns, name)


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch (memory of a Python worker) for the session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: str = "8m") -> Iterator[None]:
    """Bound the rows and bytes of an Arrow batch for the jobs that run inside; the session's
    own bounds come back afterwards."""
    with _settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}):
        yield


__all__ = ["BATCH_ROWS", "arrow_batches", "bounded_batches", "fresh", "released", "remove", "staged", "table", "with_row_id", "with_row_place"]
