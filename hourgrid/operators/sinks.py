"""Write outputs once: existing results are never refreshed, half-written ones do not exist.

A table lies below its path as::

    attempt=<id>/<part>=<value>/...          rows of one attempt, by partition value
    _values/<id>/                            the partition values that the attempt wrote
    _locks/<number>, _commits/<number>-<id>  an attempt that ended: written last

A commit gets the next free number, whose lock only one writer can create.  An attempt
without a commit is not part of the table, so a writer that dies half-way leaves its regions absent.  Of two
writers of the same region the one with the smaller number counts; the copy of the other is never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTEMPT = "attempt"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it names."""
    p, fs = _fs(spark, path)
    return fs.exists(p)


def commits(spark: SparkSession, path: str) -> dict[str, int]:
    """Number of the commit of each attempt that ended: a file a call that wrote."""
    p, fs = _fs(spark, f"{path}/_commits")
    if not fs.exists(p):
        return {}
    out = {}
    for f in fs.listStatus(p):
        number, _, attempt = f.getPath().getName().partition("-")
        if attempt:
            out[attempt] = int(number)
    return out


def _commit(spark: SparkSession, path: str, attempt: str) -> None:
    """Take the next free number (a lock file, created only if absent), then write the commit that names
    the attempt.  A number whose writer died in between stays without a commit."""
    number = max(commits(spark, path).values(), default=-1) + 1
    while True:
        p, fs = _fs(spark, f"{path}/_locks/{number:08d}")
        last = max(commits(spark, path).values(), default=-1) if fs.createNewFile(p) else number
        if last < number:
            break
        # held by another writer, or others have gone past it: what is committed keeps its place
        number = last + 1
    p, fs = _fs(spark, f"{path}/_commits/{number:08d}-{attempt}")
    fs.createNewFile(p)


def _values(spark: SparkSession, path: str, part: str, attempts: dict[str, int]) -> DataFrame:
    """(part, attempt): the attempt that holds each committed value, that with the smallest number."""
    numbers = spark.createDataFrame(sorted(attempts.items()), f"{ATTEMPT} string, _number long")
    schema = T.StructType([T.StructField(part, T.StringType()), T.StructField(ATTEMPT, T.StringType())])
    values = spark.read.schema(schema).parquet(*[f"{path}/_values/{a}" for a in attempts])
    return values.join(F.broadcast(numbers), ATTEMPT).groupBy(part).agg(F.min_by(ATTEMPT, "_number").alias(ATTEMPT), F.count("*").alias("_copies"))


def committed(spark: SparkSession, path: str, part: str = "region") -> DataFrame:
    """The values of ``part`` that the table has."""
    attempts = commits(spark, path)
    if not attempts:
        return spark.createDataFrame([], T.StructType([T.StructField(part, T.StringType())]))
    return _values(spark, path, part, attempts).select(part)


def read_table(spark: SparkSession, path: str, schema=None, part: str = "region", regions=None) -> DataFrame:
    """A table written by :func:`write_if_absent`.  ``part`` is read as text, so codes such as
    ``007`` stay as they are; ``regions`` become a partition filter, and so does what is committed."""
    attempts = commits(spark, path)
    if not attempts:
        raise FileNotFoundError(f"no committed table at {path}")
    if schema is None:
        inside = spark.read.option("recursiveFileLookup", True).parquet(*[f"{path}/{ATTEMPT}={a}" for a in attempts]).schema
        schema = inside.add(part, "string")
    df = spark.read.schema(T.StructType([*schema.fields, T.StructField(ATTEMPT, T.StringType())])).parquet(path)
    df = df.where(F.col(ATTEMPT).isin(list(attempts)))
    if regions is not None:
        df = df.where(F.col(part).isin(list(regions)))
    if len(attempts) > 1:
        held = _values(spark, path, part, attempts)
        if not held.where("_copies > 1").isEmpty():
            held = held.select(F.col(part).alias("_value"), F.col(ATTEMPT).alias("_held"))
            df = df.join(held, F.col(part).eqNullSafe(F.col("_value")) & (F.col(ATTEMPT) == F.col("_held")), "left_semi")
    return df.select([f.name for f in schema.fields])


def write_if_absent(df: DataFrame, path: str, part: str = "region", per_partition: bool = True) -> str:
    """Write ``df`` as Parquet partitioned by ``part``, with a commit at the end.

    ``per_partition=False``: the whole table is skipped if ``path`` has a commit.
    ``per_partition=True``: only partition values not yet committed are written
    (anti-join where NULL matches NULL), so a rerun fills gaps but never rewrites a region that is already there.
    Where nothing is left to write, the plan of ``df`` runs for ``part`` only."""
    spark = df.sparkSession
    todo = df.withColumn(part, F.col(part).cast("string"))
    if commits(spark, path):
        if not per_partition:
            return path
        have = committed(spark, path, part).select(F.col(part).alias("_have"))
        todo = todo.join(have, F.col(part).eqNullSafe(F.col("_have")), "left_anti")
        if todo.select(part).isEmpty():
            return path
    attempt = uuid.uuid4().hex[:12]
    todo.write.partitionBy(part).parquet(f"{path}/{ATTEMPT}={attempt}")
    written = spark.read.schema(T.StructType([*[f for f in todo.schema.fields if f.name != part], T.StructField(part, T.StringType())])).parquet(f"{path}/{ATTEMPT}={attempt}")
    values = written.select(part).distinct().withColumn(ATTEMPT, F.lit(attempt))
    values.write.parquet(f"{path}/_values/{attempt}")
    _commit(spark, path, attempt)
    return path
