"""Session settings and the shared scratch folder.

Everything in the library is lazy DataFrame code; the only session-level
choices are the ones that change results (UTC wall clock, ANSI) or plans
(AQE, skew handling).  ``scratch_path`` hands out folders below the cluster's
``spark.checkpoint.dir`` so staged files and cut lineage live on shared
storage, never on one machine's local disk.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
}


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "hourgrid", driver_memory: str | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the provided session
    and call :func:`configure` on it.  ``driver_memory``: the heap, Spark's default otherwise."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in {**SESSION_CONF, **({"spark.driver.memory": driver_memory} if driver_memory else {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the result-changing settings to an existing session."""
    for k, v in SESSION_CONF.items():
        spark.conf.set(k, v)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only in local mode, where
    none is set (tests).  On a cluster a machine's own folder would lose files: it raises."""
    root = spark.sparkContext.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="hourgrid-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir() or root
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint root for staged tables."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/hourgrid/{name}-{uuid.uuid4().hex[:12]}"


#: Paths of the staged tables of the runs that are open (see :func:`stages`).
_OPEN: list[list[str]] = []


@contextmanager
def stages(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that ``cut_lineage`` wrote inside, once their results are read."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut_lineage(df: DataFrame, name: str = "stage", partition_by: Sequence[str] = ()) -> DataFrame:
    """Cut lineage with a written table: ``df`` is computed once, written as Parquet
    below the shared checkpoint folder and read back (columnar, prunable, and it
    survives executor loss).  ``Dataset.checkpoint`` would compute ``df`` twice
    unless it were also persisted.  ``partition_by`` lays the table out by those
    columns, so that a filter on them reads their folders only."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    for run in _OPEN[-1:]:
        run.append(path)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


__all__ = ["get_spark", "configure", "checkpoint_root", "scratch_path", "cut_lineage", "stages", "SESSION_CONF"]
