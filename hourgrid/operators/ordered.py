"""Positional (row-count) windows that stay parallel inside one huge series.

A plain ``Window.partitionBy(keys).orderBy(t)`` puts a whole series in one task; one region holding a
third of all rows would make that task a third of the job.  Here:

1. :func:`measure` counts the rows of each series (one aggregate).  A series of at most ``block_rows``
   is one block.  Larger ones are cut at borders in time that come from counts: by day, and where a day
   holds too many rows by hour, minute, second, and so on, so a crowded hour is cut as well as a long history.
2. :func:`blocked` sends every row once to its (series, block), found in the borders of its series
   by bisection.  A frame over the ``before`` preceding rows needs no more than the last rows of the blocks
   before it, the halo: only these travel again, joined to the rows where they lie (a union of two
   sides that are partitioned alike needs no exchange).
3. :func:`over_blocks` is the window over such blocks, :func:`keep_home` drops the halo afterwards.

Where all series are small, blocks are series: several passes share one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourgrid.session import cut_lineage

DEFAULT_BLOCK_ROWS = 1_000_000
IDX = "_i"
BLK = "_blk"
HOME = "_home"
#: Units of time that borders are looked for in, in microseconds: day, hour, minute, second, down to one.
UNITS = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1_000, 1)
#: Blocks whose borders are broadcast; a table with more of them is joined by its keys.
BROADCAST_BLOCKS = 500_000


def _ns_join(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``cols`` where NULL keys match each other (keys may be NULL)."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in cols else F.col(c) for c in right.columns])
    cond = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in cols]
    out = left.join(renamed, on=cond, how=how)
    return out.drop(*[f"_r_{c}" for c in cols])


def _place(df: DataFrame, ts: str) -> Column:
    """The place of a row in its order as a whole number: microseconds of a time, else the number itself."""
    kind = df.schema[ts].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(ts).cast("timestamp"))
    if isinstance(kind, T.IntegralType):
        return F.col(ts).cast("long")
    raise TypeError(f"{ts}: a series is ordered by a time or a whole number")


def measure(df: DataFrame, keys: Sequence[str], ts: str, block_rows: int = DEFAULT_BLOCK_ROWS, before: int = 0) -> DataFrame | None:
    """Borders of the series of more than ``block_rows`` rows, one row each, or None if there is none:
    ``n`` rows, and for its blocks ``lows`` (first place), ``starts`` (rows before) and ``halo`` (which later
    blocks need how many of the last rows).  Runs jobs that read the keys and ``ts`` only.

    A NULL key or place has no place in a series: it raises, no row is lost silently."""
    if block_rows < 1 or before < 0:
        raise ValueError("block_rows must be >= 1 and before >= 0")
    keys = list(keys)
    d = df.select(*keys, _place(df, ts).alias("_t"))
    per = d.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("_t").isNull()).alias("_lost"))
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    most, lost = per.agg(F.max("n"), F.count_if(no_key | (F.col("_lost") > 0))).first()
    if lost:
        raise ValueError(f"a row with a NULL in {keys} or in the order of its series cannot be numbered")
    if (most or 0) <= block_rows:
        return None
    large = cut_lineage(per.where(F.col("n") > block_rows).select(*keys, "n"), "large-series")
    rows = d.join(large.select(*keys), keys, "left_semi").withColumn("_low", F.lit(None).cast("long"))
    parts = []
    for unit in UNITS:
        low = F.col("_t") - F.pmod("_t", F.lit(unit))
        cells = cut_lineage(rows.groupBy(*keys, "_low", low.alias("low")).agg(F.count("*").alias("c")), "cells")
        crowded = (F.col("c") > max(block_rows // 8, 1)) & F.lit(unit > 1)
        parts.append(cells.where(~crowded).select(*keys, "low", "c"))
        hot = cells.where(crowded).select(*keys, F.col("low").alias("_low"))
        if hot.isEmpty():
            break
        rows = d.withColumn("_low", low).join(hot, [*keys, "_low"], "left_semi")
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.union(p)
    series = Window.partitionBy(*keys)
    prior = F.sum("c").over(series.orderBy("low")) - F.col("c")
    blocks = cells.withColumn("_b", F.floor(prior / F.lit(block_rows))).groupBy(*keys, "_b").agg(F.min("low").alias("low"), F.sum("c").alias("size"))
    blocks = blocks.withColumns({"b": F.row_number().over(series.orderBy("low")) - 1, "end": F.sum("size").over(series.orderBy("low"))})
    blocks = blocks.withColumn("next", F.lead("b").over(series.orderBy("low")))
    # the blocks that begin within `before` rows of this one's end
    near = series.orderBy("end").rangeBetween(0, max(before - 1, 0))
    needs = F.collect_list(F.when(F.col("next").isNotNull(), F.struct(F.col("next").alias("to"), F.col("end")))).over(near)
    need = F.transform("needs", lambda x: F.struct(x["to"].alias("to"), (F.lit(before) - x["end"] + F.col("end")).alias("last")))
    blocks = blocks.withColumn("needs", needs).withColumn("halo", need if before else F.array().cast("array<struct<to:int,last:bigint>>"))
    listed = F.array_sort(F.collect_list(F.struct("b", "low", (F.col("end") - F.col("size")).alias("start"), "halo")))
    out = blocks.groupBy(*keys).agg(F.sum("size").alias("n"), listed.alias("x"))
    return cut_lineage(out.select(*keys, "n", F.col("x.low").alias("lows"), F.col("x.start").alias("starts"), F.col("x.halo").alias("halo")), "borders")


def _block(lows: str, place: Column) -> Column:
    """The last block whose ``lows`` is not beyond ``place``, by bisection; 0 without borders."""
    steps = F.ceil(F.log2(F.size(lows) + 1)).cast("int")
    down = F.sequence(steps, F.lit(0))

    def step(at: Column, k: Column) -> Column:
        probe = at + F.pow(F.lit(2), k).cast("int")
        return F.when(F.get(lows, probe) <= place, probe).otherwise(at)

    return F.when(F.col(lows).isNull(), F.lit(0)).otherwise(F.aggregate(down, F.lit(0), step))


def blocked(
    df: DataFrame, keys: Sequence[str], ts: str, before: int = 0, block_rows: int = DEFAULT_BLOCK_ROWS, small: bool = False, index: str | None = None, total: str | None = None
) -> DataFrame:
    """Rows with their block (``BLK``) and, ``HOME`` = false, the halo of ``before`` rows ahead of each block.

    ``small``: :func:`measure` has found no series of more than ``block_rows`` in these rows or in
    a table that they were filtered from; nothing is counted again.  ``index`` names a column for the 0-based
    position of a row in its series, ``total`` one for the rows of the series."""
    keys = list(keys)
    borders = None if small else measure(df, keys, ts, block_rows, before)
    if borders is None:
        d = df.withColumn(HOME, F.lit(True))
        if index:
            d = d.withColumn(index, F.row_number().over(Window.partitionBy(*keys).orderBy(ts)) - F.lit(1))
        return d.withColumn(total, F.count("*").over(Window.partitionBy(*keys))) if total else d
    if borders.agg(F.sum(F.size("lows"))).first()[0] <= BROADCAST_BLOCKS:
        borders = F.broadcast(borders)
    d = df.join(borders.withColumnRenamed("n", "_n_of"), keys, "left").withColumn(BLK, _block("lows", _place(df, ts)))
    # what a row needs of its series' borders, before it travels
    d = d.withColumns({"_start": F.coalesce(F.get("starts", F.col(BLK)), F.lit(0)), "_need": F.get("halo", F.col(BLK))})
    kept = [*df.columns, BLK]
    d = d.select(*kept, *["_start"] * bool(index), *["_n_of"] * bool(total), *["_need"] * bool(before)).repartition(*keys, BLK)
    inside = Window.partitionBy(*keys, BLK)
    if index:
        d = d.withColumn(index, F.col("_start") + F.row_number().over(inside.orderBy(ts)) - F.lit(1))
        kept.append(index)
    if total:
        d = d.withColumn(total, F.coalesce("_n_of", F.count("*").over(inside)))
        kept.append(total)
    if not before:
        return d.select(*kept).withColumn(HOME, F.lit(True))
    # true for every row; it reads what the halo reads, so that both come from one exchange
    home = d.select(*kept, (F.coalesce(F.size("_need"), F.lit(0)) >= F.lit(0)).alias(HOME))
    last = d.withColumn("_last", F.row_number().over(inside.orderBy(F.desc(ts)))).where(F.col("_last") <= before)
    to = F.filter("_need", lambda x: F.col("_last") <= x["last"])
    tail = last.withColumn("_to", F.explode(to["to"])).drop(BLK).withColumnRenamed("_to", BLK)
    return home.unionByName(tail.select(*kept).repartition(*keys, BLK).withColumn(HOME, F.lit(False)))


def row_index(df: DataFrame, keys: Sequence[str], ts: str, name: str = IDX, total: str | None = None, block_rows: int = DEFAULT_BLOCK_ROWS, small: bool = False) -> DataFrame:
    """Add ``name`` = 0-based position of the row in its series by ``ts``, which should be unique in it; ``total``
    names a column for the number of rows of the series.  One exchange."""
    return keep_home(blocked(df, keys, ts, 0, block_rows, small, name, total))


def over_blocks(df: DataFrame, keys: Sequence[str], ts: str):
    """Window over one block of one series of :func:`blocked` rows, in series order."""
    return Window.partitionBy(*keys, *[c for c in (BLK,) if c in df.columns]).orderBy(ts)


def keep_home(df: DataFrame) -> DataFrame:
    """Drop the halo copies and the helper columns of the blocked window."""
    return df.filter(F.col(HOME)).drop(BLK, HOME)


def ffill(
    df: DataFrame,
    value: str,
    order: Sequence[str],
    keys: Sequence[str] = (),
    coarse: Column | None = None,
    out: str | None = None,
) -> DataFrame:
    """Forward-fill ``value`` (last non-null so far) along ``order`` without a
    single-task window.

    Rows are grouped in coarse buckets (``coarse``; default: the first order
    column).  The last non-null value of every bucket is found with a partial
    aggregate (``max_by`` skips rows whose ordering is NULL), carried across
    buckets with a window over that small per-bucket table, and joined back; the
    fill inside a bucket is a window over (keys, bucket) only.
    """
    keys = list(keys)
    out = out or value
    cb = "_fb"
    coarse = coarse if coarse is not None else F.col(order[0])
    d = df.withColumn(cb, coarse)
    ordering = F.struct(*[F.col(c) for c in order])
    last_in_bucket = d.groupBy(*keys, cb).agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), ordering)).alias("_last")
    )
    prior = Window.partitionBy(*keys).orderBy(cb).rowsBetween(Window.unboundedPreceding, -1)
    carry = last_in_bucket.select(*keys, cb, F.last("_last", ignorenulls=True).over(prior).alias("_carry"))
    d = _ns_join(d, carry, [*keys, cb], how="left")
    inside = Window.partitionBy(*keys, cb).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last(F.col(value), ignorenulls=True).over(inside), F.col("_carry"))
    return d.withColumn(out, filled).drop(cb, "_carry")
