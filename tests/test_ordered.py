"""Blocked positional windows equal plain windows (any block size, any key skew)."""

import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hourgrid.operators.ordered import BLK, blocked, ffill, keep_home, measure, over_blocks, row_index


def _series(spark, seed=0, hot=300, cold=(40, 7, 1)):
    rnd = random.Random(seed)
    rows = []
    for key, n in [("hot", hot), *[(f"k{i}", m) for i, m in enumerate(cold)]]:
        ts = sorted(rnd.sample(range(10_000), n))
        for t in ts:
            rows.append((key, t, rnd.choice([None, rnd.uniform(-5, 5)])))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t long, x double")


def test_row_index_counts_each_series(spark):
    df = _series(spark)
    for block in (1, 7, 100, 10_000):
        out = row_index(df, ["k"], "t", total="n", block_rows=block).toPandas()
        assert len(out) == 348
        for _, g in out.groupby("k"):
            g = g.sort_values("t")
            assert list(g["_i"]) == list(range(len(g))) and set(g["n"]) == {len(g)}


def test_halo_blocks_match_plain_window(spark):
    df = _series(spark, seed=3)
    plain = df.withColumns(
        {
            "lag5": F.lag("x", 5).over(Window.partitionBy("k").orderBy("t")),
            "s7": F.sum("x").over(Window.partitionBy("k").orderBy("t").rowsBetween(-7, 0)),
        }
    ).toPandas()
    for block in (1, 3, 8, 50, 10_000):
        d = blocked(df, ["k"], "t", before=7, block_rows=block)
        w = over_blocks(d, ["k"], "t")
        d = d.withColumns({"lag5": F.lag("x", 5).over(w), "s7": F.sum("x").over(w.rowsBetween(-7, 0))})
        got = keep_home(d).toPandas()
        m = plain.merge(got, on=["k", "t"], suffixes=("", "_b"))
        assert len(m) == len(plain) == len(got)
        for c in ("lag5", "s7"):
            a, b = m[c], m[f"{c}_b"]
            assert ((a.isna() & b.isna()) | ((a - b).abs() < 1e-9)).all(), (block, c)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_crowded_hour_is_cut(spark):
    """Nearly all rows of a series in one hour, some in one second: no block is much above block_rows."""
    micros = [0, 10**15] + [10**14 + i for i in range(3000)] + [10**14 + 10**9 + 997 * i for i in range(4000)]
    df = spark.createDataFrame([("a", m) for m in micros] + [("b", m) for m in range(5)], "k string, m long").select("k", F.timestamp_micros("m").cast("timestamp_ntz").alias("t"), "m")
    borders = measure(df, ["k"], "t", 500, 30).first()
    assert borders.n == len(micros) and len(borders.lows) >= 12
    d = blocked(df, ["k"], "t", before=30, block_rows=500).cache()
    sizes = {r[BLK]: r["count"] for r in d.where("k = 'a' AND _home").groupBy(BLK).count().collect()}
    assert max(sizes.values()) <= 500 + 500 // 8 and sum(sizes.values()) == len(micros)
    assert d.where("NOT _home").count() <= 30 * len(sizes) and d.where("k = 'b'").count() == 5
    got = keep_home(d.withColumn("l", F.lag("m", 30).over(over_blocks(d, ["k"], "t")))).where("k = 'a'").orderBy("m").collect()
    rows = sorted(micros)
    assert [(r.m, r.l) for r in got] == [(m, rows[i - 30] if i >= 30 else None) for i, m in enumerate(rows)]


def test_one_full_exchange_a_pass(spark):
    """Rows travel once; beside that only the halo, and the borders as a broadcast."""
    df = spark.createDataFrame([("a", i, float(i)) for i in range(400)] + [("b", 1, 2.0)], "k string, t long, x double")
    d = blocked(df, ["k"], "t", before=9, block_rows=50)
    out = keep_home(d.withColumn("s", F.sum("x").over(over_blocks(d, ["k"], "t").rowsBetween(-9, 0))))
    out.collect()
    plan = _plan(out).split("Initial Plan")[0]
    reused = plan.count("ReusedExchange")
    assert plan.count("Exchange hashpartitioning") - reused == 2 and reused >= 1, plan
    assert plan.count("rangepartitioning") == 0
    small = blocked(df, ["k"], "t", before=9, block_rows=1000)
    out = keep_home(small.withColumn("s", F.sum("x").over(over_blocks(small, ["k"], "t").rowsBetween(-9, 0))))
    assert _plan(out).count("Exchange hashpartitioning") == 1


def test_wrong_orders_raise(spark):
    df = spark.createDataFrame([("a", 1.5)], "k string, t double")
    with pytest.raises(TypeError):
        measure(df, ["k"], "t")
    with pytest.raises(ValueError):
        measure(spark.createDataFrame([("a", 1)], "k string, t long"), ["k"], "t", 0)
    assert measure(spark.createDataFrame([], "k string, t long"), ["k"], "t") is None


def test_ffill_crosses_buckets_and_tables(spark):
    rows = []
    rnd = random.Random(5)
    for table in range(3):
        for r in range(60):
            rows.append((table, r, rnd.choice([None, None, None, f"s{table}_{r}"])))
    df = spark.createDataFrame(rows, "table_no int, row_no long, v string")
    got = ffill(df, "v", ["table_no", "row_no"], coarse=F.struct("table_no", F.floor(F.col("row_no") / 7)), out="f")
    got = got.toPandas().sort_values(["table_no", "row_no"])
    exp = pd.DataFrame(rows, columns=["table_no", "row_no", "v"]).sort_values(["table_no", "row_no"])
    assert list(got["f"].fillna("<na>")) == list(exp["v"].ffill().fillna("<na>"))
