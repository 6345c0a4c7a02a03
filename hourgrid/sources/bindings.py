"""Bind the driver's test tables to the engine's input schemas.

The test data is a TPC-H-like star schema; these functions derive from it the
four inputs the engine works on, so that every query's work grows with the
tables:

* ``panel``    - wide energy series per region and day (from lineitem),
* ``weather``  - weather series per region and day (from orders, customer),
* ``readings`` - long readings per respondent and hour (from events),
* ``sites``    - scraped site rows and coordinates (from supplier, nation).

Every function is a lazy DataFrame; the matching DuckDB SQL lives in
``hourgrid.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _day(c: str):
    """Midnight of a TIMESTAMP_NTZ (date cast: pure arithmetic, no time-zone step)."""
    return F.col(c).cast("date").cast("timestamp_ntz")


def _cents(c: str):
    """Money and quantities have two decimals: as whole cents (LONG) they add up
    exactly, in any order, on any partitioning, with plain codegen'd long adds.
    ``rint`` of x*100 is exact for such values (x*100 lies within 1e-9 of an integer)."""
    return F.rint(F.col(c) * F.lit(100.0)).cast("long")


def _exact_value(sum_units, scale: float):
    """Exact integer sum -> double (one correctly rounded division; sums < 2**53)."""
    return sum_units.cast("double") / F.lit(scale)


def _exact_mean(c: str):
    return _exact_value(F.sum(_cents(c)), 100.0) / F.count(F.col(c)).cast("double")


def _region_of_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation (25 rows) and region (5 rows) are fixed-size dimensions: broadcast is safe.
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).drop("r_regionkey")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide energy series: region x day, columns demand, da_forecast, net_generation,
    total_interchange (= net_generation - demand), solar, wind (NULL on days without)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_quantity", "l_tax", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"
    )
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    geo = F.broadcast(_region_of_nation(spark, sf_dir))
    d = li.join(sup, li.l_suppkey == sup.s_suppkey).join(geo, F.col("s_nationkey") == F.col("n_nationkey"))
    q = _cents("l_quantity")
    out = d.groupBy(
        F.col("r_name").alias("region"),
        F.col("n_regionkey").cast("string").alias("respondent"),
        _day("l_shipdate").alias("period"),
    ).agg(
        _exact_value(F.sum(q), 100.0).alias("demand"),
        _exact_value(F.sum(q * (F.lit(100) + _cents("l_tax"))), 10000.0).alias("da_forecast"),
        (_exact_value(F.sum(_cents("l_extendedprice") * (F.lit(100) - _cents("l_discount"))), 10000.0) / F.lit(1000.0)).alias(
            "net_generation"
        ),
        _exact_value(F.sum(F.when(F.col("l_returnflag") == "R", q)), 100.0).alias("solar"),
        _exact_value(F.sum(F.when(F.col("l_returnflag") == "A", q)), 100.0).alias("wind"),
    )
    return out.select(
        "period",
        "respondent",
        F.col("region").alias("respondent_name"),
        "region",
        "demand",
        "da_forecast",
        "net_generation",
        (F.col("net_generation") - F.col("demand")).alias("total_interchange"),
        "solar",
        "wind",
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather series: region x day with YEAR/MO/DY/HR parts and three measures."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    geo = F.broadcast(_region_of_nation(spark, sf_dir))
    d = orders.join(cust, orders.o_custkey == cust.c_custkey).join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    out = d.groupBy(F.col("r_name").alias("region"), _day("o_orderdate").alias("datetime")).agg(
        (_exact_mean("o_totalprice") / F.lit(1000.0)).alias("allsky_sfc_sw_dwn"),
        F.count(F.lit(1)).cast("double").alias("t2m"),
        (_exact_mean("c_acctbal") / F.lit(100.0)).alias("wsc"),
    )
    t = F.col("datetime")
    return out.select(
        F.year(t).alias("year"),
        F.month(t).alias("mo"),
        F.dayofmonth(t).alias("dy"),
        F.hour(t).alias("hr"),
        "allsky_sfc_sw_dwn",
        "t2m",
        "wsc",
        "region",
        "datetime",
    )


# Reading types of the events binding: base feed and fuel feed.
BASE_TYPES = ["signup", "purchase", "error"]
FUEL_TYPES = ["click", "view"]


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long typed readings per respondent and hour (ordinal = arrival order)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    r = (F.col("user_id") % F.lit(5)).cast("string")
    return ev.select(
        F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("period"),
        F.concat(F.lit("R"), r).alias("respondent"),
        F.concat(F.lit("Respondent "), r).alias("respondent_name"),
        F.upper(F.substring("event_type", 1, 2)).alias("type"),
        F.col("event_type").alias("type_name"),
        F.col("value"),
        F.lit("count").alias("value_units"),
        F.col("event_id").alias("ordinal"),
    )


def readings_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as they land: period and value as text in two period formats,
    with spoiled values ('n/a') and spoiled periods mixed in."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    r = (F.col("user_id") % F.lit(5)).cast("string")
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    k = F.col("event_id") % F.lit(17)
    period_txt = (
        F.when(k == 1, F.lit("2024-13-45T99"))
        .when(F.col("event_id") % 2 == 0, F.date_format(hour, "yyyy-MM-dd'T'HH"))
        .otherwise(F.date_format(hour, "yyyy-MM-dd HH:mm:ss"))
    )
    value_txt = F.when(k == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return ev.select(
        period_txt.alias("period"),
        F.concat(F.lit("R"), r).alias("respondent"),
        F.concat(F.lit("Respondent "), r).alias("respondent_name"),
        F.upper(F.substring("event_type", 1, 2)).alias("type"),
        F.col("event_type").alias("type_name"),
        value_txt.alias("value"),
        F.lit("count").alias("value_units"),
        F.col("event_id").alias("ordinal"),
    )


# Row-number stride that keeps each nation's rows together inside a table.
NATION_STRIDE = 1_000_000_000_000


def airport_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped site tables: one table per region, a state header row (upper-case
    city, no airport) before each nation's supplier rows; footnotes on some names,
    enplanements as text with thousands separators, float tails and blanks."""
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    k = F.col("s_suppkey")
    cents = F.floor(F.abs(F.col("s_acctbal")) * F.lit(100)).cast("long")
    enpl = (
        F.when(k % 11 == 0, F.lit(""))
        .when(k % 5 == 0, F.concat(F.floor(F.abs(F.col("s_acctbal"))).cast("long").cast("string"), F.lit(".0")))
        .otherwise(F.format_number(cents, 0))
    )
    rows = sup.join(F.broadcast(nat), sup.s_nationkey == nat.n_nationkey).select(
        F.col("n_regionkey").alias("table_no"),
        (F.col("n_nationkey") * F.lit(NATION_STRIDE) + k * 2 + 1).alias("row_no"),
        F.when(k % 3 == 0, F.concat(F.col("s_name"), F.lit("[1]"))).otherwise(F.col("s_name")).alias("City"),
        F.concat(F.lit("Field "), k.cast("string"), F.when(k % 4 == 0, F.lit(" [a] ")).otherwise(F.lit(""))).alias("Airport"),
        F.concat(F.lit("F"), k.cast("string")).alias("FAA"),
        F.when(k % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("s_name")).alias("IATA"),
        F.concat(F.lit("K"), k.cast("string")).alias("ICAO"),
        enpl.alias("Enplanements"),
    )
    headers = nat.select(
        F.col("n_regionkey").alias("table_no"),
        (F.col("n_nationkey") * F.lit(NATION_STRIDE)).alias("row_no"),
        F.upper(F.col("n_name")).alias("City"),
        *[F.lit(None).cast("string").alias(c) for c in ["Airport", "FAA", "IATA", "ICAO", "Enplanements"]],
    )
    return rows.unionByName(headers)


def coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinate list keyed by a site code in lower case; some coordinates missing."""
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    k = F.col("s_suppkey")
    miss = k % 7 == 0
    return sup.select(
        F.lower(F.col("s_name")).alias("iata_code"),
        F.when(miss, F.lit(None)).otherwise(F.col("s_acctbal") / F.lit(111.0)).alias("latitude_deg"),
        F.when(miss, F.lit(None)).otherwise(F.col("s_nationkey") * F.lit(-3.3333333)).alias("longitude_deg"),
    )


def region_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State -> region table for the bound data (title-cased nation -> region name)."""
    return _region_of_nation(spark, sf_dir).select(
        F.initcap(F.col("n_name")).alias("state"), F.col("r_name").alias("region")
    )
