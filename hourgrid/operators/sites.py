"""One representative site per region from scraped site tables.

Steps: header rows set the state for the rows below them (forward fill in
source order) -> keep the site columns -> clean text -> attach coordinates ->
map state to region -> drop an excluded code -> per region, the busiest site,
taking the first non-null value of every column in busiest-first order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.functions.text import digits_to_double, drop_footnotes, is_header_text, title_case, upper_code
from hourgrid.operators.ordered import ffill
from hourgrid.schemas import EXCLUDED_SITE, STATE_REGION

SITE_COLS = ["State", "City", "Airport", "FAA", "IATA", "ICAO", "Enplanements"]
ORDER = ["table_no", "row_no"]
# Rows per forward-fill bucket inside one table.
FFILL_BUCKET_ROWS = 1 << 20


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Stack the scraped tables that have both City and Airport columns; missing
    columns become NULL.  Each table must carry (table_no, row_no)."""
    keep = [t for t in tables if "City" in t.columns and "Airport" in t.columns]
    if not keep:
        raise ValueError("no table with City and Airport columns")
    out = keep[0]
    for t in keep[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def fill_states(rows: DataFrame, bucket_rows: int = FFILL_BUCKET_ROWS) -> DataFrame:
    """Header rows (upper-case City, no Airport) give ``State`` to the rows that follow
    them in (table_no, row_no) order, across table borders; header rows are dropped.
    Only the site columns that exist are kept, plus the order columns."""
    hdr = is_header_text("City", "Airport")
    d = rows.withColumn("_hdr", hdr).withColumn("State", F.when(F.col("_hdr"), F.col("City")))
    coarse = F.struct(F.col("table_no"), F.floor(F.col("row_no") / F.lit(bucket_rows)))
    d = ffill(d, "State", ORDER, coarse=coarse)
    d = d.filter(~F.col("_hdr"))
    return d.select(*ORDER, *[c for c in SITE_COLS if c in d.columns])


def clean_sites(df: DataFrame) -> DataFrame:
    """Footnotes off City/Airport, Enplanements to a number, State in title case."""
    has = {"Enplanements": digits_to_double("Enplanements")} if "Enplanements" in df.columns else {}
    # tables without the column give no weight: every site is as busy as any other
    none = {} if has else {"Enplanements": F.lit(None).cast("double")}
    return df.withColumns(
        {"City": drop_footnotes("City"), "Airport": drop_footnotes("Airport"), **has, **none, "State": title_case("State")}
    )


def attach_coords(sites: DataFrame, coords: DataFrame) -> DataFrame:
    """Left join on the site code (coordinate codes upper-cased first; NULL codes
    never match); drop FAA/ICAO/iata_code; round coordinates to 4 places.

    The coordinate list grows with the world's sites, so no broadcast hint: AQE
    broadcasts it at run time only if its measured size is under the threshold."""
    c = coords.select(
        upper_code("iata_code").alias("iata_code"),
        F.col("latitude_deg").cast("double").alias("latitude_deg"),
        F.col("longitude_deg").cast("double").alias("longitude_deg"),
    )
    out = sites.join(c, sites["IATA"] == c["iata_code"], "left")
    out = out.drop(*[x for x in ("FAA", "ICAO", "iata_code") if x in out.columns])
    return out.withColumns(
        {"latitude_deg": F.round("latitude_deg", 4), "longitude_deg": F.round("longitude_deg", 4)}
    )


def region_table(spark: SparkSession, mapping: Mapping[str, str] = STATE_REGION) -> DataFrame:
    """The state -> region constant as a two-column DataFrame."""
    return spark.createDataFrame(sorted(mapping.items()), "state string, region string")


def map_region(sites: DataFrame, regions: DataFrame, state_col: str = "State") -> DataFrame:
    """Region of each row from its state; unmapped -> NULL.  The map is one row per
    state (bounded by the number of states), so it is broadcast."""
    r = regions.select(F.col("state").alias("_state"), F.col("region").alias("Region"))
    return sites.join(F.broadcast(r), sites[state_col] == r["_state"], "left").drop("_state")


def exclude_code(df: DataFrame, code: str = EXCLUDED_SITE, col: str = "IATA") -> DataFrame:
    """Drop one site code; rows with no code stay."""
    return df.filter(~F.col(col).eqNullSafe(F.lit(code)))


def busiest_site(df: DataFrame, region: str = "Region", weight: str = "Enplanements", tie: str = "IATA") -> DataFrame:
    """Per region, every column's first non-null value when rows are ranked by
    ``weight`` descending (missing weights last, ties by ``tie``).  One partial
    aggregate per region, no sort: ``min_by`` skips rows whose rank key is NULL."""
    rank = F.struct(F.col(weight).isNull(), -F.col(weight), F.col(tie), *[F.col(c) for c in ORDER if c in df.columns])
    cols = [c for c in df.columns if c != region and c not in ORDER]
    aggs = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in cols]
    # Ties on (weight, tie) fall back to source order when the order columns are present.
    return df.filter(F.col(region).isNotNull()).groupBy(region).agg(*aggs)


def snake(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])
