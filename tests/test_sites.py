"""Site selection: header rows, footnotes, numbers in text, first non-null per column."""


from hourgrid.operators.sites import clean_sites, exclude_code, fill_states, map_region
from hourgrid.plans.pipelines import build_region_sites
from hourgrid.schemas import AIRPORT_ROWS, COORDS


def _rows(spark):
    return spark.createDataFrame(
        [
            (1, 0, "NEW YORK", None, None, None, None, None),
            (1, 1, "Albany[1]", "Albany Intl [a]", "ALB", "ALB", "KALB", "1,234,567"),
            (1, 2, "New York", "JFK Intl", "JFK", "JFK", "KJFK", "30,000,000"),
            (1, 3, "Newark", "Newark Liberty", "EWR", "EWR", "KEWR", "99,000,000"),
            (2, 0, "Small", "Field", "X", None, None, "120.0"),  # state carried from table 1
            (2, 1, "TEXAS", None, None, None, None, None),
            (2, 2, "Austin", "Austin Bergstrom", "AUS", "AUS", "KAUS", ""),
            (2, 3, "Dallas", "DFW Intl", "DFW", "DFW", "KDFW", None),
            (3, 0, "GUAM", None, None, None, None, None),
            (3, 1, "Hagatna", "Guam Intl", "GUM", "GUM", "PGUM", "5"),
        ],
        AIRPORT_ROWS,
    )


def test_fill_and_clean(spark):
    out = clean_sites(fill_states(_rows(spark))).orderBy("table_no", "row_no").collect()
    assert [r.State for r in out][:4] == ["New York", "New York", "New York", "New York"]
    assert out[0].City == "Albany" and out[0].Airport == "Albany Intl"
    assert out[0].Enplanements == 1234567.0
    assert out[3].Enplanements == 120.0  # float tail kept as its value
    assert out[3].State == "New York"  # header of the previous table
    assert out[4].Enplanements is None  # blank
    assert len(out) == 7  # header rows gone


def test_busiest_first_non_null_per_column(spark):
    coords = spark.createDataFrame(
        [("jfk", None, None), ("alb", 42.7483, -73.8017), ("aus", 30.1945, -97.6699)], COORDS
    )
    regions = spark.createDataFrame([("New York", "NY"), ("Texas", "TEX")], "state string, region string")
    out = {r.region: r for r in build_region_sites(_rows(spark), coords, regions).collect()}
    assert set(out) == {"NY", "TEX"}  # unmapped Guam dropped, Newark excluded
    ny = out["NY"]
    assert ny.iata == "JFK" and ny.enplanements == 30_000_000.0
    assert ny.latitude_deg == 42.7483  # JFK has no coordinates: next busiest gives them
    tex = out["TEX"]
    assert tex.iata in ("AUS", "DFW") and tex.latitude_deg == 30.1945


def test_exclude_keeps_null_codes(spark):
    df = spark.createDataFrame([("EWR",), (None,), ("JFK",)], "IATA string")
    assert sorted(str(r.IATA) for r in exclude_code(df).collect()) == ["JFK", "None"]


def test_unmapped_state_gets_null_region(spark):
    df = spark.createDataFrame([("Guam",), ("Texas",)], "State string")
    m = spark.createDataFrame([("Texas", "TEX")], "state string, region string")
    got = {r.State: r.Region for r in map_region(df, m).collect()}
    assert got == {"Guam": None, "Texas": "TEX"}
