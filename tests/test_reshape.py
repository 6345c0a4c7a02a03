"""Long -> wide readings (T1: null cells dropped before widening; first by arrival)."""


from hourgrid.operators.reshape import energy_hours, parse_readings, pivot_first
from hourgrid.schemas import READING_TEXT

TYPES = {"Demand": "demand", "Day-ahead demand forecast": "da_forecast", "Net generation": "net_generation", "Total interchange": "total_interchange"}


def _rows(spark, rows):
    return spark.createDataFrame(rows, READING_TEXT)


def test_parse_both_formats_and_bad_text(spark):
    df = _rows(
        spark,
        [
            ("2024-07-31T00", "NY", "New York", "D", "Demand", "26508", "MWh", 1),
            ("2024-07-31 00:00:00", "NY", "New York", "DF", "Day-ahead demand forecast", "25158", "MWh", 2),
            ("garbage", "NY", "New York", "NG", "Net generation", "n/a", "MWh", 3),
        ],
    )
    out = parse_readings(df).orderBy("ordinal").collect()
    assert str(out[0].period) == "2024-07-31 00:00:00" and out[0].value == 26508.0
    assert out[1].period == out[0].period
    assert out[2].period is None and out[2].value is None


def test_pivot_first_non_null_in_arrival_order(spark):
    p = "2024-07-31 00:00:00"
    df = parse_readings(
        _rows(
            spark,
            [
                (p, "NY", "New York", "D", "Demand", None, "MWh", 1),  # first value null, second not
                (p, "NY", "New York", "D", "Demand", "10", "MWh", 3),
                (p, "NY", "New York", "D", "Demand", "20", "MWh", 2),  # earlier arrival wins
                (p, "NY", "New York", "TI", "Total interchange", "-1953", "MWh", 4),
                ("2024-07-31 01:00:00", "NY", "New York", "D", "Demand", None, "MWh", 5),  # all-null hour
                (p, None, "New York", "D", "Demand", "7", "MWh", 6),  # null key
            ],
        )
    )
    out = pivot_first(df, TYPES).collect()
    assert len(out) == 1
    r = out[0]
    assert r.demand == 20.0 and r.total_interchange == -1953.0
    assert r.da_forecast is None and r.net_generation is None


def test_union_plan_equals_outer_join_plan(spark):
    base = parse_readings(
        _rows(
            spark,
            [
                ("2024-01-01T00", "MIDW", "Midwest", "D", "Demand", "5", "MWh", 1),
                ("2024-01-01T01", "MIDW", "Midwest", "D", "Demand", "6", "MWh", 2),
            ],
        )
    )
    fuel = parse_readings(
        _rows(
            spark,
            [
                ("2024-01-01T01", "MIDW", "Midwest", "SUN", "Solar", "1", "MWh", 3),
                ("2024-01-01T02", "MIDW", "Midwest", "WND", "Wind", "2", "MWh", 4),
            ],
        )
    )
    fuel_types = {"Solar": "solar", "Wind": "wind"}
    a = energy_hours(base, fuel, TYPES, fuel_types, plan="union")
    b = energy_hours(base, fuel, TYPES, fuel_types, plan="join")
    cols = ["period", "respondent", "respondent_name", "demand", "solar", "wind"]
    ra = sorted(tuple(r) for r in a.select(*cols).collect())
    rb = sorted(tuple(r) for r in b.select(*cols).collect())
    assert ra == rb and len(ra) == 3


def test_pivot_pushes_type_filter_to_scan(spark, tmp_path):
    p = str(tmp_path / "long")
    _rows(spark, [("2024-01-01T00", "R", "R", "D", "Demand", "1", "u", 1)]).write.parquet(p)
    plan = pivot_first(spark.read.parquet(p), TYPES)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "type_name" in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
