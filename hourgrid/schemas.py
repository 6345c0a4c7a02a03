"""Fixed schemas, column lists and constant tables of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

TS = T.TimestampNTZType()
STR = T.StringType()
DBL = T.DoubleType()
INT = T.IntegerType()
LONG = T.LongType()

# One long reading as it lands (strings on the wire, ordinal = arrival order).
READING_TEXT = T.StructType(
    [
        T.StructField("period", STR),
        T.StructField("respondent", STR),
        T.StructField("respondent_name", STR),
        T.StructField("type", STR),
        T.StructField("type_name", STR),
        T.StructField("value", STR),
        T.StructField("value_units", STR),
        T.StructField("ordinal", LONG),
    ]
)

# Names on the wire that differ from the column names.
WIRE_NAMES = {"respondent_name": "respondent-name", "type_name": "type-name", "value_units": "value-units"}
# A reading as it comes, under either name.
READING_WIRE = T.StructType([*READING_TEXT.fields, *[T.StructField(w, STR) for w in WIRE_NAMES.values()]])

# A landed page: one JSON document per request, with the request as the service echoes it (where it does);
# what cannot be parsed stays as text.
CORRUPT = "corrupt"
PAGE_REQUEST = T.StructType([T.StructField("params", T.StructType([T.StructField("offset", STR), T.StructField("length", STR)]))])
PAGE = T.StructType(
    [
        T.StructField("request", PAGE_REQUEST),
        T.StructField(
            "response",
            T.StructType(
                [
                    T.StructField("total", STR),
                    T.StructField("data", T.ArrayType(READING_WIRE)),
                ]
            ),
        ),
        T.StructField(CORRUPT, STR),
    ]
)

# Weather text columns after the metadata header.
WEATHER_CSV = T.StructType(
    [
        T.StructField("year", INT),
        T.StructField("mo", INT),
        T.StructField("dy", INT),
        T.StructField("hr", INT),
        T.StructField("allsky_sfc_sw_dwn", DBL),
        T.StructField("t2m", DBL),
        T.StructField("wsc", DBL),
    ]
)
WEATHER_CSV_DDL = "year INT, mo INT, dy INT, hr INT, allsky_sfc_sw_dwn DOUBLE, t2m DOUBLE, wsc DOUBLE"

AIRPORT_ROWS = T.StructType(
    [
        T.StructField("table_no", INT),
        T.StructField("row_no", INT),
        T.StructField("City", STR),
        T.StructField("Airport", STR),
        T.StructField("FAA", STR),
        T.StructField("IATA", STR),
        T.StructField("ICAO", STR),
        T.StructField("Enplanements", STR),
    ]
)

COORDS = T.StructType(
    [
        T.StructField("iata_code", STR),
        T.StructField("latitude_deg", DBL),
        T.StructField("longitude_deg", DBL),
    ]
)

# Wide energy hour: one column per reading type (snake case of the type names).
ENERGY_TYPES = {
    "Demand": "demand",
    "Day-ahead demand forecast": "da_forecast",
    "Net generation": "net_generation",
    "Total interchange": "total_interchange",
}
FUEL_TYPES = {"Solar": "solar", "Wind": "wind"}
ENERGY_KEYS = ["period", "respondent", "respondent_name"]

WEATHER_VALUES = ["allsky_sfc_sw_dwn", "t2m", "wsc"]

# Columns that get a 720-row trailing mean (order of the feature table).
ROLLED = [
    "demand",
    "da_forecast",
    "solar",
    "wind",
    "net_generation",
    "total_interchange",
    "pct_solar",
    "pct_wind",
    "allsky_sfc_sw_dwn",
    "t2m",
    "wsc",
    "unexpect_dem_diff",
]

# Columns of the correlation report.
CORR_COLS = [
    "allsky_sfc_sw_dwn",
    "t2m",
    "wsc",
    "solar",
    "wind",
    "pct_solar",
    "pct_wind",
    "demand",
    "net_generation",
    "total_interchange",
    "da_forecast",
    "unexpect_dem_diff",
]

LAG_COLS = [
    "da_forecast_yesterday",
    "unexpect_dem_diff",
    "lag_interchange_1h",
    "lag_interchange_24h",
    "interchange_roll_mean_3h",
    "net_generation_lag_1",
]

# Final model table, in order.
FEATURE_TABLE = (
    ["period", "respondent", "respondent_name", "region"]
    + ["da_forecast", "total_interchange", "solar", "wind"]
    + ["year", "mo", "dy", "hr"]
    + WEATHER_VALUES
    + ["day_of_year", "day_of_week", "is_weekend"]
    + ["pct_solar", "pct_wind"]
    + LAG_COLS
    + [f"{c}_30d_avg" for c in ROLLED]
)
ID_COLS = ["period", "respondent", "respondent_name", "region"]
TARGET = "total_interchange"
MODEL_FEATURES = [c for c in FEATURE_TABLE if c not in ID_COLS and c != TARGET]

# US state -> grid region code, 48 states, 13 regions.
STATE_REGION = {
    "Alabama": "SE",
    "Arizona": "SW",
    "Arkansas": "SE",
    "California": "CAL",
    "Colorado": "CENT",
    "Connecticut": "NE",
    "Delaware": "MIDA",
    "Florida": "FLA",
    "Georgia": "SE",
    "Idaho": "NW",
    "Illinois": "MIDW",
    "Indiana": "MIDW",
    "Iowa": "MIDW",
    "Kansas": "CENT",
    "Kentucky": "SE",
    "Louisiana": "SE",
    "Maine": "NE",
    "Maryland": "MIDA",
    "Massachusetts": "NE",
    "Michigan": "MIDW",
    "Minnesota": "MIDW",
    "Mississippi": "SE",
    "Missouri": "CENT",
    "Montana": "NW",
    "Nebraska": "CENT",
    "Nevada": "SW",
    "New Hampshire": "NE",
    "New Jersey": "MIDA",
    "New Mexico": "SW",
    "New York": "NY",
    "North Carolina": "CAR",
    "North Dakota": "MIDW",
    "Ohio": "MIDA",
    "Oklahoma": "CENT",
    "Oregon": "NW",
    "Pennsylvania": "MIDA",
    "Rhode Island": "NE",
    "South Carolina": "CAR",
    "South Dakota": "MIDW",
    "Tennessee": "TEN",
    "Texas": "TEX",
    "Utah": "NW",
    "Vermont": "NE",
    "Virginia": "MIDA",
    "Washington": "NW",
    "West Virginia": "MIDW",
    "Wisconsin": "MIDW",
    "Wyoming": "NW",
}
# The 13 region codes, the excluded site code, split date, window sizes.
REGIONS = ["MIDW", "SE", "NE", "MIDA", "NW", "CENT", "SW", "CAR", "CAL", "FLA", "NY", "TEN", "TEX"]
EXCLUDED_SITE = "EWR"
SPLIT_DATE = "2023-08-01"
ROLL_ROWS = 720
SEQ_LEN = 24
N_FOLDS = 4
WEATHER_HEADER_LINES = 14
PARAM_GRID = {
    "n_estimators": [100, 200, 300],
    "max_depth": [3, 5, 7],
    "learning_rate": [0.01, 0.05, 0.1],
}
