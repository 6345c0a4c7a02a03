"""Feature engineering on the hourly energy x weather table.

Order of the reference pipeline is kept: join -> calendar -> shares -> lags
(on every joined row) -> drop incomplete rows -> 720-row means (on the
surviving rows) -> drop source columns -> drop incomplete rows.  Lags and
rolling means count rows, not hours (gaps are not filled).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.functions.numeric import EXACT, share_pct
from hourgrid.operators.ordered import DEFAULT_BLOCK_ROWS, blocked, keep_home, over_blocks
from hourgrid.schemas import FEATURE_TABLE, ROLLED, ROLL_ROWS


def join_energy_weather(
    energy: DataFrame,
    weather: DataFrame,
    keys: Sequence[str] = ("region",),
    energy_time: str = "period",
    weather_time: str = "datetime",
) -> DataFrame:
    """Inner join of wide energy hours with weather hours on the keys and the hour.

    Both time columns are kept (``datetime`` is dropped with the source columns
    later, as in the model table)."""
    keys = list(keys)
    w = weather.select(*[F.col(k).alias(f"_w_{k}") for k in keys], *[c for c in weather.columns if c not in keys])
    cond = [energy[k] == w[f"_w_{k}"] for k in keys] + [energy[energy_time] == w[weather_time]]
    return energy.join(w, on=cond, how="inner").drop(*[f"_w_{k}" for k in keys])


def calendar_features(df: DataFrame, ts: str = "period") -> DataFrame:
    """day_of_year (1-366), day_of_week (Monday = 0), is_weekend (Saturday/Sunday = 1)."""
    dow = F.weekday(F.col(ts))
    return df.withColumns(
        {
            "day_of_year": F.dayofyear(F.col(ts)).cast("int"),
            "day_of_week": dow.cast("int"),
            "is_weekend": (dow >= F.lit(5)).cast("int"),
        }
    )


def share_features(df: DataFrame, total: str = "net_generation", parts: Sequence[str] = ("solar", "wind")) -> DataFrame:
    """Missing generation parts -> 0; ``pct_<part>`` = part / total * 100, 0 when the
    total is 0 or missing."""
    out = df
    for p in parts:
        src = F.col(p) if p in df.columns else F.lit(None).cast("double")
        out = out.withColumn(p, F.coalesce(src.cast("double"), F.lit(0.0)))
    return out.withColumns({f"pct_{p}": share_pct(p, total) for p in parts})


def lag_features(
    df: DataFrame,
    keys: Sequence[str] = ("region",),
    ts: str = "period",
    block_rows: int = DEFAULT_BLOCK_ROWS,
    small: bool = False,
) -> DataFrame:
    """Row-count lags of the reference (``small``: see ``ordered.blocked``):

    * ``da_forecast_yesterday`` = da_forecast 24 rows back,
    * ``unexpect_dem_diff`` = demand - da_forecast_yesterday,
    * ``lag_interchange_1h`` / ``_24h`` = total_interchange 1 / 24 rows back,
    * ``interchange_roll_mean_3h`` = mean of total_interchange over the 3 previous
      rows, NULL unless all 3 are present,
    * ``net_generation_lag_1`` = net_generation 1 row back.
    """
    keys = list(keys)
    d = blocked(df, keys, ts, before=24, block_rows=block_rows, small=small)
    w = over_blocks(d, keys, ts)
    prev3 = w.rowsBetween(-3, -1)
    ti = F.col("total_interchange")
    d = d.withColumns(
        {
            "da_forecast_yesterday": F.lag("da_forecast", 24).over(w),
            "lag_interchange_1h": F.lag(ti, 1).over(w),
            "lag_interchange_24h": F.lag(ti, 24).over(w),
            "interchange_roll_mean_3h": F.when(
                F.count(ti).over(prev3) == F.lit(3), F.sum(ti.cast(EXACT)).over(prev3).cast("double") / F.lit(3.0)
            ),
            "net_generation_lag_1": F.lag("net_generation", 1).over(w),
        }
    )
    d = d.withColumn("unexpect_dem_diff", F.col("demand") - F.col("da_forecast_yesterday"))
    return keep_home(d)


def dropna_any(df: DataFrame) -> DataFrame:
    """Drop every row with a NULL (or NaN) in any column."""
    return df.dropna(how="any")


def rolling_means(
    df: DataFrame,
    cols: Sequence[str] = tuple(ROLLED),
    window: int = ROLL_ROWS,
    keys: Sequence[str] = ("region",),
    ts: str = "period",
    block_rows: int = DEFAULT_BLOCK_ROWS,
    suffix: str = "_30d_avg",
    small: bool = False,
) -> DataFrame:
    """``<c><suffix>`` = mean of the non-null values of ``c`` over the current row and
    the ``window - 1`` rows before it (fewer at the start of a series).

    Computed as a difference of running sums (O(1) per row instead of O(window)).
    The running sums are exact decimals, so the difference has no cancellation
    error and the mean does not depend on the order of addition."""
    keys = list(keys)
    d = blocked(df, keys, ts, before=window - 1, block_rows=block_rows, small=small)
    w = over_blocks(d, keys, ts)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = {}
    for c in cols:
        x = F.col(c).cast(EXACT)
        sums[f"_s_{c}"] = F.coalesce(F.sum(x).over(run), F.lit(0).cast(EXACT))
        sums[f"_n_{c}"] = F.count(x).over(run)
    d = d.withColumns(sums)
    means = {}
    for c in cols:
        s_now, n_now = F.col(f"_s_{c}"), F.col(f"_n_{c}")
        s_old = F.coalesce(F.lag(s_now, window).over(w), F.lit(0).cast(EXACT))
        n_old = F.coalesce(F.lag(n_now, window).over(w), F.lit(0))
        n = n_now - n_old
        means[f"{c}{suffix}"] = F.when(n > 0, (s_now - s_old).cast("double") / n.cast("double"))
    d = d.withColumns(means).drop(*sums.keys())
    return keep_home(d)


def drop_source_columns(df: DataFrame, cols: Sequence[str] = ("demand", "net_generation", "datetime")) -> DataFrame:
    """Drop the columns that leak the target or repeat the key, then incomplete rows."""
    return dropna_any(df.drop(*cols))


def to_feature_table(df: DataFrame) -> DataFrame:
    """Fixed column order of the model table."""
    return df.select(*FEATURE_TABLE)
