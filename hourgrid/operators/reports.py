"""Report tables: correlation matrix, hour x month means, scatter extracts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.numeric import exact_avg
from hourgrid.operators.ordered import _ns_join
from hourgrid.schemas import CORR_COLS
from hourgrid.session import cut_lineage


def corr_matrix(df: DataFrame, cols: Sequence[str] = tuple(CORR_COLS), keys: Sequence[str] = ("region",)) -> DataFrame:
    """Pearson correlation of every pair of ``cols`` per key, long form
    ``(keys..., feature_1, feature_2, corr)``, full square (mirrored, diagonal 1), each pair over the rows where
    both are present; a constant column gives NULL.

    The columns are written once.  A first aggregate (counts, means, ranges) gives what to centre by and which
    columns have NULLs; a second one sums the products of centred values: one number a pair, since pairs of whole
    columns share sums of squares.  Only pairs with a column that has NULLs have masked sums of their own."""
    keys, cols = list(keys), list(cols)
    x = [f"_x{i}" for i in range(len(cols))]
    d = cut_lineage(df.select(*keys, *[F.col(c).cast("double").alias(n) for n, c in zip(x, cols, strict=True)]), "columns")
    first = [F.count("*").alias("_n")]
    for n in x:
        first += [F.count(n).alias(f"_c{n}"), F.avg(n).alias(f"_m{n}"), F.min(n).alias(f"_lo{n}"), F.max(n).alias(f"_hi{n}")]
    means = cut_lineage(d.groupBy(*keys).agg(*first), "means")
    gaps = means.agg(*[F.max(F.col(f"_c{n}") < F.col("_n")) for n in x]).first()
    z = _ns_join(d, means.select(*keys, *[f"_m{n}" for n in x]), keys).select(*keys, *[(F.col(n) - F.col(f"_m{n}")).alias(n) for n in x])
    pairs = list(combinations(range(len(cols)), 2))
    aggs = [F.sum(F.col(n) * F.col(n)).alias(f"_s{n}") for n in x]
    for i, j in pairs:
        a, b = F.col(x[i]), F.col(x[j])
        aggs.append(F.sum(a * b).alias(f"_p_{i}_{j}"))
        if gaps[i] or gaps[j]:
            for side, mine, other in (("a", a, b), ("b", b, a)):
                v = F.when(other.isNotNull(), mine)
                aggs += [F.sum(v).alias(f"_{side}_{i}_{j}"), F.sum(v * v).alias(f"_{side}{side}_{i}_{j}"), (F.min(v) < F.max(v)).alias(f"_v{side}_{i}_{j}")]
            aggs.append(F.count(a * b).cast("double").alias(f"_n_{i}_{j}"))
    stats = _ns_join(z.groupBy(*keys).agg(*aggs), means.select(*keys, *[(F.col(f"_lo{n}") < F.col(f"_hi{n}")).alias(f"_v{n}") for n in x]), keys)

    def over(product: Column, squares: Column, varies: Column) -> Column:
        return F.when(varies, F.try_divide(product, F.sqrt(squares)))

    def r(i: int, j: int) -> Column:
        i, j = min(i, j), max(i, j)
        if i == j:
            return F.when(F.col(f"_v{x[i]}"), F.lit(1.0))
        p = F.col(f"_p_{i}_{j}")
        if not (gaps[i] or gaps[j]):
            return over(p, F.col(f"_s{x[i]}") * F.col(f"_s{x[j]}"), F.col(f"_v{x[i]}") & F.col(f"_v{x[j]}"))
        of = lambda name: F.col(f"_{name}_{i}_{j}")
        mean = lambda u, v: F.try_divide(of(u) * of(v), of("n"))
        return over(p - mean("a", "b"), (of("aa") - mean("a", "a")) * (of("bb") - mean("b", "b")), of("va") & of("vb"))

    cells = [
        F.struct(F.lit(cols[i]).alias("feature_1"), F.lit(cols[j]).alias("feature_2"), r(i, j).alias("corr"))
        for i in range(len(cols))
        for j in range(len(cols))
    ]
    return stats.select(*keys, F.inline(F.array(*cells)))


def hour_month_mean(
    df: DataFrame,
    values: Sequence[str],
    keys: Sequence[str] = ("region",),
    hour: str = "hr",
    month: str = "mo",
) -> DataFrame:
    """Mean of each value per key, hour of day and month (NULLs ignored), long form.
    Means come from exact sums, so they do not depend on the order of addition."""
    return df.groupBy(*keys, hour, month).agg(*[exact_avg(v).alias(f"avg_{v}") for v in values])


def hour_month_grid(df: DataFrame, value: str, keys: Sequence[str] = ("region",), hour: str = "hr", month: str = "mo") -> DataFrame:
    """Heat-map layout: one row per key and hour, one column per month ``m01``..``m12``
    holding the mean of ``value`` (NULL for a month without values).  Written as 12
    conditional aggregates in one hash aggregate: no pivot planning, no distinct job."""
    cells = [exact_avg(F.when(F.col(month) == F.lit(m), F.col(value))).alias(f"m{m:02d}") for m in range(1, 13)]
    return df.groupBy(*keys, hour).agg(*cells)


def scatter_extract(
    df: DataFrame,
    keys: Sequence[str] = ("region",),
    fraction: float | None = None,
    seed: int = 42,
) -> DataFrame:
    """Columns behind the plots: demand and its 30-day mean over time, irradiance vs
    solar, wind speed vs wind, temperature vs demand.  ``fraction`` samples rows
    for plotting very large series (off by default: every row is returned)."""
    cols = [*keys, "period", "demand", "demand_30d_avg", "allsky_sfc_sw_dwn", "solar", "wsc", "wind", "t2m"]
    out = df.select(*cols)
    if fraction is not None:
        out = out.sample(fraction=fraction, seed=seed)
    return out
