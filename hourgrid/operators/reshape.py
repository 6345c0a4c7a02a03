"""Long readings -> one wide row per hour."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.numeric import to_double
from hourgrid.functions.timeparse import parse_period
from hourgrid.schemas import ENERGY_KEYS
from hourgrid.sources.pages import ARRIVAL


def parse_readings(df: DataFrame, period: str = "period", value: str = "value") -> DataFrame:
    """Text period -> TIMESTAMP_NTZ (either wire format), text value -> double;
    text that does not parse becomes NULL."""
    return df.withColumns({period: parse_period(period), value: to_double(value)})


def arrival_order(long_df: DataFrame, value: str = "value", ordinal: str = "ordinal") -> Column:
    """What the first reading is the smallest of: by ordinal, those without one last, then by the place in the
    whole result, the page and the place in it, then by value."""
    arrival = [F.col(c) for c in (ordinal, *ARRIVAL) if c in long_df.columns]
    return F.struct(arrival[0].isNull(), *arrival, F.col(value)) if arrival else F.struct(F.col(value))


def pivot_first(
    long_df: DataFrame,
    types: Mapping[str, str],
    keys: Sequence[str] = tuple(ENERGY_KEYS),
    pivot: str = "type_name",
    value: str = "value",
    ordinal: str = "ordinal",
) -> DataFrame:
    """One row per ``keys`` with a column per type (``types``: type name -> column),
    holding the first non-null value in arrival (``ordinal``) order.

    NULL cells are dropped before widening, so an hour without any value vanishes
    and a type without values stays a NULL column.  Rows with a NULL key are
    dropped.  One hash aggregate (partial on the map side, one shuffle):
    ``min_by`` ignores rows whose ordering is NULL, which acts as the per-type
    filter.  The type list is static, so no distinct-values job runs.  Rows without
    an ordinal come after those with one, in the order of their pages, then of
    their values: none is lost."""
    keys = list(keys)
    order = arrival_order(long_df, value, ordinal)
    ok = F.col(value).isNotNull() & F.col(pivot).isin(list(types))
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    d = long_df.filter(ok)
    aggs = [
        F.min_by(F.col(value), F.when(F.col(pivot) == F.lit(t), order)).alias(c) for t, c in types.items()
    ]
    return d.groupBy(*keys).agg(*aggs)


def energy_hours(
    base_long: DataFrame,
    fuel_long: DataFrame,
    base_types: Mapping[str, str],
    fuel_types: Mapping[str, str],
    keys: Sequence[str] = tuple(ENERGY_KEYS),
    plan: str = "union",
) -> DataFrame:
    """Full outer combination of the widened base and fuel feeds on ``keys``.

    ``plan="union"`` (default) stacks the two long feeds and widens once: the
    same rows as widening each and full-outer-joining, with one shuffle instead
    of three.  ``plan="join"`` widens both and joins them (sort-merge)."""
    keys = list(keys)
    if plan == "union":
        cols = [*keys, "type_name", "value", "ordinal", *ARRIVAL]
        sides = [x.select(*[c for c in cols if c in x.columns]) for x in (base_long, fuel_long)]
        both = sides[0].unionByName(sides[1], allowMissingColumns=True)
        return pivot_first(both, {**base_types, **fuel_types}, keys)
    if plan == "join":
        b = pivot_first(base_long, base_types, keys)
        f = pivot_first(fuel_long, fuel_types, keys)
        return b.join(f, on=keys, how="full_outer")
    raise ValueError(f"unknown plan {plan!r}")
