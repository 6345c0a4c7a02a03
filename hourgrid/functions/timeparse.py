"""Hour parsing; wall-clock UTC, stored as TIMESTAMP_NTZ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two period formats seen on the wire.
PERIOD_FORMATS = ("yyyy-MM-dd'T'HH", "yyyy-MM-dd HH:mm:ss")


def parse_period(c: str | Column) -> Column:
    """Text period in either wire format -> TIMESTAMP_NTZ; anything else -> NULL."""
    c = F.col(c) if isinstance(c, str) else c
    tries = [F.try_to_timestamp(c, F.lit(fmt)) for fmt in PERIOD_FORMATS]
    return F.coalesce(*tries).cast("timestamp_ntz")


def hour_from_parts(year: str | Column, mo: str | Column, dy: str | Column, hr: str | Column) -> Column:
    """YEAR, MO, DY, HR -> TIMESTAMP_NTZ (NULL for impossible dates)."""
    cols = [F.col(x) if isinstance(x, str) else x for x in (year, mo, dy, hr)]
    return F.try_make_timestamp_ntz(cols[0], cols[1], cols[2], cols[3], F.lit(0), F.lit(0))
