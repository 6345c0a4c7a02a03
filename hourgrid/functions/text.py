"""Text cleaning for scraped site tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Footnote marks like "[1]" and the float tail "12.0".
FOOTNOTE = r"\[.*?\]"
FLOAT_TAIL = r"\.0$"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def drop_footnotes(c: str | Column) -> Column:
    """Remove bracketed footnotes and surrounding blanks: ``"Albany[1] "`` -> ``"Albany"``."""
    return F.trim(F.regexp_replace(_c(c), FOOTNOTE, ""))


def digits_to_double(c: str | Column) -> Column:
    """Keep digits only; nothing left -> NULL.  A ``.0`` float tail is dropped first so a
    number that went through a float keeps its value (``"120.0"`` -> 120)."""
    digits = F.regexp_replace(F.regexp_replace(_c(c), FLOAT_TAIL, ""), r"\D", "")
    return F.nullif(digits, F.lit("")).try_cast("double")


def is_header_text(city: str | Column, airport: str | Column) -> Column:
    """A state header row: the city text is all upper case (with at least one letter)
    and there is no airport.  NULL-safe: unknown counts as not a header."""
    city = _c(city)
    test = (city == F.upper(city)) & city.rlike("[A-Za-z]") & _c(airport).isNull()
    return F.coalesce(test, F.lit(False))


def title_case(c: str | Column) -> Column:
    """``"NEW YORK"`` -> ``"New York"`` (word starts after blanks)."""
    return F.initcap(_c(c))


def upper_code(c: str | Column) -> Column:
    return F.upper(_c(c))
