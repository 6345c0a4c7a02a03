"""Scalar Column expressions (all JVM-side, no Python UDFs)."""

from hourgrid.functions.numeric import EXACT, exact_avg, exact_sum, safe_div, share_pct, to_double
from hourgrid.functions.text import digits_to_double, drop_footnotes, is_header_text, title_case, upper_code
from hourgrid.functions.timeparse import hour_from_parts, parse_period

__all__ = [
    "EXACT",
    "exact_avg",
    "exact_sum",
    "safe_div",
    "share_pct",
    "to_double",
    "digits_to_double",
    "drop_footnotes",
    "is_header_text",
    "title_case",
    "upper_code",
    "hour_from_parts",
    "parse_period",
]
