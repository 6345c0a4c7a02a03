"""Words of letters in lower case, and the hash folds of the contracts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds`` (null keys: null)."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))


__all__ = ["fold", "letter_words"]
