"""Connected components of a table of links, as a distributed union-find.

Every round hooks the neighbours of a node to the smallest node it knows, first
the larger ones (large star), then the smaller ones (small star), until the
links are stars around the smallest node of each component.  A node with very
many links is aggregated before the shuffle, and the join that hands its
smallest neighbour back can be split by skew handling.  Links of a round are
written to the shared folder, and removed after the next one; nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.common import remove, staged


def _checksum(links: DataFrame) -> tuple:
    # modulo first, so that the sum cannot overflow
    h = F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))
    return tuple(links.agg(F.count("*"), F.sum(h)).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of ``links`` and the smallest node it reaches.

    Links to itself and repeated links are fine; a link with a null end is no link.  An
    empty table gives an empty result."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    linked = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = staged(linked.select(hi.alias("u"), lo.alias("v")).distinct(), "links")
    before = None
    while (state := _checksum(now)) != before and state[0]:
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = staged(large, "links-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done, now = now, staged(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        remove(done, large)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select("v", "v").distinct()
    )


__all__ = ["components"]
