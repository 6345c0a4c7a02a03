"""SimHash near-duplicates by anchor-point covering.

A fingerprint has a bit set where more than half of the XXH64 hashes (seed 42)
of its word shingles have it.  Two documents are linked when their fingerprints
differ in at most ``max_bits`` = 3 bits.

Candidate search covers the space with a perfect code.  Of the two 32-bit
halves of two linked fingerprints, one half differs in at most one bit.  The
anchors are the words of the Hamming code of length 31, taken over the lower 31
bits of each half; its covering radius is 1.  A fingerprint is at home at the
one anchor within radius 1 and is replicated to every anchor within 1 + 1 = 2:
its home and 15 others, or only its home where it is an anchor itself.  So the
home of either of two linked fingerprints holds the other one, and each anchor
compares those at home with all that were sent to it, over all 64 bits.

Equal fingerprints are one node before that.  The links that an anchor gives
are a spanning forest where they are many, so they grow with the rows and not
with their square.  An anchor with more than ``HOME_ROWS`` fingerprints at home
is cut into tiles, each with its share of the homes and all visitors.

Null texts and texts without words have fingerprint zero and link like any
other.  Rows with a null key get the smallest key of their component (null if
it has none).  Repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourgrid.llm.common import bounded_batches, fresh, staged, with_row_place
from hourgrid.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Fingerprints at home that one task compares with the visitors of their anchor.
HOME_ROWS = 20_000
#: Pairs compared by one numpy step.
STEP_PAIRS = 1 << 20
#: An anchor with more pairs than this gives a spanning forest of its links.
DENSE_PAIRS = 4096
#: Hashes whose bits are counted by one numpy step.
STEP_HASHES = 1 << 16


def text_hashes(text: str | None, words: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of each shingle; ASCII letters in lower case, words split at ASCII white space."""
    w = (text or "").encode().lower().split()
    if not w:
        return []
    if len(w) < words:
        return [xxhash.xxh64_intdigest(b" ".join(w), SEED)]
    h = xxhash.xxh64_intdigest
    return [h(s, SEED) for s in map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False))]


def fingerprints(texts: list[str | None], words: int = SHINGLE_WORDS) -> np.ndarray:
    """Unsigned 64-bit fingerprint of each text."""
    out = np.zeros(len(texts), np.uint64)
    for n, t in enumerate(texts):
        h = np.array(text_hashes(t, words), np.uint64)
        ones = np.zeros(64, np.int64)
        for s in range(0, len(h), STEP_HASHES):
            bits = np.unpackbits(h[s : s + STEP_HASHES].view(np.uint8), bitorder="little").reshape(-1, 64)
            # uint16 sums are fast and hold a step of up to 65,535 ones; halves keep them in range
            half = len(bits) // 2
            ones += bits[:half].sum(0, dtype=np.uint16) if half else 0
            ones += bits[half:].sum(0, dtype=np.uint16)
        out[n] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
    return out


def _flips() -> np.ndarray:
    """By syndrome: what to flip to reach each anchor within 2 bits, the home first (0 past the last)."""
    out = np.zeros((32, 16), np.uint64)
    for s in range(1, 32):
        out[s, 0] = 1 << (s - 1)
        pairs = [(i, i ^ s) for i in range(1, 32) if i < i ^ s and i != s]
        out[s, 1:] = [1 << (i - 1) | 1 << (j - 1) for i, j in pairs]
    return out


FLIPS = _flips()


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, fingerprint, home) of all replicas; a cell is a half and an anchor in it."""
    cells, prints, homes = [], [], []
    for half in (0, 1):
        w = fp >> np.uint64(32 * half) & np.uint64((1 << 31) - 1)
        syndrome = np.zeros(len(w), np.int64)
        for i in range(31):
            syndrome ^= np.where(w >> np.uint64(i) & np.uint64(1), i + 1, 0)
        at = w[:, None] ^ FLIPS[syndrome]
        keep = np.ones(at.shape, bool)
        keep[syndrome == 0, 1:] = False
        home = np.zeros(at.shape, bool)
        home[:, 0] = True
        cells.append((at[keep] | np.uint64(half << 31)).astype(np.int64))
        prints.append(np.broadcast_to(fp[:, None], at.shape)[keep])
        homes.append(home[keep])
    return np.concatenate(cells), np.concatenate(prints), np.concatenate(homes)


def _replicas(fps: DataFrame, only_home: bool = False) -> DataFrame:
    """(cell, fp, home) of every fingerprint of ``fps``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, fp, home = anchors(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if only_home:
                cell, fp, home = cell[home], fp[home], home[home]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp.view(np.int64)), pa.array(home)], names=["cell", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "cell long, fp long, home boolean")


def _dense(homes: np.ndarray, rows: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of ``homes`` with ``rows`` as a spanning forest of what they connect."""
    root = np.arange(len(homes))
    a, b = [], []
    step = max(1, STEP_PAIRS // len(homes))
    for s in range(0, len(rows), step):
        part = rows[s : s + step]
        near = np.bitwise_count(homes[:, None] ^ part[None, :]) <= max_bits
        has = near.any(0)
        first = near.argmax(0)
        a.append(part[has])
        b.append(homes[first[has]])
        # homes that a row connects: join their roots, each set of homes once
        sets = np.unique(np.packbits(near[:, has], axis=0).T, axis=0)
        for bits in sets:
            hit = np.unpackbits(bits, count=len(homes)).astype(bool)
            roots = np.unique(root[hit])
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
    a.append(homes)
    b.append(homes[root])
    x, y = np.concatenate(a), np.concatenate(b)
    return x[x != y], y[x != y]


def _compare(cell: np.ndarray, fp: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole cells; rows are sorted by cell with those at home first."""
    none = np.empty(0, np.uint64)
    if not len(cell):
        return none, none
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    size = np.diff(np.r_[first, len(cell)])
    at_home = np.add.reduceat(home.astype(np.int64), first)
    use = (size > 1) & (at_home > 0)
    first, size, at_home = first[use], size[use], at_home[use]
    outs = []
    dense = size * at_home > DENSE_PAIRS
    for f, n, h in zip(first[dense], size[dense], at_home[dense], strict=True):
        if h <= HOME_ROWS:
            outs.append(_dense(fp[f : f + h], fp[f : f + n], max_bits))
    first, size, at_home = first[~dense], size[~dense], at_home[~dense]
    pairs = size * at_home
    step = np.cumsum(pairs) // STEP_PAIRS
    for k in np.unique(step):
        f, n, p = first[step == k], size[step == k], pairs[step == k]
        group = np.repeat(np.arange(len(f)), p)
        t = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
        x, y = fp[f[group] + t // n[group]], fp[f[group] + t % n[group]]
        near = (x != y) & (np.bitwise_count(x ^ y) <= max_bits)
        outs.append((x[near], y[near]))
    if not outs:
        return none, none
    return np.concatenate([o[0] for o in outs]), np.concatenate([o[1] for o in outs])


def _linked(rows: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): links of the cells of ``rows``, which come sorted by cell, homes first."""

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fp, home = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            cell, fp, home = np.r_[cell, cols[0]], np.r_[fp, cols[1].view(np.uint64)], np.r_[home, cols[2]]
            if len(cell) < STEP_PAIRS // 8:
                continue
            # the last cell may go on: hold it back, but of a long one only those at home
            cut = int(np.searchsorted(cell, cell[-1]))
            yield out(*_compare(cell[:cut], fp[:cut], home[:cut], max_bits))
            cell, fp, home = cell[cut:], fp[cut:], home[cut:]
            if len(cell) >= STEP_PAIRS // 8:
                yield out(*_compare(cell, fp, home, max_bits))
                # one home more than a task takes is enough to know that the cell is cut into tiles
                keep = np.flatnonzero(home)[: HOME_ROWS + 1]
                cell, fp, home = cell[keep], fp[keep], home[keep]
        yield out(*_compare(cell, fp, home, max_bits))

    return rows.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, max_bits: int = MAX_BITS, home_rows: int = HOME_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints (``fps.fp``) that connect all within ``max_bits``."""
    if max_bits > 3:
        raise ValueError("two 32-bit halves with radius 1 cover at most 3 differing bits")
    spark = fps.sparkSession
    bounded_batches(spark)
    rows = _replicas(fps)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = _linked(rows.repartition(parts, "cell").sortWithinPartitions("cell", F.desc("home")), max_bits)
    crowded = staged(_replicas(fps, only_home=True).groupBy("cell").count().where(F.col("count") > home_rows), "crowded")
    if crowded.isEmpty():
        return near
    tiles = F.ceil(F.col("count") / F.lit(home_rows / 2)).cast("int")
    tiled = rows.join(crowded.select("cell", tiles.alias("tiles")), "cell")
    tiled = tiled.select("cell", "fp", "home", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "tiles")
    here = F.col("home") & (F.pmod(F.xxhash64("fp"), F.col("tiles")) == F.col("tile"))
    tiled = tiled.select((F.col("cell") * F.lit(1 << 24) + F.col("tile")).alias("cell"), "fp", here.alias("home"))
    return near.union(_linked(tiled.repartition(parts, "cell").sortWithinPartitions("cell", F.desc("home")), max_bits))


def fingerprinted(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(row, key, fp): row number, key and fingerprint (signed long) of every document, written once."""
    bounded_batches(docs.sparkSession)
    # numbered in the scan that writes the fingerprints: the texts are not read again
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    return _fingerprinted(d, words)


def _fingerprinted(d: DataFrame, words: int) -> DataFrame:
    """The same for (row, key, text) that are numbered already."""
    schema = T.StructType([d.schema["row"], d.schema["key"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(b.column(2).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["row", "key", "fp"])

    return staged(d.select("row", "key", "text").mapInArrow(run, schema), "fingerprints")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(row, key, fp, label, component_id) of every document: ``label`` is the smallest
    fingerprint and ``component_id`` the smallest key that the document reaches by links."""
    return _groups(fingerprinted(docs, key, text, words), max_bits)


def _groups(seen: DataFrame, max_bits: int) -> DataFrame:
    fps = staged(seen.groupBy("fp").agg(F.min("key").alias("least")), "distinct-fingerprints")
    found = components(links(fps, max_bits)).toDF("fp", "label")
    linked = staged(fps.join(found, "fp"), "linked")
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    known = linked.join(least, "label").select("fp", "label", "component_id")
    of_fp = fps.join(known, "fp", "left").select(
        "fp", F.coalesce("label", "fp").alias("label"), F.coalesce("component_id", "least").alias("component_id")
    )
    return seen.join(staged(of_fp, "fingerprint-components"), "fp").select("row", "key", "fp", "label", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group: that with the smallest key (null keys last),
    and of repeated rows the first."""
    row = fresh(docs, "row")
    d = with_row_place(docs, row)
    bounded_batches(docs.sparkSession)
    found = _groups(_fingerprinted(d.select(F.col(row).alias("row"), F.col(key).alias("key"), F.col(text).alias("text")), SHINGLE_WORDS), MAX_BITS)
    order = F.struct(F.col("key").isNull(), "key", "row")
    kept = found.groupBy("label").agg(F.min(order).alias("k")).select(F.col("k.row").alias("row"))
    return d.join(kept.withColumnRenamed("row", row), row, "left_semi").select(docs.columns)


__all__ = ["anchors", "fingerprints", "groups", "keep_one", "links"]
