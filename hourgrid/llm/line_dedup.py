"""Fuzzy line dedup by MinHash: signatures and exact similarities in Arrow tasks, the rest in DataFrames.

A line counts by its form without outer white space, in lower case.  Lines whose sets of
5-character shingles have a Jaccard similarity of 0.8 or more are linked, equal lines are one,
and of each connected component one line stays: that of the smallest key, row and place.

* Signature (``line_sketch``): one-permutation MinHash of all shingles, 64 bins, empty ones filled
  from others; made once for the equal lines of a batch.
* Banding: ten bands of six bins.  Lines of similarity 0.8 meet in about 0.96 of all cases (measured by a
  test, floor 0.9), those of 0.3 in 0.007, unrelated ones hardly ever, so buckets hold lines that
  are similar or nearly so.
* A bucket is first a star: each line against the smallest, so the work is linear in its rows.  Only lines of
  a bucket that are still in different components are then compared with each other.
* Pairs that cannot be similar go before their texts are fetched: by the numbers of their shingles, and by the parities
  of 1,024 classes of shingles, which differ in no more places than there are shingles that only one line has.  So of
  all pairs of a crowded bucket only those near the limit become rows.
* Verification is exact, on all shingles.  The texts of lines that meet another are fetched by a second scan; a
  bit field of fixed size tells it most of them, so that no other line is shuffled.
* Union-find over the links (``components``), and the first line of each component stays.

Lines are told apart by 128-bit hashes; in buckets they go by the first half, and two lines that fall
together there are both looked at.  Buckets are read as sorted streams, of whatever size.

Blank lines take no part and stay.  Null texts stay null; a text that loses all its lines is
empty.  Repeated rows lose their lines to the first of them.  An empty table gives an empty one.  Very long
texts and lines are taken whole.  Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourgrid.llm import line_sketch
from hourgrid.llm.common import arrow_batches, fresh, released, staged, with_row_place
from hourgrid.llm.components import components

SIMILARITY = 0.8
#: Columns of a line's parities.
PARITIES = [f"p{i}" for i in range(line_sketch.WORDS)]
#: White space around a line.
WHITE = " \t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0      　"
#: Bits of the field over the lines whose texts are wanted (16 MB), whatever the corpus.
FIELD_BITS = 1 << 27
#: Pairs of lines, and their bytes, whose shingle sets are in memory at once (some 100 bytes a character).
VERIFIED_BATCH = 1024, "2m"


def normal(line: str) -> str:
    return line.strip(WHITE).lower()


def digest(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode())


def signed(docs: DataFrame) -> DataFrame:
    """(row, key, pos, h, bands) of every line that is not blank; ``bands`` at the first of the equal lines of a batch."""
    schema = T.StructType([docs.schema["row"], docs.schema["key"], *T._parse_datatype_string("pos int, h binary, bands array<bigint>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: dict[str, int] = {}
            doc, pos, which = [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                for p, raw in enumerate((t or "").split("\n")):
                    line = normal(raw)
                    if line:
                        doc.append(i)
                        pos.append(p)
                        which.append(at.setdefault(line, len(at)))
            lines = list(at)
            of = np.array(which, np.int64)
            first = np.zeros(len(of), bool)
            first[np.unique(of, return_index=True)[1]] = True
            bands = line_sketch.bands(lines)
            ends = np.append(0, np.cumsum(first * line_sketch.BANDS)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[of[first]].reshape(-1)), mask=pa.array(~first))
            take = pa.array(doc, pa.int64())
            hashes = pa.array([digest(x) for x in lines], pa.binary()).take(pa.array(of))
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(pos, pa.int32()), hashes, lists], schema.names)

    return docs.select("row", "key", "text").mapInArrow(run, schema)


def buckets(lines: DataFrame) -> DataFrame:
    """(band, k, pivot): the lines of every bucket of two or more, by the first half of their hashes; the pivot
    is the smallest."""
    k = F.conv(F.hex(F.substring("h", 1, 8)), 16, -10).cast("long").alias("k")
    rows = lines.where("bands IS NOT NULL").select(F.explode("bands").alias("band"), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, bool] | None = None  # the open bucket: band, pivot, whether it has been told
        last = None  # the last row
        for b in batches:
            if not b.num_rows:
                continue
            band, k = b.column(0).to_numpy(), b.column(1).to_numpy()
            keep = np.r_[last is None or (band[0], k[0]) != last, (band[1:] != band[:-1]) | (k[1:] != k[:-1])]
            last = (band[-1], k[-1])
            band, k = band[keep], k[keep]
            if not len(band):
                continue
            new = np.r_[held is None or band[0] != held[0], band[1:] != band[:-1]]
            at = np.maximum.accumulate(np.where(new, np.arange(len(band)), -1))
            pivot = np.where(at >= 0, k[np.maximum(at, 0)], held[1] if held else 0)
            other = ~new
            # a bucket's pivot is told with its second line
            second = other & np.r_[held is not None and not held[2], new[:-1]]
            cols = [np.r_[x[other], y[second]] for x, y in ((band, band), (k, pivot), (pivot, pivot))]
            told = bool(other[-1]) or (not new[-1] and held is not None and held[2])
            held = (band[-1], pivot[-1], told)
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["band", "k", "pivot"])

    return rows.repartition("band").sortWithinPartitions("band", "k").mapInArrow(run, "band long, k long, pivot long")


def bit_field(keys: DataFrame, bits: int = FIELD_BITS) -> bytes:
    """A field with the bits of the column ``k``, ``bits`` / 8 bytes whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_bit(b.column(0).to_numpy(), bits))
            word, mask = at >> 5, np.int64(1) << (at & 31)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(np.bitwise_or.reduceat(mask, first) if len(first) else mask)], ["word", "mask"])

    told = keys.select("k").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 32, "<u4")
    out[told.column(0).to_numpy()] = told.column(1).to_numpy()
    return out.tobytes()


def _bit(k: np.ndarray, bits: int) -> np.ndarray:
    return (k.view(np.uint64) % np.uint64(bits)).astype(np.int64)


def texts_of(docs: DataFrame, field, bits: int) -> DataFrame:
    """(k, h, n, line) and PARITIES: the lines whose bit is in the ``field``, once each, how many shingles they have, and of
    which classes an odd number."""
    schema = f"k long, h binary, n long, line string, {', '.join(f'{p} long' for p in PARITIES)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(field.value, np.uint8)
        for b in batches:
            lines = {normal(x) for t in b.column(0).to_pylist() if t for x in t.split("\n")}
            lines.discard("")
            lines = list(lines)
            hashes = [digest(x) for x in lines]
            k = np.frombuffer(b"".join(h[:8] for h in hashes), ">i8").astype(np.int64)
            at = _bit(k, bits)
            found = np.flatnonzero(known[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            lines, hashes = [lines[i] for i in found], [hashes[i] for i in found]
            sizes, words = line_sketch.parities(lines)
            cols = [pa.array(k[found]), pa.array(hashes, pa.binary()), pa.array(sizes), pa.array(lines, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(w) for w in words.T.copy())], ["k", "h", "n", "line", *PARITIES])

    return docs.select("text").mapInArrow(run, schema).dropDuplicates(["h"])


def verified(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b) of the pairs (a, a_line, b, b_line) that have a similarity of ``least`` or more."""
    part = round(least * 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                shared, together = line_sketch.jaccard(b.column(1).to_pylist(), b.column(3).to_pylist())
                yield b.select(["a", "b"]).filter(pa.array(shared * 1000 >= part * together))

    return pairs.select("a", "a_line", "b", "b_line").mapInArrow(run, "a binary, b binary")


def may_be(least: float, a: str, b: str) -> Column:
    """Lines, whose columns begin with ``a`` and ``b``, can be similar only if the smaller has ``least`` of the larger's
    shingles, and if few enough are in one line only.  The sizes are taken as one larger, and one more a thousand,
    since they can be too small."""
    part = round(least * 1000)
    x, y = (F.col(f"{c}n") + 1 + F.shiftright(f"{c}n", 10) for c in (a, b))
    apart = sum((F.bit_count(F.col(a + p).bitwiseXOR(F.col(b + p))) for p in PARITIES), F.lit(0))
    return (F.least(x, y) * 1000 >= (F.greatest(f"{a}n", f"{b}n")) * part) & (apart * (1000 + part) <= (x + y) * (1000 - part))


def _seen(texts: DataFrame, side: str) -> DataFrame:
    """What ``may_be`` asks for, in columns that begin with ``side``."""
    return texts.select(F.col("k").alias(f"{side}k"), F.col("h").alias(f"{side}h"), *(F.col(c).alias(f"{side}{c}") for c in ("n", *PARITIES)))


def cross_pairs(placed: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b), each once: pairs of lines of a bucket that are in different components and may be similar.  ``placed``:
    band, k, h, comp, pivot."""
    # of two lines, one is the pivot
    split = placed.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("rows")).where("low <> high AND rows > 2")
    rest = placed.join(split.select("band"), "band", "left_semi").where("k <> pivot")
    rest = rest.groupBy("h").agg(F.min("comp").alias("comp"), F.collect_list("band").alias("bands"))
    x, y = (rest.toDF(f"{c}h", f"{c}comp", f"{c}bands").join(_seen(texts, c).drop(f"{c}k"), f"{c}h").withColumn(f"{c}band", F.explode(f"{c}bands")) for c in ("x_", "y_"))
    on = (F.col("x_band") == F.col("y_band")) & (F.col("x_h") > F.col("y_h")) & (F.col("x_comp") != F.col("y_comp")) & may_be(least, "x_", "y_")
    # lines that meet in several bands are a pair in one of them
    before = F.exists("x_bands", lambda b: (b < F.col("x_band")) & F.array_contains("y_bands", b))
    return x.join(y, on & ~before).select(F.col("x_h").alias("a"), F.col("y_h").alias("b"))


def _with_lines(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of hashes with the lines behind them."""
    for side in "ab":
        pairs = pairs.join(texts.select(F.col("h").alias(side), F.col("line").alias(f"{side}_line")), side)
    return pairs


def line_groups(docs: DataFrame, similarity: float = SIMILARITY, field_bits: int = FIELD_BITS) -> DataFrame:
    """(row, gone) of every row that loses lines, and which.  ``docs``: row, key, text."""
    spark = docs.sparkSession
    with arrow_batches(spark, 2048):
        lines = staged(signed(docs), "lines")
    with arrow_batches(spark, 65536):
        crowd = staged(buckets(lines), "buckets")
        field = spark.sparkContext.broadcast(bit_field(crowd.select("k"), field_bits))
    with arrow_batches(spark, 2048):
        texts = staged(texts_of(docs, field, field_bits), "candidate-lines")
    field.destroy()
    stars = crowd.where("k <> pivot").select(F.col("k").alias("x_k"), F.col("pivot").alias("y_k")).distinct()
    stars = stars.join(_seen(texts, "x_"), "x_k").join(_seen(texts, "y_"), "y_k").where(may_be(similarity, "x_", "y_"))
    with arrow_batches(spark, *VERIFIED_BATCH):
        links = staged(verified(_with_lines(stars.select(F.col("x_h").alias("a"), F.col("y_h").alias("b")), texts), similarity), "star-links")

    # lines of a bucket that the stars left in different components
    found = components(links).toDF("h", "comp")
    named = texts.select("k", "h").join(found, "h", "left").select("k", "h", F.coalesce("comp", "h").alias("comp"))
    placed = staged(crowd.join(named, "k").select("band", "k", "h", "comp", "pivot"), "line-places")
    with arrow_batches(spark, *VERIFIED_BATCH):
        more = staged(verified(_with_lines(cross_pairs(placed, texts, similarity), texts), similarity), "cross-links")

    label = components(links.union(more)).toDF("h", "label")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row", "pos")).alias("first")
    known = lines.groupBy("h").agg(F.count("*").alias("n"), first).join(label, "h", "left").where("n > 1 OR label IS NOT NULL")
    known = staged(known.select("h", F.coalesce("label", "h").alias("label"), "first"), "repeated-lines")
    stays = known.groupBy("label").agg(F.min("first").alias("stay"))
    of_h = known.join(stays, "label").select("h", F.col("stay.row").alias("stay_row"), F.col("stay.pos").alias("stay_pos"))
    goes = lines.select("row", "pos", "h").join(of_h, "h").where("row <> stay_row OR pos <> stay_pos")
    with released(lines, crowd, texts, links, placed, more, known):
        return staged(goes.groupBy("row").agg(F.collect_list("pos").alias("gone")), "gone-lines")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` without the lines that go; with ``counts``, two more columns: the lines of
    the text and those that went."""
    row, gone = fresh(docs, "row"), fresh(docs, "gone")
    d = with_row_place(docs, row)
    goes = line_groups(d.select(F.col(row).alias("row"), F.col(key).alias("key"), F.col(text).alias("text")), similarity)
    # the rows that lose lines grow with the corpus: the same join whatever its size
    out = d.join(goes.withColumnsRenamed({"row": row, "gone": gone}).hint("merge"), row, "left")
    loses, lines = F.col(gone).isNotNull(), fresh(out, "lines")
    # a column of its own: within the lambda below, a text would be split once a line
    out = out.withColumn(lines, F.when(loses | F.lit(bool(counts)), F.split(text, "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n")
    added = {}
    if counts:
        n = F.when(F.col(text).isNull() | (F.col(text) == ""), 0).otherwise(F.size(lines))
        added = {counts[0]: n.cast("long"), counts[1]: F.coalesce(F.size(gone), F.lit(0)).cast("long")}
    left = F.when(loses, kept).otherwise(F.col(text))
    return out.withColumns(added).withColumn(text, left).select(*docs.columns, *added)


__all__ = ["bit_field", "buckets", "cross_pairs", "dedup_lines", "line_groups", "signed", "texts_of", "verified"]
