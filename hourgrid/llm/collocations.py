"""Phrase collocations from sorted streams of counts.

Words are counted, and those with ``least`` occurrences are numbered by the occurrences of all words
before them in the order of (language, bytes).  Such numbers keep the order, so a pair or triple of
them is a record of fixed width, and they say where in its stream a record belongs: streams
are dealt to partitions in prefix order by plain arithmetic, the more occurrences the more room, so
that a very frequent word spreads over many partitions.

1. Each task codes runs of a language's words against a dictionary of the run; the dictionaries, not
   the occurrences, are joined with the numbers.
2. Pairs are counted by sorting: within a run, then in the partitions of the stream, where
   one pass adds up equal neighbours.  Only pairs with ``least`` occurrences stay: a triple has
   no more occurrences than either of its pairs.
3. Triples likewise.  A bit field of fixed size over the pairs that stayed spares triples that cannot
   reach ``least``; it lets pass more than it must, never less, and counts do not depend on it.
4. The streams of triples in prefix order (first two words) and in suffix order (last two) run in
   lockstep with that of the pairs (sort-merge joins: no hash tables), and pairs and triples by
   first and last word with that of the words.  That gives the counts of the left and right part of
   every cut, and the extensions that make a shorter phrase superfluous.

Null texts are empty, null languages ``und``.  Repeated rows count each.  A text without words, an
empty table, a language without candidates give no rows.  Very long texts are coded whole, in runs;
neither pieces nor phrases are cut at a run's end.  Columns other than language and text play
no part.  Arithmetic is in decimals of 38 digits; counts beyond 10**16, for which a product would pass
them, raise.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.llm.common import arrow_batches, released, staged

#: Words of a run: what a task codes against one dictionary.
RUN_WORDS = 1 << 20
#: Words of a run whose phrases are sorted at a time.
SLICE_WORDS = 1 << 19
#: Bits of the field over frequent pairs (16 MB), whatever the corpus.
FIELD_BITS = 1 << 27

#: Parts of a language's candidates that are ranked on their own first.
SHARES = 64

CASE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"." * 10)
#: Ends a piece; no word holds it.
END = b"."


def tokens(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8, and ``END`` where a piece ends."""
    return text.translate(CASE).replace(END, b" . ").split()


class Run:
    """Words of one language, coded as they come."""

    def __init__(self) -> None:
        self.code: defaultdict[bytes, int] = defaultdict()
        self.code.default_factory = self.code.__len__
        self.code[END]  # is 0
        self.parts: list[np.ndarray] = []

    def add(self, words: list[bytes]) -> None:
        words.append(END)
        self.parts.append(np.fromiter(map(self.code.__getitem__, words), np.int32, len(words)))

    def row(self) -> tuple[list[bytes], list[int], bytes]:
        """The words in the order of their bytes, their counts, and the coded run (-1: end of a piece)."""
        words = list(self.code)
        order = sorted(range(1, len(words)), key=words.__getitem__)
        place = np.empty(len(words), np.int32)
        place[0] = -1
        place[order] = np.arange(len(order), dtype=np.int32)
        codes = place[np.concatenate(self.parts)]
        counts = np.bincount(codes[codes >= 0], minlength=len(order))
        return [words[i] for i in order], counts.tolist(), codes.astype("<i4").tobytes()


def coded(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(run, lang, words, counts, codes): all texts, coded in runs of a language."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, Run] = {}
        number, held = TaskContext.get().partitionId() << 32, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            for of, r in runs.items():
                words, counts, codes = r.row()
                if words:
                    cols = [[number], [of], [words], [counts], [codes]]
                    kinds = [pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
                    arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                    arrays[2] = arrays[2].cast(pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays(arrays, ["run", "lang", "words", "counts", "codes"])
                    number += 1
            runs.clear()
            held = 0

        for b in batches:
            for of, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = tokens(t)
                if of not in runs:
                    runs[of] = Run()
                held += len(words)
                runs[of].add(words)
                if held >= RUN_WORDS:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(run, "run long, lang string, words array<string>, counts array<long>, codes binary")


def numbered(counts: DataFrame, least: int) -> DataFrame:
    """(lang, word, f, start) of the words with ``least`` occurrences; ``start`` is the number of
    occurrences of those before, in the order of (lang, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            f = b.column(2).to_numpy()
            ends = total + np.cumsum(f)
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(f), part)), pa.array(ends)], ["lang", "word", "f", "part", "ends"])

    often = counts.where(F.col("f") >= least).repartitionByRange("lang", "word").sortWithinPartitions("lang", "word")
    words = staged(often.mapInArrow(run, "lang string, word string, f long, part long, ends long"), "words")
    # one number a partition
    before, at = [], 0
    for r in words.groupBy("part").agg(F.max("ends").alias("n")).orderBy("part").collect():
        before.append((r["part"], at))
        at += r["n"]
    offset = F.broadcast(words.sparkSession.createDataFrame(before, "part long, before long"))
    return words.join(offset, "part").select("lang", "word", "f", (F.col("before") + F.col("ends") - F.col("f")).alias("start"))


def resolved(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(codes, places, starts, fs): every run, and of its words those that have a number."""
    each = runs.select("run", "lang", F.posexplode("words").alias("place", "word"))
    entry = F.struct("place", "start", "f")
    known = each.join(words, ["lang", "word"]).groupBy("run").agg(F.sort_array(F.collect_list(entry)).alias("known"))
    both = runs.select("run", "codes").join(known, "run")
    return both.select("codes", *[F.col(f"known.{c}").alias(f"{c}s") for c in ("place", "start", "f")])


def _runs(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, starts, fs): words without a number become -1, the others are coded by place in ``starts``."""
    for codes, places, starts, fs in zip(*[b.column(i) for i in range(4)], strict=True):
        c = np.frombuffer(codes.as_buffer(), "<i4")
        places, starts, fs = (np.asarray(x.values) for x in (places, starts, fs))
        to = np.full(int(max(c.max(initial=-1), 0)) + 2, -1, np.int64)  # the last is that of -1
        to[places] = np.arange(len(places))
        yield to[c], starts, fs


def counted(codes: np.ndarray, size: int, v: int, passes=None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases of ``size`` words of a slice of codes below ``v`` and their counts, in prefix
    order; -1 breaks phrases.  ``passes`` tells of pairs of codes whether they may be in a phrase."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros((0, size), np.int64), np.zeros(0, np.int64)
    cols = [codes[i : i + n] for i in range(size)]
    ok = np.logical_and.reduce([c >= 0 for c in cols])
    cols = [c[ok] for c in cols]
    if passes:
        keep = np.logical_and.reduce([passes(a, b) for a, b in zip(cols, cols[1:], strict=False)])
        cols = [c[keep] for c in cols]
    words = None
    if v**size >= 1 << 63:  # too many words for keys of 64 bits: those of the slice only
        words, at = np.unique(np.concatenate(cols), return_inverse=True)
        cols, v = at.reshape(size, -1), len(words)
    key = cols[0].astype(np.int64)
    for c in cols[1:]:
        key = key * v + c
    key, counts = np.unique(key, return_counts=True)
    out = np.empty((len(key), size), np.int64)
    for i in reversed(range(size)):
        key, out[:, i] = np.divmod(key, max(v, 1))
    return (out if words is None else words[out]), counts


def bit_of(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Place of a pair in a field of ``bits`` (a power of two)."""
    mix = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mix ^= mix >> np.uint64(29)
    return (mix * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(65 - bits.bit_length())


def phrases(runs: DataFrame, size: int, total: int, partitions: int, field=None) -> DataFrame:
    """(part, w1, .., f): phrases of ``size`` words counted by run, and the partition of their stream."""
    names = [f"w{i + 1}" for i in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if field is None else np.frombuffer(field.value, np.uint8)
        for b in batches:
            for codes, starts, fs in _runs(b):
                passes = None
                if bits is not None:

                    def passes(x, y, s=starts):
                        at = bit_of(s[x], s[y], 8 * len(bits))
                        return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

                for a in range(0, len(codes), SLICE_WORDS):
                    got, n = counted(codes[a : a + SLICE_WORDS + size - 1], size, len(starts), passes)
                    if len(n):
                        w = starts[got]
                        part = (w[:, 0] + fs[got[:, 0]] * (w[:, 1] / total)) * (partitions / total)
                        part = np.minimum(part.astype(np.int32), partitions - 1)
                        yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array(np.ascontiguousarray(x)) for x in w.T], pa.array(n)], ["part", *names, "f"])

    return runs.mapInArrow(run, f"part int, {', '.join(f'{c} long' for c in names)}, f long")


def stream(parts: DataFrame, size: int, partitions: int, least: int) -> DataFrame:
    """The count stream in prefix order: equal neighbours added up, those with ``least`` kept."""
    names = [f"w{i + 1}" for i in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] | None = None

        def told(w: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            keep = f >= least
            if keep.any():
                yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(x)) for x in w[keep].T], pa.array(f[keep])], [*names, "f"])

        for b in batches:
            if not b.num_rows:
                continue
            w = np.stack([b.column(i).to_numpy() for i in range(size)], axis=1)
            f = b.column(size).to_numpy()
            if held is not None:
                w, f = np.concatenate([held[0], w]), np.concatenate([held[1], f])
            first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]).any(axis=1)])
            w, f = w[first], np.add.reduceat(f, first)
            held = w[-1:], f[-1:]
            yield from told(w[:-1], f[:-1])
        if held is not None:
            yield from told(*held)

    dealt = parts.repartitionById(partitions, "part").sortWithinPartitions(*names).select(*names, "f")
    return dealt.mapInArrow(run, f"{', '.join(f'{c} long' for c in names)}, f long")


def bit_field(pairs: DataFrame, bits: int = FIELD_BITS) -> bytes:
    """The bits of all ``pairs``: ``bits`` / 8 bytes on the driver, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(bit_of(b.column(0).to_numpy(), b.column(1).to_numpy(), bits))
            word, mask = (at >> np.uint64(5)).astype(np.int64), np.int64(1) << (at & np.uint64(31)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(np.bitwise_or.reduceat(mask, first) if len(first) else mask)], ["word", "bits"])

    told = pairs.select("w1", "w2").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 32, "<u4")
    out[told.column(0).to_numpy()] = told.column(1).to_numpy()
    return out.tobytes()


def _score(a: str, left: str, right: str) -> Column:
    d = "CAST({} AS DECIMAL(19, 0))".format
    return F.expr(f"({d(a)} * {d(a)} * 1000000) DIV ({d(left)} * {d(right)})")


def candidates(pairs: DataFrame, triples: DataFrame, words: DataFrame, share: int) -> DataFrame:
    """(w1, w2, w3, a, l, r, score) of the phrases that stay; ``w3`` of a pair is null."""
    by_word = lambda i, name: words.select(F.col("start").alias(f"w{i}"), F.col("f").alias(name)).hint("merge")
    prefix = pairs.select("w1", "w2", F.col("f").alias("f12")).hint("merge")
    suffix = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("f23")).hint("merge")
    t = triples.withColumnRenamed("f", "a").join(prefix, ["w1", "w2"]).join(by_word(1, "f1"), "w1")
    t = t.join(suffix, ["w2", "w3"]).join(by_word(3, "f3"), "w3")
    t = staged(t.withColumns({"s1": _score("a", "f1", "f23"), "s2": _score("a", "f12", "f3")}), "triples-cut")
    first = F.col("s1") <= F.col("s2")
    cut = lambda one, two: F.when(first, F.col(one)).otherwise(F.col(two))
    three = t.select("w1", "w2", "w3", "a", cut("f1", "f12").alias("l"), cut("f23", "f3").alias("r"), F.least("s1", "s2").alias("score"))
    inside = t.where(F.col("a") * 100 >= F.col("f12") * share).select("w1", "w2")
    inside = inside.union(t.where(F.col("a") * 100 >= F.col("f23") * share).select("w2", "w3")).distinct()
    p = pairs.withColumnRenamed("f", "a").join(inside.hint("merge"), ["w1", "w2"], "left_anti")
    p = p.join(by_word(1, "l"), "w1").join(by_word(2, "r"), "w2").withColumn("score", _score("a", "l", "r"))
    return p.select("w1", "w2", F.lit(None).cast("long").alias("w3"), "a", "l", "r", "score").union(three)


def mine(docs: DataFrame, top: int = 2000, least: int = 10, share: int = 50, lang: str = "lang", text: str = "text", field_bits: int = FIELD_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 or 3 words of each language."""
    spark = docs.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    with arrow_batches(spark, 2048):
        runs = staged(coded(docs, lang, text), "runs")
    each = runs.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    counts = staged(each.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f")), "word-counts")
    n = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    with arrow_batches(spark, 65536):
        words = staged(numbered(counts, least), "numbered-words")
    total = max(words.agg(F.max(F.col("start") + F.col("f"))).first()[0] or 0, 1)
    with released(runs):
        runs = staged(resolved(runs, words), "resolved-runs")

    # records of a stream by the ten thousand; runs, which are megabytes, a few at a time
    with arrow_batches(spark, 65536):
        pairs = staged(stream(phrases(runs, 2, total, partitions), 2, partitions, least), "pairs")
        field = spark.sparkContext.broadcast(bit_field(pairs, field_bits))
        with released(runs):
            triples = staged(stream(phrases(runs, 3, total, partitions, field), 3, partitions, least), "triples")
    field.destroy()
    found = candidates(pairs, triples, words, share)
    # the language is that of the first word; ties at the end of a list stay until phrases part them
    of = words.select(F.col("start").alias("w1"), "lang").hint("merge")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    found = found.join(of, "w1").withColumn("share", F.pmod(F.hash("w1", "w2"), F.lit(SHARES)))
    # first in shares of a language, so that no task sorts all candidates of a frequent one
    for window in (Window.partitionBy("lang", "share").orderBy(F.desc("score"), F.desc("a")), best):
        found = found.withColumn("rank", F.rank().over(window)).where(F.col("rank") <= top).drop("rank")
    found = staged(found.drop("share"), "best")
    for i in (1, 2, 3):
        found = found.join(words.select(F.col("start").alias(f"w{i}"), F.col("word").alias(f"word{i}")), f"w{i}", "left")
    found = found.withColumn("phrase", F.concat_ws(" ", "word1", "word2", "word3")).join(n, "lang")
    rank = F.row_number().over(best.orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


__all__ = ["candidates", "coded", "counted", "mine", "stream", "tokens"]
