"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Only the length of a piece matters for packing, so the plan is made on the
histogram of lengths (at most ``capacity`` rows, whatever the corpus) and then
dealt out to the pieces:

1. tokenise every document; a document longer than the capacity is cut into
   full pieces, of which the first may be shorter;
2. count the pieces by length and collect that histogram;
3. Martello-Toth reduction on the histogram, longest first: a set that
   provably dominates every other feasible set of an item is fixed for good
   (the item alone where nothing fits beside it; the item and the longest one
   that fits where that fills the sequence, where no two items fit beside it,
   or where no two fit beside it with a larger sum and no three do);
4. best-fit decreasing of what is left;
5. every piece gets a number among those of its length, and from that its
   sequence and its place.

Null and empty texts are one piece that holds the end id only.  Repeated rows,
ties and null keys are pieces of their own.  An empty table gives no rows.
Columns other than the key and the text play no part.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourgrid.llm.common import bounded_batches, staged

#: Characters beyond Latin letters and the common punctuation marks.
RARE = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for
    themselves, the others from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class FileTokenizer:
    """The tokenizer of a ``tokenizers`` file.

    Its vocabulary holds the merges in their order, so the ids are the ranks of the merges, and
    a library that works by rank gives the same ids several times faster.  Texts with characters
    beyond those whose class is the same in every version of Unicode go through ``tokenizers``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        told = json.loads(self.tok.to_str())
        of, model = byte_alphabet(), told["model"]
        # added tokens in a text (<|endoftext|>) get their ids, as the library does by default
        self.added = [t["content"] for t in told["added_tokens"]]
        ranks = {bytes(of[c] for c in t): n for t, n in self.tok.get_vocab(with_added_tokens=False).items() if all(c in of for c in t)}
        made = [bytes(of[c] for c in "".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        in_order = [ranks.get(m) for m in made] == list(range(256, 256 + len(made)))
        self.fast = None
        if in_order:
            ranks = {t: n for t, n in ranks.items() if n < 256 + len(made)}
            self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        out = []
        for t in texts:
            if self.fast is not None and not RARE.search(t or "") and not any(a in (t or "") for a in self.added):
                out.append(self.fast.encode_to_numpy(t or "").astype("<u4").tobytes())
            else:
                out.append(array("I", self.tok.encode(t or "", add_special_tokens=False).ids).tobytes())
        return out


@lru_cache(maxsize=2)
def file_tokenizer(path: str) -> FileTokenizer:
    return FileTokenizer(path)


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, key: str, text: str) -> DataFrame:
    """(key, piece, start, length, ids, part, nth): the pieces of every document; ``ids`` are
    little-endian unsigned 32-bit numbers, ``nth`` counts the pieces of a length within the
    input partition ``part``."""
    bounded_batches(docs.sparkSession)
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType(
        [
            T.StructField("key", d.schema["key"].dataType),
            *[T.StructField(c, t) for c, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("part", T.LongType()), ("nth", T.LongType()))],
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part = file_tokenizer(tokenizer_path), TaskContext.get().partitionId()
        end, seen = np.array([end_id], dtype="<u4").tobytes(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            coded = [x + end for x in tok.encode(b.column(1).to_pylist())]
            n = np.array([len(x) // 4 for x in coded], np.int64)
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = n - (pieces - 1) * capacity
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            order = np.argsort(length, kind="stable")
            cnt = np.bincount(length, minlength=capacity + 1)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - np.repeat(np.cumsum(cnt) - cnt, cnt) + np.repeat(seen, cnt)
            seen += cnt
            ids = [coded[d][4 * s : 4 * (s + m)] for d, s, m in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(ids, pa.binary()), pa.array(np.full(len(doc), part)), pa.array(nth)],
                names=["key", "piece", "start", "length", "ids", "part", "nth"],
            )

    return d.mapInArrow(run, schema)


@dataclass
class Group:
    """``count`` sequences with the same lengths in the same order."""

    count: int
    items: list[tuple[int, int]]  # (length, how many)


def reduce_dominated(hist: dict[int, int], capacity: int) -> list[Group]:
    """Fix dominating sets for good; ``hist`` keeps what is left.  What is fixed in bulk stays
    valid, since taking items away only makes the conditions weaker."""
    fixed: list[Group] = []

    def take(count: int, *lengths: int) -> None:
        for x in lengths:
            hist[x] -= count
            if not hist[x]:
                del hist[x]
        items: list[tuple[int, int]] = []
        for x in lengths:
            items = [*items[:-1], (x, items[-1][1] + 1)] if items and items[-1][0] == x else [*items, (x, 1)]
        fixed.append(Group(count, items))

    def others(x: int, up: list[int]) -> Iterator[int]:
        """Smallest lengths beside one ``x``, up to three items."""
        n = 0
        for y in up:
            for _ in range(min(3, hist[y] - (y == x))):
                yield y
                n += 1
                if n == 3:
                    return

    changed = True
    while changed:
        changed = False
        for x in sorted(hist, reverse=True):
            while hist.get(x):
                up, room = sorted(hist), capacity - x
                small = list(others(x, up))
                fits = sum(s <= room for s in np.cumsum(small)) if small else 0
                if not fits:
                    take(hist[x], x)
                    changed = True
                    continue
                best = max(y for y in up if y <= room and hist[y] > (y == x))
                pair = 0
                if fits == 2 and best != room:
                    lower = [y for y in up if y < room and hist[y] > (y == x)]
                    for y in lower:
                        z = max((z for z in lower if z <= room - y and hist[z] > (z == x) + (z == y)), default=None)
                        pair = max(pair, y + z) if z is not None else pair
                if best == room or fits == 1 or (fits == 2 and best >= pair):
                    take(hist[x] // 2 if best == x else min(hist[x], hist[best]), x, best)
                    changed = True
                    continue
                break
    return fixed


def best_fit(hist: dict[int, int], capacity: int) -> list[Group]:
    """Best-fit decreasing of a histogram: equal items go in bulk to the sequences with the
    least room that still takes them."""
    room_of: dict[int, list[Group]] = {}
    for x in sorted(hist, reverse=True):
        n = hist[x]
        while n:
            room = min((r for r in room_of if r >= x), default=capacity)
            if room in room_of:
                g = room_of[room].pop()
                if not room_of[room]:
                    del room_of[room]
            else:
                g = Group(-(-n // (capacity // x)), [])
            each = room // x
            full = min(g.count, n // each)
            last = min(n - full * each, each - 1) if full < g.count else 0
            for count, k in ((full, each), (1 if last else 0, last), (g.count - full - (1 if last else 0), 0)):
                if count:
                    room_of.setdefault(room - k * x, []).append(Group(count, [*g.items, (x, k)] if k else g.items))
            n -= full * each + last
    return [g for gs in room_of.values() for g in gs if g.items]


@dataclass
class Slots:
    """Places by length: the slots of a length are numbered, a range of them for each group."""

    key: np.ndarray  # length << 40 | first number of the range
    count: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << 40 | number, side="right") - 1
        t = number - (self.key[at] & ((1 << 40) - 1))
        return self.sequence[at] + t % self.count[at], self.offset[at] + t // self.count[at] * length


def slots(groups: list[Group]) -> Slots:
    rows, used, sequence = [], {}, 0
    for g in groups:
        offset = 0
        for x, k in g.items:
            rows.append((x << 40 | used.get(x, 0), g.count, sequence, offset))
            used[x] = used.get(x, 0) + g.count * k
            offset += x * k
        sequence += g.count
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 4).T
    return Slots(*cols)


def plan(hist: dict[int, int], capacity: int) -> list[Group]:
    """Groups of sequences that take every item of the histogram."""
    left = {k: v for k, v in hist.items() if v}
    fixed = reduce_dominated(left, capacity)
    return fixed + best_fit(left, capacity)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids, ids_crc32, sequence_id, offset) of every piece.

    The histogram that reaches the driver has at most ``capacity`` rows; the places sent to
    the tasks are a few ranges for each length."""
    names = (key, "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset")
    made = tokenised_pieces(docs, tokenizer_path, capacity, end_id, key, text)
    pieces = staged(made.withColumn("crc", F.crc32("ids")), "pieces")
    counts = staged(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = slots(plan(hist, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length, number):
        import pandas as pd

        seq, off = where.place(length.to_numpy(), number.to_numpy())
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    out = pieces.join(firsts, ["length", "part"]).withColumn("at", place("length", F.col("first") + F.col("nth")))
    return out.select("key", "piece", "start", "length", "ids", "crc", "at.sequence_id", "at.offset").toDF(*names)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence, in place; one is at most the capacity long."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


__all__ = ["best_fit", "pack", "plan", "reduce_dominated", "sequences", "slots"]
