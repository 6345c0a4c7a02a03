"""Byte-level BPE encoding and decoding.

A text is cut into pieces by the split pattern of the vocabulary; each piece is
merged on its own.  A segment tree over the byte positions of a piece holds the
rank of the pair that starts at each live position; its root is the leftmost
minimum, so one merge costs three point updates (the merged place, its left
neighbour, the place that died) of logarithmic depth.  Pieces of one size class
are merged together: the trees of a group are the rows of one numpy array and a
step merges the best pair of every row.

Texts are cut at single spaces first: the pattern never lets a match run from a
non-space character into a following space, so what stands between two such
cuts encodes alone and can be looked up in a bounded cache.

``encode`` returns the columns of its input plus ``ids`` (array of int);
``decode`` turns ids back into bytes.  Null texts count as empty: no ids, empty
bytes.  Repeated rows are encoded each.  A bytes sequence always decodes to
itself, because every single byte has a rank.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hourgrid.llm.common import bounded_batches, fresh

#: Chunks kept by the cache of one Python worker; beyond that it starts anew.
CACHE_CHUNKS = 500_000
#: Cells of the trees merged together (rows x tree size).
GROUP_CELLS = 1 << 20
NO_RANK = np.int64(1) << 40


class RankBpe:
    """Ranks of a vocabulary file and the segment-tree merge over them."""

    def __init__(self, rank_path: str, pattern: str):
        self.pattern = regex.compile(pattern)
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.byte_rank = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        # every way of cutting a known token into two known tokens: (left, right) -> rank
        keys, out = [], []
        for tok, r in ranks.items():
            for k in range(1, len(tok)):
                a, b = ranks.get(tok[:k]), ranks.get(tok[k:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    out.append(r)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_key = np.array(keys, dtype=np.int64)[order]
        self.pair_rank = np.array(out, dtype=np.int64)[order]
        self.whole = ranks
        self.cache: dict[str, bytes] = {}

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair would make; NO_RANK where none does."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NO_RANK)

    def merge_group(self, pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge pieces of at most ``size`` bytes (a power of two), one tree a row.
        Gives the ids of all rows, one after the other, and how many each row has."""
        w = len(pieces)
        lens = np.array([len(p) for p in pieces])
        raw = np.zeros((w, size), dtype=np.uint8)
        raw[np.arange(size) < lens[:, None]] = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ids = self.byte_rank[raw]
        pos = np.arange(size)
        live = pos < lens[:, None]
        nxt = np.broadcast_to(pos + 1, (w, size)).copy()
        prv = np.broadcast_to(pos - 1, (w, size)).copy()
        # a leaf is rank * size + place, so the smallest leaf is the leftmost smallest rank
        tree = np.full((w, 2 * size), NO_RANK * size, dtype=np.int64)
        pair = self.ranks_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(w, size - 1)
        pair[pos[1:] >= lens[:, None]] = NO_RANK
        tree[:, size : 2 * size - 1] = pair * size + pos[:-1]
        tree[:, 2 * size - 1] = NO_RANK * size + size - 1
        node = size // 2
        while node:
            below = tree[:, 2 * node : 4 * node]
            tree[:, node : 2 * node] = np.minimum(below[:, 0::2], below[:, 1::2])
            node //= 2
        rows = np.arange(w)
        while True:
            rows = rows[tree[rows, 1] < NO_RANK * size]
            if not len(rows):
                break
            root = tree[rows, 1]
            i = root % size
            j = nxt[rows, i]
            ids[rows, i] = root // size
            live[rows, j] = False
            k = nxt[rows, j]
            nxt[rows, i] = k
            inside = k < lens[rows]
            prv[rows[inside], k[inside]] = i[inside]
            h = prv[rows, i]
            self._update(tree, rows, j, np.full(len(rows), NO_RANK), size)
            right = self.ranks_of(ids[rows, i], ids[rows, np.minimum(k, size - 1)])
            self._update(tree, rows, i, np.where(inside, right, NO_RANK), size)
            has = h >= 0
            if has.any():
                r, hh, ii = rows[has], h[has], i[has]
                self._update(tree, r, hh, self.ranks_of(ids[r, hh], ids[r, ii]), size)
        return ids[live], live.sum(axis=1)

    @staticmethod
    def _update(tree: np.ndarray, rows: np.ndarray, place: np.ndarray, rank: np.ndarray, size: int) -> None:
        node = place + size
        tree[rows, node] = rank * size + place
        node >>= 1
        while node[0]:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node >>= 1

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and the start and number of those of each piece; pieces of one size
        class go through the trees together."""
        start, count = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        # a known token merges into itself (the vocabulary holds its parts)
        rank = np.fromiter((self.whole.get(p, -1) for p in pieces), np.int64, len(pieces))
        known = np.flatnonzero(rank >= 0)
        start[known], count[known] = np.arange(len(known)), 1
        flat, total = [rank[known]], len(known)
        rest = np.flatnonzero(rank < 0)
        length = np.array([len(pieces[n]) for n in rest], dtype=np.int64)
        classes = np.maximum(1, np.ceil(np.log2(np.maximum(length, 1)))).astype(np.int64)
        for c in np.unique(classes).tolist():
            group, size = rest[classes == c], 1 << c
            step = max(1, GROUP_CELLS // (2 * size))
            for s in range(0, len(group), step):
                part = group[s : s + step]
                ids, n = self.merge_group([pieces[i] for i in part], size)
                count[part] = n
                start[part] = total + np.cumsum(n) - n
                flat.append(ids)
                total += len(ids)
        return np.concatenate(flat), start, count

    def encode_chunks(self, chunks: list[str], alone: list[str]) -> list[bytes]:
        """Ids of ``chunks`` and then of ``alone``, as little-endian uint32 bytes.  A chunk
        follows a space and ends with another character, so all can be split in one pass."""
        pieces = self.pattern.findall("".join([" " + c for c in chunks]))
        for a in alone:
            pieces += self.pattern.findall(a)
        if not pieces:
            return [b""] * (len(chunks) + len(alone))
        number = {p: n for n, p in enumerate(dict.fromkeys(pieces))}
        ids, start, count = self.encode_pieces([p.encode() for p in number])
        which = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        n = count[which]
        ends = np.cumsum(n)
        blob = ids[np.repeat(start[which] - (ends - n), n) + np.arange(ends[-1])].astype("<u4").tobytes()
        chars = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        upto = np.cumsum([*(1 + len(c) for c in chunks), *map(len, alone)])
        cut = np.concatenate([[0], np.where(upto > 0, 4 * ends[np.searchsorted(chars, upto)], 0)]).tolist()
        return [blob[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def encode_texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (uint32) of each text; the new chunks of all texts are merged together."""
        cut = [chunks_of(t) for t in texts]
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        cache = self.cache
        new = list({c for _, cs, _ in cut for c in cs if c not in cache})
        edges = [e for head, _, tail in cut for e in (head, tail)]
        coded = self.encode_chunks(new, edges)
        cache.update(zip(new, coded, strict=False))
        edge = iter(coded[len(new) :])
        return [np.frombuffer(b"".join([next(edge), *[cache[c] for c in cs], next(edge)]), dtype="<u4") for _, cs, _ in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids.tolist()])


#: Between a non-space character and a space.
CUT = re.compile(r"(?<=\S)(?= )")
#: A space that follows white space.
RUN = re.compile(r"\s ")
# The ASCII white space of that pattern, each before a space.
ASCII_RUNS = tuple(c + " " for c in " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f")


def chunks_of(text: str | None) -> tuple[str, list[str], str]:
    """Cut before each space that follows a non-space character: what stands before the
    first cut, the chunks, each without its leading space, and what follows the last cut.
    Runs of white space stay whole."""
    if not text:
        return "", [], ""
    if any(r in text for r in ASCII_RUNS) if text.isascii() else RUN.search(text):
        head, *rest = CUT.split(text)
        return (head, [c[1:] for c in rest[:-1]], rest[-1]) if rest else (head, [], "")
    head, *rest = text.split(" ")
    if not head:  # the text starts with a space: no cut there
        head, *rest = [" " + rest[0], *rest[1:]] if rest else [""]
    return (head, rest[:-1], " " + rest[-1]) if rest else (head, [], "")


@lru_cache(maxsize=2)
def rank_bpe(rank_path: str, pattern: str) -> RankBpe:
    """One vocabulary for each Python worker."""
    return RankBpe(rank_path, pattern)


def encode(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with an array<int> column of token ids (``ids``, prefixed by underscores if taken).

    Null and empty texts give an empty array."""
    bounded_batches(docs.sparkSession)
    name = fresh(docs, ids)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType(), False))])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = rank_bpe(rank_path, pattern)
        for b in batches:
            coded = bpe.encode_texts(b.column(at).to_pylist())
            ends = np.cumsum([0, *map(len, coded)]).astype(np.int32)
            flat = np.concatenate(coded).astype(np.int32) if coded else np.empty(0, np.int32)
            arr = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns, arr], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def decode(coded: DataFrame, rank_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``coded`` with a binary column ``out``: the bytes of its ids (null ids: no bytes)."""
    bounded_batches(coded.sparkSession)
    name = fresh(coded, out)
    schema = T.StructType([*coded.schema.fields, T.StructField(name, T.BinaryType())])
    at = coded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = rank_bpe(rank_path, pattern)
        for b in batches:
            col = b.column(at)
            vals = [bpe.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in col]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vals, pa.binary())], names=[*b.schema.names, name])

    return coded.mapInArrow(run, schema)


def digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, with the ids and the
    decoded bytes kept inside the task that made them."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = rank_bpe(rank_path, pattern)
        for b in batches:
            coded = bpe.encode_texts(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).cast(pa.int64()),
                    pa.array([len(c) for c in coded], pa.int64()),
                    pa.array([hashlib.sha256(" ".join(map(str, c.tolist())).encode()).hexdigest() for c in coded], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(c)).hexdigest() for c in coded], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


__all__ = ["RankBpe", "chunks_of", "decode", "digests", "encode", "rank_bpe"]
