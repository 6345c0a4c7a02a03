"""Patched frame-of-reference blocks of unsigned 32-bit ids, and files of them.

A block holds up to ``size`` ids.  Its smallest id is subtracted, the differences are packed at the
width that holds the given percentile of them, and the bits beyond that width go to a list of
exceptions (place, bits), which patches them in when the block is read.

File, little-endian::

    magic | blocks | documents: n keys (int64), n null marks (uint8), n counts of ids (int64)
          | index: start of each block in the file (uint64), crc32 of each (uint32)
          | footer: ids, documents, blocks, start of documents, start of index, size, crc32 of both tables, magic

    block: base uint32, count uint16, exceptions uint16, width uint8, packed words uint32 [width][size/32],
           places uint16 [exceptions], high bits uint32 [exceptions]

Ids lie crosswise: word k of lane j holds bits of the ids j, j + size/32, j + 2*size/32, ... so that
whole rows of lanes are shifted at once.  Any run of ids is read by the index without the blocks before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyarrow import fs

MAGIC = b"PFR1"
BLOCK_IDS = 1024
PERCENTILE = 90
#: Blocks that are packed or read at a time.
RUN_BLOCKS = 256
HEAD = struct.Struct("<IHHB")
FOOT = struct.Struct("<QQQQQII4s")


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit length of each number."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def pack(x: np.ndarray, width: int) -> np.ndarray:
    """(blocks, size) numbers of at most ``width`` bits as (blocks, width, size/32) words."""
    n, size = x.shape
    rows, out = x.reshape(n, 32, size // 32), np.zeros((n, width, size // 32), np.uint32)
    for r in range(32 if width else 0):
        word, off = divmod(r * width, 32)
        out[:, word] |= rows[:, r] << np.uint32(off)
        if off + width > 32:
            out[:, word + 1] |= rows[:, r] >> np.uint32(32 - off)
    return out


def unpack(words: np.ndarray, width: int, size: int) -> np.ndarray:
    """The numbers that :func:`pack` packed."""
    n = len(words)
    if not width:
        return np.zeros((n, size), np.uint32)
    words, out = words.reshape(n, width, size // 32), np.empty((n, 32, size // 32), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for r in range(32):
        word, off = divmod(r * width, 32)
        v = words[:, word] >> np.uint32(off)
        if off + width > 32:
            v = v | (words[:, word + 1] << np.uint32(32 - off))
        out[:, r] = v & mask
    return out.reshape(n, size)


def encode(ids: np.ndarray, size: int = BLOCK_IDS, percentile: float = PERCENTILE) -> list[bytes]:
    """Blocks of ``ids``; only the last may hold fewer than ``size``."""
    if size % 32 or not 32 <= size <= 32768:
        raise ValueError("a block has a multiple of 32 ids, 32768 at most")
    if not 0 < percentile <= 100:
        raise ValueError("the percentile lies between 0 and 100")
    if not len(ids):
        return []
    n = -(-len(ids) // size)
    last = len(ids) - (n - 1) * size
    x = np.empty(n * size, np.uint32)
    x[: len(ids)] = ids
    x[len(ids) :] = x[(n - 1) * size : len(ids)].min()
    x = x.reshape(n, size)
    base = x.min(axis=1)
    x = x - base[:, None]
    counts = np.full(n, size)
    counts[-1] = last
    k = int(np.ceil(percentile * size / 100)) - 1
    width = _bits(np.partition(x, k, axis=1)[:, k])
    if last < size:  # the percentile of its own ids only
        width[-1] = _bits(np.sort(x[-1, :last])[int(np.ceil(percentile * last / 100)) - 1 :][:1])[0]
    high = (x.astype(np.uint64) >> width.astype(np.uint64)[:, None]).astype(np.uint32)
    rows, places = np.nonzero(high)
    high = high[rows, places]
    cuts = np.searchsorted(rows, np.arange(n + 1))
    low = x & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    packed: list[bytes] = [b""] * n
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        for i, p in zip(at.tolist(), pack(low[at], w), strict=True):
            packed[i] = p.tobytes()
    places = places.astype("<u2")
    out = []
    for i, (b, c, w) in enumerate(zip(base.tolist(), counts.tolist(), width.tolist(), strict=True)):
        s, e = int(cuts[i]), int(cuts[i + 1])
        out.append(HEAD.pack(b, c, e - s, w) + packed[i] + places[s:e].tobytes() + high[s:e].tobytes())
    return out


def decode(blocks: list[bytes], size: int = BLOCK_IDS) -> np.ndarray:
    """The ids of ``blocks``, one after the other."""
    if not blocks:
        return np.zeros(0, np.uint32)
    heads = np.array([HEAD.unpack_from(b) for b in blocks], np.int64)
    out = np.empty((len(blocks), size), np.uint32)
    for w in np.unique(heads[:, 3]).tolist():
        at = np.flatnonzero(heads[:, 3] == w)
        n = w * (size // 32)
        words = np.stack([np.frombuffer(blocks[i], "<u4", n, HEAD.size) for i in at.tolist()])
        out[at] = unpack(words, w, size)
    for i in np.flatnonzero(heads[:, 2]).tolist():
        n, w = int(heads[i, 2]), int(heads[i, 3])
        p = HEAD.size + 4 * w * (size // 32)
        places = np.frombuffer(blocks[i], "<u2", n, p)
        high = np.frombuffer(blocks[i], "<u4", n, p + 2 * n)
        out[i, places] |= (high.astype(np.uint64) << np.uint64(w)).astype(np.uint32)
    out += heads[:, 0].astype(np.uint32)[:, None]
    counts = heads[:, 1]
    return out.reshape(-1) if (counts == size).all() else np.concatenate([x[:c] for x, c in zip(out, counts.tolist(), strict=True)])


class Writer:
    """One file: documents are added in order, blocks run on across them."""

    def __init__(self, uri: str, size: int = BLOCK_IDS, percentile: float = PERCENTILE):
        where, path = fs.FileSystem.from_uri(uri)
        where.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = where.open_output_stream(path)
        self.size, self.percentile = size, percentile
        self.n_ids, self.at, self.waiting, self.n_waiting = 0, 0, [], 0
        self.starts: list[int] = []
        self.crcs: list[int] = []
        self.keys: list[int | None] = []
        self.counts: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: int | None, ids: bytes) -> None:
        """A document: its key and its ids, little-endian uint32."""
        n = len(ids) // 4
        self.keys.append(key)
        self.counts.append(n)
        self.n_ids += n
        self.waiting.append(ids)
        self.n_waiting += n
        if self.n_waiting >= RUN_BLOCKS * self.size:
            self._blocks(self.n_waiting // self.size * self.size)

    def _blocks(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        for b in encode(ids[:n], self.size, self.percentile):
            self.starts.append(self.at)
            self.crcs.append(zlib.crc32(b))
            self._put(b)
        self.waiting, self.n_waiting = ([ids[n:].tobytes()], len(ids) - n) if n < len(ids) else ([], 0)

    def close(self) -> None:
        if self.n_waiting:
            self._blocks(self.n_waiting)
        null = np.array([k is None for k in self.keys], np.uint8)
        keys = np.array([0 if k is None else k for k in self.keys], "<i8")
        docs = keys.tobytes() + null.tobytes() + np.array(self.counts, "<i8").tobytes()
        index = np.array(self.starts, "<u8").tobytes() + np.array(self.crcs, "<u4").tobytes()
        at = self.at
        self._put(docs + index)
        self._put(FOOT.pack(self.n_ids, len(keys), len(self.starts), at, at + len(docs), self.size, zlib.crc32(docs + index), MAGIC))
        self.out.close()


class Reader:
    """A file of :class:`Writer`; broken files raise."""

    def __init__(self, uri: str):
        where, path = fs.FileSystem.from_uri(uri)
        self.uri, self.file = uri, where.open_input_file(path)
        n = self.file.size()
        foot = self.file.read_at(FOOT.size, n - FOOT.size) if n >= FOOT.size + len(MAGIC) else b""
        if len(foot) != FOOT.size or foot[-4:] != MAGIC:
            raise ValueError(f"{uri} is no file of id blocks, or not whole")
        self.n_ids, n_docs, n_blocks, docs_at, index_at, self.size, crc, _ = FOOT.unpack(foot)
        tables = self.file.read_at(n - FOOT.size - docs_at, docs_at)
        if zlib.crc32(tables) != crc:
            raise ValueError(f"the tables of {uri} are broken")
        self.null = np.frombuffer(tables, np.uint8, n_docs, 8 * n_docs).astype(bool)
        self.keys = np.frombuffer(tables, "<i8", n_docs)
        self.counts = np.frombuffer(tables, "<i8", n_docs, 9 * n_docs)
        self.starts = np.append(np.frombuffer(tables, "<u8", n_blocks, index_at - docs_at), docs_at).astype(np.int64)
        self.crcs = np.frombuffer(tables, "<u4", n_blocks, index_at - docs_at + 8 * n_blocks)

    def _run(self, a: int, b: int) -> np.ndarray:
        """The ids of the blocks a to b."""
        s = self.starts[a : b + 1]
        data = self.file.read_at(int(s[-1] - s[0]), int(s[0]))
        cuts = (s - s[0]).tolist()
        blocks = [data[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
        if any(zlib.crc32(x) != c for x, c in zip(blocks, self.crcs[a:b].tolist(), strict=True)):
            raise ValueError(f"blocks {a} to {b} of {self.uri} are broken")
        return decode(blocks, self.size)

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from place ``start``; only their blocks are read."""
        if start < 0 or count < 0 or start + count > self.n_ids:
            raise ValueError(f"{self.uri} has no ids {start} to {start + count}")
        if not count:
            return np.zeros(0, np.uint32)
        a, b = start // self.size, -(-(start + count) // self.size)
        return self._run(a, b)[start - a * self.size :][:count]

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document, in order, a run of blocks in memory at a time."""
        held, at = np.zeros(0, np.uint32), 0
        for n in self.counts.tolist():
            if len(held) < n:
                parts, have = [held], len(held)
                while have < n:
                    b = min(at + RUN_BLOCKS, len(self.crcs))
                    parts.append(self._run(at, b))
                    have, at = have + len(parts[-1]), b
                held = np.concatenate(parts)
            yield held[:n]
            held = held[n:]

    def close(self) -> None:
        self.file.close()


__all__ = ["BLOCK_IDS", "PERCENTILE", "Reader", "Writer", "decode", "encode", "pack", "unpack"]
