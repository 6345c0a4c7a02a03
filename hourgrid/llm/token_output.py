"""Token ids of all documents in binary files of patched frame-of-reference blocks.

The documents are dealt to tasks in ranges of (key, hash of the text) and sorted there; each task
tokenises its range and writes it to files below a shared folder (``for_blocks``), a new one once a
file holds ``file_ids`` ids.  A file carries the number of its task's attempt in its name and counts
only if it is in the manifest, a Parquet table of one row a file, which Spark writes from the tasks
that ended: files of lost or repeated attempts are never read.  Files in the order of the manifest
are all ids in the order of the keys; the ids before a file are a running sum over the manifest.

``write`` returns the manifest, ``read`` a row a document from the files, ``ids_at`` any run of ids.

Null texts are empty and give the end id only.  Null keys come first.  Rows of one key are ordered by
the hash of their text, then by the text; equal rows are alike, each is written.  An empty table
gives an empty manifest and no rows.  A very long text is one document, whole, and never parted
between files.  Columns other than the key and the text play no part.  Memory of a task: a batch of
texts, ``RUN_BLOCKS`` blocks, the document table of one file and a word cache of bounded size.

Added tokens of the tokenizer's file in a text (``<|endoftext|>``) get their ids, as the
library does by default.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourgrid.llm import for_blocks
from hourgrid.llm.common import arrow_batches, staged
from hourgrid.session import scratch_path

#: Ids of a file: about 60 MB of blocks.
FILE_IDS = 1 << 25
#: Distinct words that a worker remembers (and what a batch adds), and their longest.
CACHED_WORDS = 1 << 20
CACHED_CHARS = 64
#: Characters beyond printable ones of Latin scripts, common punctuation and plain white space; the dotted I is one too.
UNUSUAL = re.compile("[^\t-\r\x20-~\xa1-įı-ɏ‐-‧€]")

#: Marks that may follow the letters of a word: together they are one piece.
MARKS = ".,;:!?()[]{}\"'*#$%&|<>-_/+=~^@\\`"

MANIFEST = "part long, nth long, path string, n_docs long, n_ids long"


class WordTokenizer:
    """The tokenizer of a ``tokenizers`` file.

    If the file drops white space and lower-cases (no piece of a text goes across white space), a
    text of usual characters is cut there and the library encodes each distinct word once, or
    its letters and the marks after them, which are pieces of their own; any other text goes to
    the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        told = json.loads(self.tok.to_str())
        self.by_word = self._by_word(told)
        self.added = [t["content"] for t in told["added_tokens"]]
        # words seen of late, and those seen before them
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        suffix = told["model"].get("end_of_word_suffix")
        if suffix:
            self.ends[[n for t, n in vocabulary.items() if t.endswith(suffix)]] = True
        self.by_word = self.by_word and bool(suffix)

    @staticmethod
    def _by_word(told: dict) -> bool:
        """Whether the file normalises and splits as said above."""
        steps = (told.get("normalizer") or {}).get("normalizers", [])
        kinds = [s["type"] for s in steps]
        if kinds != ["NFC", "Replace", "Lowercase"] or steps[1]["pattern"] != {"Regex": "\\s+"}:
            return False
        split = ((told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        pattern = split.get("pattern", {}).get("Regex", "")
        return split.get("type") == "Split" and split.get("behavior") == "Removed" and pattern.endswith("[^\\s\\p{L}\\p{N}]+")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        usual = [self.by_word and not UNUSUAL.search(t or "") and not any(a in (t or "") for a in self.added) for t in texts]
        some = iter(self._by_words([t or "" for t, u in zip(texts, usual, strict=True) if u]))
        return [next(some) if u else self._whole(t or "") for t, u in zip(texts, usual, strict=True)]

    def _whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """Texts of usual characters: distinct words are looked up, then put in place all at once."""
        if not texts:
            return []
        cut = pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
        coded = cut.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        ids = list(map(self.known.get, words))
        if None in ids:
            new = []
            for i in [i for i, x in enumerate(ids) if x is None]:
                x = ids[i] = self.older.get(words[i])
                if x is None:
                    new.append(i)
                else:
                    self.known[words[i]] = x
            for i, x in zip(new, self._learn([words[i] for i in new]), strict=True):
                ids[i] = x
            if len(self.known) > CACHED_WORDS // 2:
                self.known, self.older = {}, self.known
        flat = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        starts = np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        n = sizes[at]
        ends = np.append(0, np.cumsum(n))
        out = flat[np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[cut.offsets.to_numpy()]).tolist()
        return [out[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of words that are not known.  The library encodes their letters many in one text: each
        is one piece of it, and a piece ends with the one token that ends a word."""
        known, stems = self.known, [w.rstrip(MARKS) for w in words]
        new = [w for w in set(stems) if w.isalpha() and w not in known]
        here: dict[str, bytes] = {}
        for a in range(0, len(new), 4096):
            ids = np.array(self.tok.encode(" ".join(new[a : a + 4096]), add_special_tokens=False).ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            data = ids.tobytes()
            here.update(zip(new[a : a + 4096], [data[x:y] for x, y in zip([0, *ends], ends, strict=False)], strict=True))
        out = []
        for w, stem in zip(words, stems, strict=True):
            got = here.get(stem) or known.get(stem)
            if stem.isalpha() and got is not None:
                got = got + self._marks(w[len(stem) :]) if len(stem) < len(w) else got
            else:
                got = self._whole(w)
            out.append(got)
            if len(w) <= CACHED_CHARS:
                known[w] = got
        return out

    def _marks(self, marks: str) -> bytes:
        got = self.marks.get(marks)
        if got is None:
            got = self._whole(marks)
            if len(marks) <= CACHED_CHARS and len(self.marks) < CACHED_WORDS:
                self.marks[marks] = got
        return got


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 2, key: str = "doc_id", text: str = "text", folder: str | None = None, block_ids: int = for_blocks.BLOCK_IDS, percentile: float = for_blocks.PERCENTILE, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of every document and its ``end_id``; the manifest: (part, nth, path, n_docs, n_ids, start),
    ``start`` being the ids in the files before.  ``folder`` must be one that all executors share."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-ids")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    # equal keys are parted by the text, equal rows by their number: none of them fills a task
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("key"), F.asc("h")]
    dealt = rows.repartitionByRange(*order, F.asc("row")).sortWithinPartitions(*order, F.asc_nulls_first("text")).select("key", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, task = word_tokenizer(tokenizer_path), TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        done: list[tuple] = []
        out = path = None

        def close() -> None:
            out.close()
            done.append((part, len(done), path, len(out.keys), out.n_ids))

        for b in batches:
            for k, ids in zip(b.column(0).to_pylist(), tok.encode(b.column(1).to_pylist()), strict=True):
                if out is None:
                    path = f"{folder}/part-{part:06d}-{len(done):04d}-{attempt}.pfr"
                    out = for_blocks.Writer(path, block_ids, percentile)
                out.add(k, ids + end)
                if out.n_ids >= file_ids:
                    close()
                    out = None
        if out is not None:
            close()
        cols = list(zip(*done, strict=True)) or [[]] * 5
        names = ["part", "nth", "path", "n_docs", "n_ids"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "path" else pa.int64()) for n, c in zip(names, cols, strict=True)], names)

    # many texts at a time share their words
    with arrow_batches(spark, 4096, "12m"):
        files = staged(dealt.mapInArrow(run, MANIFEST), "token-files")
    # one row a file: a window in one task, and what the reading tasks are dealt
    before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read(manifest: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids) of every document, from the files; ``start`` counts the ids
    of all documents before, ``ids`` are little-endian uint32."""
    return _read(manifest, "ids binary", lambda x: x.astype("<u4").tobytes())


def checksums(manifest: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files."""
    return _read(manifest, "ids_crc32 long", lambda x: zlib.crc32(x.astype("<u4", copy=False)))


def _read(manifest: DataFrame, column: str, of) -> DataFrame:
    spark = manifest.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    kind = pa.binary() if column.endswith("binary") else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = for_blocks.Reader(path)
                first = start + np.cumsum(f.counts) - f.counts
                keys = pa.array(f.keys, mask=f.null)
                at, got, size = 0, [], 0
                for ids in f.documents():
                    got.append(of(ids))
                    size += len(ids)
                    if len(got) == 4096 or size >= 1 << 22:
                        yield _rows(keys, first, f.counts, at, got, kind, column)
                        at, got, size = at + len(got), [], 0
                if got:
                    yield _rows(keys, first, f.counts, at, got, kind, column)
                f.close()

    dealt = manifest.select("path", "start").repartition(tasks)
    return dealt.mapInArrow(run, f"key long, start long, n_tokens long, {column}")


def _rows(keys: pa.Array, first: np.ndarray, counts: np.ndarray, at: int, got: list, kind: pa.DataType, column: str) -> pa.RecordBatch:
    n = len(got)
    return pa.RecordBatch.from_arrays(
        [keys.slice(at, n), pa.array(first[at : at + n]), pa.array(counts[at : at + n]), pa.array(got, kind)],
        names=["key", "start", "n_tokens", column.split()[0]],
    )


def ids_at(spark: SparkSession, manifest: DataFrame, start: int, count: int) -> np.ndarray:
    """``count`` ids from place ``start`` of the whole stream, by the index: only their blocks are read."""
    hit = manifest.where((F.col("start") < start + count) & (F.col("start") + F.col("n_ids") > start)).orderBy("start").collect()
    parts = []
    for r in hit:
        f = for_blocks.Reader(r["path"])
        a, b = max(start - r["start"], 0), min(start + count - r["start"], r["n_ids"])
        parts.append(f.ids(a, b - a))
        f.close()
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


__all__ = ["WordTokenizer", "checksums", "ids_at", "read", "write"]
