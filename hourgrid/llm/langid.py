"""Language identification by segmentation-marginalised unigrams.

The pieces are the tokens of a fixed public byte-level vocabulary; each language has its
own piece probabilities.  The probability of a word is the sum over all its segmentations
into pieces, by a forward algorithm over its bytes; a text is the product of its words
(letters only, in lower case, each with the space before it).  The probabilities come from
expectation-maximisation over the distinct words of each language: a Spark job an iteration,
whose result is one number for each piece and language.

Learning uses documents outside the held-out fold that have a language, of each language at
most about ``SAMPLE_DOCS``: those whose keys hash lowest.  A null text, one without letters,
and any text when nothing could be learnt, is ``und`` with score 0.  Otherwise the score is
the posterior of the predicted language under equal priors; ties go to the language that
sorts first.  Repeated rows are judged each; null keys are never learnt from.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourgrid.llm.common import bounded_batches, fresh, staged
from hourgrid.llm.words import fold, letter_words

SAMPLE_DOCS = 2_000
ROUNDS = 3
HELD_OUT = (4, 2)
UNDETERMINED = "und"
#: Most bytes that a piece of a vocabulary may have: a file with a longer one raises.
PIECE_BYTES = 256
#: The exponent up to which a scale stays within the range of a float64.
MOST_LOG = 700.0
#: Words whose probabilities a Python worker keeps; beyond that it starts anew.
CACHE_WORDS = 500_000
#: Words that a task holds before it adds them up.
HELD_WORDS = 20_000
#: Cells of a lattice: words x their bytes x piece lengths.
STEP_CELLS = 1 << 21
#: Words of up to this many bytes stay within the range of a float64; longer ones are scaled.
PLAIN_BYTES = 32


class Pieces:
    """All tokens of a vocabulary file, numbered, in a hash table that looks up many byte
    strings at once; every single byte is a piece."""

    BASE = np.uint64(0x9E3779B97F4A7C15)
    MIX = np.uint64(0xD6E8FEB86659FD93)
    SLOTS = 1 << 20

    def __init__(self, rank_path: str):
        with open(rank_path, "rb") as f:
            self.tokens = [base64.b64decode(line.split()[0]) for line in f]
        self.longest = max(map(len, self.tokens))
        if self.longest > PIECE_BYTES:
            raise ValueError(f"a piece has {self.longest} bytes, more than {PIECE_BYTES}")
        self.table = np.full(self.SLOTS, len(self.tokens), np.int32)
        self.hashes = np.zeros(len(self.tokens) + 1, np.uint64)
        for n, t in enumerate(self.tokens):
            h = 0
            for byte in t:
                h = (h * int(self.BASE) + byte + 1) & (2**64 - 1)
            self.hashes[n] = h
            at = (h * int(self.MIX) & (2**64 - 1)) >> 44
            while self.table[at] != len(self.tokens):
                at = (at + 1) % self.SLOTS
            self.table[at] = n
        if len(np.unique(self.hashes[:-1])) < len(self.tokens):
            raise ValueError("two pieces share a hash")

    def __len__(self) -> int:
        return len(self.tokens)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, or the number of pieces."""
        with np.errstate(over="ignore"):
            at = (h * self.MIX >> np.uint64(44)).astype(np.int64)
        got = self.table[at]
        open_ = np.flatnonzero((got < len(self)) & (self.hashes[got] != h))
        while len(open_):
            at[open_] = (at[open_] + 1) % self.SLOTS
            got[open_] = self.table[at[open_]]
            open_ = open_[(got[open_] < len(self)) & (self.hashes[got[open_]] != h[open_])]
        return got


@lru_cache(maxsize=2)
def pieces(rank_path: str) -> Pieces:
    return Pieces(rank_path)


def lattice(words: list[bytes], known: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lens): ids[l, i, w] is the piece of l + 1 bytes that ends at byte i of a word, or
    the number of pieces (probability 0) where there is none."""
    lens = np.array([len(w) for w in words])
    width = int(lens.max())
    raw = np.zeros((len(words), width), np.uint8)
    inside = np.arange(width) < lens[:, None]
    raw[inside] = np.frombuffer(b"".join(words), np.uint8)
    byte = raw.T.astype(np.uint64) + np.uint64(1)
    out = np.full((min(known.longest, width), width, len(words)), len(known), np.int32)
    h = byte
    with np.errstate(over="ignore"):
        for l in range(len(out)):
            if l:  # one byte more at the end of the l bytes that end one byte earlier
                h = h[:-1] * Pieces.BASE + byte[l:]
            out[l, l:] = np.where(inside.T[l:], known.find(h.ravel()).reshape(h.shape), len(known))
    return out, lens


def forward(ids: np.ndarray, lens: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, log): alpha[i, w] times exp(log[i, w]) is the sum over the segmentations of the
    first i bytes, by language.  Only long words are scaled; past its end a word stays as it is."""
    longest, width, n = ids.shape
    langs = prob.shape[1]
    alpha, log = np.zeros((width + 1, n, langs)), np.zeros((width + 1, n, langs))
    alpha[0] = 1.0
    for i in range(width):
        s = np.zeros((n, langs))
        for l in range(min(longest, i + 1)):
            p = prob[ids[l, i]]
            s += alpha[i - l] * p if width <= PLAIN_BYTES else alpha[i - l] * np.exp(np.minimum(log[i - l] - log[i], MOST_LOG)) * p
        live = (lens > i)[:, None]
        alpha[i + 1], log[i + 1] = np.where(live, s, alpha[i]), log[i]
        if width > PLAIN_BYTES:
            log[i + 1] += np.where(live, np.log(s), 0.0)
            alpha[i + 1] = np.where(live, 1.0, alpha[i])
    return alpha, log


def word_scores(words: list[str], known: Pieces, prob: np.ndarray) -> np.ndarray:
    """log p(word | language) of each word, summed over all segmentations."""
    raw = [(" " + w).encode() for w in words]
    out = np.zeros((len(raw), prob.shape[1]))
    for part in steps(raw):
        alpha, log = forward(*lattice([raw[n] for n in part], known), prob)
        out[part] = np.log(alpha[-1]) + log[-1]
    return out


def steps(raw: list[bytes]) -> Iterator[list[int]]:
    """Word numbers by length, in parts of bounded size; a part holds plain or long words only."""
    order = np.argsort(np.fromiter(map(len, raw), np.int64, len(raw)), kind="stable").tolist()
    part: list[int] = []
    for n in order:
        size = len(raw[n])
        if part and ((len(part) + 1) * size * min(size, PIECE_BYTES) > STEP_CELLS or len(raw[part[0]]) <= PLAIN_BYTES < size or size > len(raw[part[0]]) + 2):
            yield part
            part = []
        part.append(n)
    if part:
        yield part


def expected(words: list[bytes], weight: np.ndarray, known: Pieces, prob: np.ndarray) -> np.ndarray:
    """Expected uses of each piece by language; weight[w, lang] is how often a word occurs."""
    ids, lens = lattice(words, known)
    longest, width, n = ids.shape
    alpha, log = forward(ids, lens, prob)
    langs = prob.shape[1]
    # back[i, w]: the sum over the segmentations of the bytes from i on, with its own scale
    back, scale = np.zeros((width + 1, n, langs)), np.zeros((width + 1, n, langs))
    back[lens, np.arange(n)] = 1.0
    for i in range(width - 1, -1, -1):
        s = np.zeros((n, langs))
        for l in range(min(longest, width - i)):
            p = prob[ids[l, i + l]]
            s += p * back[i + l + 1] if width <= PLAIN_BYTES else p * back[i + l + 1] * np.exp(np.minimum(scale[i + l + 1] - scale[i + 1], MOST_LOG))
        live = (lens > i)[:, None]
        back[i], scale[i] = np.where(live, s, back[i]), scale[i + 1]
        if width > PLAIN_BYTES:
            scale[i] += np.where(live, np.log(np.where(s > 0, s, 1.0)), 0.0)
            back[i] = np.where(live, np.where(s > 0, 1.0, 0.0), back[i])
    share = weight / alpha[-1]
    at, uses = [], []
    for i in range(width):
        for l in range(min(longest, i + 1)):
            p = ids[l, i]
            has = np.flatnonzero(p < len(known))
            use = alpha[i - l, has] * prob[p[has]] * back[i + 1, has] * share[has]
            if width > PLAIN_BYTES:
                use *= np.exp(log[i - l, has] + scale[i + 1, has] - log[-1, has])
            at.append(p[has])
            uses.append(use)
    which, use = np.concatenate(at), np.concatenate(uses)
    return np.stack([np.bincount(which, use[:, k], len(known)) for k in range(langs)], axis=1)


class Model:
    """Languages, and the probability of each piece by language."""

    def __init__(self, rank_path: str, langs: list[str], prob: np.ndarray):
        self.rank_path, self.langs, self.prob = rank_path, langs, prob
        self.cache: dict[str, np.ndarray] = {}

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        counts = [Counter(letter_words(t)) for t in texts]
        if not self.langs:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        new = list({w for c in counts for w in c if w not in cache})
        cache.update(zip(new, word_scores(new, pieces(self.rank_path), self.prob), strict=True))
        langs, scores = [], []
        for c in counts:
            if not c:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            ws = sorted(c)
            total = np.array([c[w] for w in ws], dtype=float) @ np.array([cache[w] for w in ws])
            post = np.exp(total - total.max())
            best = int(post.argmax())
            langs.append(self.langs[best])
            scores.append(float(post[best] / post.sum()))
        return langs, scores


def fit(docs: DataFrame, rank_path: str, key: str = "doc_id", text: str = "text", lang: str = "lang", held_out: tuple[int, int] = HELD_OUT, sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> Model:
    """Piece probabilities of every language of the documents outside the held-out fold."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folds, held = held_out
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    d = d.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("key", folds) != held))
    per_lang = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(per_lang)
    if not langs:
        return Model(rank_path, [], np.zeros((0, 0)))
    # the share of a language's documents to take, as a bound on a uniform hash
    share = {x: min(1.0, sample_docs / per_lang[x]) for x in langs}
    where = F.create_map(*[F.lit(v) for x in langs for v in (x, share[x])])
    picked = d.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30) < where[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, Counter[str]] = {}
            for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(x, Counter()).update(letter_words(t))
            rows = [(x, w, n) for x, c in by.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in ((0, pa.string()), (1, pa.string()), (2, pa.int64()))], names=["lang", "word", "n"])

    counted = picked.select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # one row a word, with its count in each language
    words = staged(counted.groupBy("word").agg(*[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs)]), "words")
    number = pieces(rank_path)
    prob = np.vstack([np.full((len(number), len(langs)), 1 / len(number)), np.zeros((1, len(langs)))])
    for _ in range(rounds):
        was = prob

        def uses(batches: Iterator[pa.RecordBatch], was: np.ndarray = was) -> Iterator[pa.RecordBatch]:
            known = pieces(rank_path)
            total = np.zeros((len(known), was.shape[1]))
            raw: list[bytes] = []
            weights: list[np.ndarray] = []

            def add() -> None:
                weight = np.concatenate(weights)
                for part in steps(raw):
                    total[:] += expected([raw[n] for n in part], weight[part], known, was)
                raw.clear()
                weights.clear()

            for b in batches:
                raw += [(" " + w).encode() for w in b.column(0).to_pylist()]
                weights.append(np.array([b.column(1 + k).to_pylist() for k in range(was.shape[1])], dtype=float).T)
                if len(raw) >= HELD_WORDS:
                    add()
            if raw:
                add()
            used = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *[pa.array(total[used, k]) for k in range(was.shape[1])]], names=["piece", *[f"u{k}" for k in range(was.shape[1])]])

        schema = "piece long, " + ", ".join(f"u{k} double" for k in range(len(langs)))
        got = words.mapInArrow(uses, schema).groupBy("piece").agg(*[F.sum(f"u{k}").alias(f"u{k}") for k in range(len(langs))]).collect()
        new = np.full((len(number), len(langs)), 0.01)
        for r in got:
            new[r["piece"]] += r[1:]
        prob = np.vstack([new / new.sum(axis=0), np.zeros((1, len(langs)))])
    return Model(rank_path, langs, prob)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    at, names = docs.columns.index(text), [fresh(docs, "lang_pred"), fresh(docs, "score")]
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    # pieces x languages: a bounded table, sent once to each executor
    sent = spark.sparkContext.broadcast((model.rank_path, model.langs, model.prob))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for b in batches:
            langs, scores = m.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


__all__ = ["Model", "expected", "fit", "pieces", "predict", "word_scores"]
