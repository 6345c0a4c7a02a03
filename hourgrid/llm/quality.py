"""Quality rules: base rules over document statistics, and gradient-boosted trees that
judge what passes them.

The trees are fitted here, with numpy, on at most ``SAMPLE_ROWS`` labelled documents
(the ones whose key hashes lowest).  Chosen features are monotonic: more symbols, repeats
or capitals never raise the score.  All trees are flattened into node arrays, and a batch
of documents walks one level of a tree in one numpy step.

A null text has no words and fails the base rules, like a text of fewer than ten words.
Without labels of both classes there is no verdict, and what passes the base rules is kept.
Repeated rows are judged each; null keys are fine; labels with a null key or label, and
further labels of a key, are left out of the fit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourgrid.llm.common import bounded_batches, fresh

#: Labelled documents used for the fit; their keys are broadcast and their statistics collected.
SAMPLE_ROWS = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Features and how the score may move with them (0: freely).
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "same_next_share": -1,
    "distinct_share": 0,
    "capital_share": -1,
    "digit_share": 0,
    "mark_share": 0,
    "shout_per_word": -1,
    "short_line_share": 0,
}

# Fixed values of the contract: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\r\x0b\x0c"
CAPITALS = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MARKS = b"!\"'(),-./:;?"


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in a window found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    spans = list(zip(*[words[i : i + n] for i in range(window)], strict=True))
    if len(set(spans)) == n:
        return 0
    times = Counter(spans)
    starts = np.flatnonzero(np.fromiter((times[s] > 1 for s in spans), bool, n))
    # windows have one length: each adds what it has past the one before
    return int(np.minimum(np.diff(starts), window).sum()) + window


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of the contract and the features of the trees."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = len(text) - sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    dup = len(lines) - len(set(lines))
    rep = repeated_words(words)
    w, c, m = max(n, 1), max(chars, 1), max(len(lines), 1)
    left_out = lambda chars: len(raw) - len(raw.translate(None, chars))
    features = [
        float(np.log1p(n)),
        chars / w,
        symbols / w,
        dup / m,
        rep / w,
        sum(map(eq, words, words[1:])) / w,
        len(set(words)) / w,
        left_out(CAPITALS) / c,
        left_out(DIGITS) / c,
        left_out(MARKS) / c,
        raw.count(b"!") / w,
        sum(len(x) < 40 for x in lines) / m,
    ]
    return [n, chars, symbols, dup, rep], features


def base_fails(counts: np.ndarray) -> np.ndarray:
    """Fewer than ten words, or over a fifth of them in repeated windows."""
    return (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])


@dataclass
class Trees:
    """Boosted trees as node arrays; a leaf points to itself."""

    roots: list[int] = field(default_factory=list)
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    depth: int = 0
    prior: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.prior), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 1.0, least: float = 1.0) -> Trees | None:
    """Logistic boosting on histograms; None without both classes."""
    if len(y) == 0 or y.min() == y.max():
        return None
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    t = Trees(depth=depth, prior=float(np.log(y.mean() / (1 - y.mean()))))
    raw = np.full(len(y), t.prior)

    def leaf(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float) -> float:
        return float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))

    def grow(rows: np.ndarray, level: int, g: np.ndarray, h: np.ndarray, low: float, high: float) -> int:
        me = len(nodes)
        nodes.append([0, np.inf, me, me, rate * leaf(rows, g, h, low, high)])
        if level == depth:
            return me
        best = (1e-6, -1, -1, 0.0, 0.0)
        gt, ht = g[rows].sum(), h[rows].sum()
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            gl = np.cumsum(np.bincount(code[rows, f], g[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(code[rows, f], h[rows], len(c) + 1))[:-1]
            gr, hr = gt - gl, ht - hl
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gt**2 / (ht + ridge)
            ok = (hl >= least) & (hr >= least) & (monotone[f] * (vr - vl) >= 0)
            k = int(np.argmax(np.where(ok, gain, -1)))
            if ok[k] and gain[k] > best[0]:
                best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
        _, f, k, vl, vr = best
        if f < 0:
            return me
        goes = code[rows, f] <= k
        mid = (vl + vr) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[monotone[f]]
        a = grow(rows[goes], level + 1, g, h, *bounds[0])
        b = grow(rows[~goes], level + 1, g, h, *bounds[1])
        nodes[me][:4] = [f, float(cuts[f][k]), a, b]
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        start = len(nodes)
        t.roots.append(grow(np.arange(len(y)), 0, p - y, p * (1 - p), -np.inf, np.inf))
        one = np.array(nodes[start:])
        tree = Trees([0], one[:, 0].astype(int), one[:, 1], one[:, 2].astype(int) - start, one[:, 3].astype(int) - start, one[:, 4], depth)
        raw += tree.raw(x)
    a = np.array(nodes)
    t.feature, t.threshold, t.left, t.right, t.value = a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]
    return t


def _with_stats(docs: DataFrame, text: str, extra: list[T.StructField], make) -> DataFrame:
    """``docs`` and what ``make(counts, features)`` gives for each batch."""
    bounded_batches(docs.sparkSession)
    at, names = docs.columns.index(text), [f.name for f in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [statistics(t) for t in b.column(at).to_pylist()]
            counts = np.array([g[0] for g in got], np.int64).reshape(-1, len(COUNTS))
            features = np.array([g[1] for g in got]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, make(counts, features))], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra]))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees | None:
    """Trees from the statistics of at most ``sample_rows`` labelled documents."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("label"))
    picked = known.orderBy(F.xxhash64(key), key).limit(sample_rows).select(F.col(key).alias("key"), "label")
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(picked), "key").groupBy("key", "label").agg(F.min("text").alias("text"))
    extra = [*[T.StructField(c, T.LongType()) for c in COUNTS], *[T.StructField(c, T.DoubleType()) for c in FEATURES]]
    got = _with_stats(d.select("label", "text"), "text", extra, lambda c, x: [*c.T, *x.T]).drop("text")
    rows = np.array([list(r) for r in got.collect()], dtype=float).reshape(-1, 1 + len(extra))
    rows = rows[~base_fails(rows[:, 1 : 1 + len(COUNTS)])]
    rows = rows[np.lexsort(rows.T)]  # the same trees whatever the order of the rows
    return fit_trees(rows[:, 1 + len(COUNTS) :], rows[:, 0], list(FEATURES.values()))


def judge(docs: DataFrame, trees: Trees | None, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``quality_score`` (null without trees) and ``kept``."""
    names = [*COUNTS, "base_failed", "quality_score", "kept"]
    kinds = [*[T.LongType()] * len(COUNTS), T.BooleanType(), T.DoubleType(), T.BooleanType()]
    extra = [T.StructField(fresh(docs, n), t) for n, t in zip(names, kinds, strict=True)]

    def make(counts: np.ndarray, x: np.ndarray) -> list:
        failed = base_fails(counts)
        score = np.full(len(x), np.nan) if trees is None else trees.score(x)
        kept = ~failed if trees is None else ~failed & (score >= least)
        return [*counts.T, failed, score, kept]

    return _with_stats(docs, text, extra, make)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are kept, with their own columns."""
    judged = judge(docs, fit(docs, labels, key, text), text)
    return judged.where(F.col(judged.columns[-1])).select(docs.columns)


__all__ = ["Trees", "fit", "fit_trees", "judge", "keep_good", "repeated_words", "statistics"]
