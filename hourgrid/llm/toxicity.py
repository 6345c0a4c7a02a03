"""Toxicity: a counterfactual-regularised linear classifier over words and word beginnings.

Features say that a word, or a beginning of words, occurs, occurs twice or more, or makes up
a hundredth of the text; so a toxic word weighs the same in a long text as in a short one,
and inflected forms share what is learnt of their stem.  The vocabulary holds the features
whose use differs most between the classes (z of the log odds, counted by Spark over the
sample).  For every labelled sentence that names a group, each named term is swapped with
every other term of its kind, and the squared change of the score is added to the loss: what
the model learns cannot rest on which group is named.

Learning uses at most ``SAMPLE_ROWS`` labelled documents outside the held-out fold, those
whose keys hash lowest.  Null and empty texts hold no word and get the score of the bias;
without labels of both classes every score is the share of toxic labels (0 without labels).
Labels with a null key or label are left out; of several labels of a key the largest counts.
Repeated rows are scored each; null keys are fine.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourgrid.llm.common import bounded_batches, fresh, staged
from hourgrid.llm.words import fold, letter_words

SAMPLE_ROWS = 20_000
VOCABULARY = 4_096
#: Least z of the log odds of a word of the vocabulary.
LEAST_Z = 2.5
HELD_OUT = (5, 0)

# Terms that name a group, by kind and language; swaps stay within a kind of a language.
IDENTITY = {
    "gender": "man men woman women boy boys girl girls male female transgender nonbinary".split(),
    "religion": "christian christians muslim muslims jew jews jewish hindu buddhist sikh atheist catholic".split(),
    "origin": "black white asian african european american mexican latino arab indian chinese immigrant immigrants refugee refugees".split(),
    "orientation": "gay lesbian straight bisexual queer homosexual heterosexual".split(),
    "ability": "deaf blind disabled autistic elderly young".split(),
    "de gender": "mann männer frau frauen junge mädchen männlich weiblich transgender".split(),
    "de religion": "christ christen muslim muslime jude juden jüdisch hindu buddhist atheist katholik".split(),
    "de origin": "schwarze weiße asiaten afrikaner europäer araber inder türken migranten flüchtlinge ausländer".split(),
    "de orientation": "schwul lesbisch hetero bisexuell queer homosexuell heterosexuell".split(),
    "fr gender": "homme hommes femme femmes garçon fille garçons filles masculin féminin transgenre".split(),
    "fr religion": "chrétien chrétiens musulman musulmans juif juifs hindou bouddhiste athée catholique".split(),
    "fr origin": "noirs blancs asiatiques africains européens arabes indiens migrants réfugiés étrangers".split(),
    "fr orientation": "homosexuel hétérosexuel bisexuel lesbienne gai queer".split(),
    "es gender": "hombre hombres mujer mujeres niño niña niños niñas masculino femenino transgénero".split(),
    "es religion": "cristiano cristianos musulmán musulmanes judío judíos hindú budista ateo católico".split(),
    "es origin": "negros blancos asiáticos africanos europeos árabes indios migrantes refugiados extranjeros".split(),
    "es orientation": "homosexual heterosexual bisexual lesbiana gay queer".split(),
}


#: Lengths of the beginnings of longer words that are features.
BEGINNINGS = (5, 6, 7)


def counted(text: str | None) -> Counter[str]:
    return Counter(letter_words(text))


def features(words: Counter[str], only: frozenset[str] | set[str] | None = None) -> set[str]:
    """``w`` and ``^beginning`` for what occurs, with `` 2`` for twice or more and `` %`` for a
    hundredth of the words; of ``only`` where it is given."""
    seen: Counter[str] = Counter()
    for w, n in words.items():
        if only is None or w in only:
            seen[w] += n
        for k in BEGINNINGS:
            if len(w) >= k and (only is None or "^" + w[:k] in only):
                seen["^" + w[:k]] += n
    total = sum(words.values())
    out = set(seen)
    for f, n in seen.items():
        if n >= 2:
            out.add(f + " 2")
            if 100 * n >= total:
                out.add(f + " %")
    return out if only is None else out & only


def kinds_of(terms: Mapping[str, Sequence[str]]) -> dict[str, set[str]]:
    """For each term, the others that it can be swapped with (a term of several languages has those of each)."""
    out: dict[str, set[str]] = {}
    for ws in terms.values():
        for w in ws:
            out.setdefault(w, set()).update(x for x in ws if x != w)
    return out


def swaps(words: Counter[str], only: frozenset[str] | set[str], others: Mapping[str, set[str]] | None = None) -> list[list[str]]:
    """For each swap of a named term with another of its kind, the features that go (``-f``)
    and that come (``+f``)."""
    others = kinds_of(IDENTITY) if others is None else others
    named = [w for w in words if w in others]
    if not named:
        return []
    was, out = features(words, only), []
    for t in named:
        for u in sorted(others[t]):
            if u != t:
                swapped = words.copy()
                swapped[u] += swapped.pop(t)
                now = features(swapped, only)
                if now != was:
                    out.append(sorted(["-" + f for f in was - now] + ["+" + f for f in now - was]))
    return out


@dataclass
class Toxicity:
    """Weights by feature, and the bias."""

    weight: dict[str, float]
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        # a beginning or word must be looked for where only its repeated form has a weight
        only = self.weight.keys() | {f.partition(" ")[0] for f in self.weight}
        got = [features(counted(t), only) for t in texts]
        raw = [self.bias + sum(self.weight[f] for f in sorted(g) if f in self.weight) for g in got]
        return 1 / (1 + np.exp(-np.clip(np.array(raw, dtype=float), -30, 30)))


def fit_weights(rows: list[list[int]], moves: list[list[tuple[int, int]]], y: np.ndarray, size: int, swap_weight: float = 1.0, ridge: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic loss, a ridge, and the mean squared score change under swaps (Adam, all rows).
    Toxic rows weigh the square root of the classes' ratio more, since they are few.

    ``moves`` has the features that a swap adds (+1) and takes away (-1)."""
    n = len(rows)
    share = np.where(y > 0, max(1.0, np.sqrt((1 - y.mean()) / y.mean())), 1.0) / n
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.fromiter((c for r in rows for c in r), np.int64, len(at))
    own = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
    moved = np.array([c for m in moves for c, _ in m], dtype=np.int64)
    sign = np.array([s for m in moves for _, s in m], dtype=float)
    w = np.zeros(size + 1)
    w[size] = np.log(y.mean() / (1 - y.mean()))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        gap = share * (1 / (1 + np.exp(-(w[size] + np.bincount(at, w[col], n)))) - y)
        g = np.bincount(col, gap[at], size + 1) + ridge * w / n
        g[size] = gap.sum()
        if len(moves):
            change = np.bincount(own, sign * w[moved], len(moves))
            g[:size] += np.bincount(moved, 2 * swap_weight / len(moves) * sign * change[own], size)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        rate = 0.1 * min(1.0, 3 * (1 - step / (rounds + 1)))
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w[:size], float(w[size])


def _feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, n, pos): the texts with a feature, and the toxic ones of them; a batch is summed up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every, toxic = Counter(), Counter()
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = features(counted(t))
                every.update(f)
                if y:
                    toxic.update(f)
            names = list(every)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([every[f] for f in names], pa.int64()), pa.array([toxic[f] for f in names], pa.int64())], names=["feature", "n", "pos"])

    part = rows.select("y", "text").mapInArrow(run, "feature string, n long, pos long")
    return part.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def _coded(rows: DataFrame, vocabulary: list[str], others: Mapping[str, set[str]]) -> DataFrame:
    """(y, has, moves): the features of the vocabulary, and the moves of each swap."""
    only = set(vocabulary)
    wide = only | {f.partition(" ")[0] for f in only}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [counted(t) for t in b.column(1).to_pylist()]
            has = [sorted(features(w, wide) & only) for w in words]
            moves = [[m for m in ([x for x in s if x[1:] in only] for s in swaps(w, wide, others)) if m] for w in words]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(has, pa.list_(pa.string())), pa.array(moves, pa.list_(pa.list_(pa.string())))], names=["y", "has", "moves"])

    return rows.select("y", "text").mapInArrow(run, "y int, has array<string>, moves array<array<string>>")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", held_out: tuple[int, int] = HELD_OUT, sample_rows: int = SAMPLE_ROWS, vocabulary: int = VOCABULARY, terms: Mapping[str, Sequence[str]] = IDENTITY, swap_weight: float = 1.0) -> Toxicity:
    """A model from the labelled documents outside the held-out fold.  ``terms`` name groups, by kind;
    ``swap_weight`` is the part of the penalty on score changes under swaps (0: a plain classifier)."""
    others = kinds_of(terms)
    bounded_batches(docs.sparkSession)
    folds, held = held_out
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (fold(key, folds) != held))
    known = known.groupBy(key).agg(F.max(label).cast("int").alias("y"))
    picked = known.orderBy(F.xxhash64(key), key).limit(sample_rows).select(F.col(key).alias("key"), "y")
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = staged(d.join(F.broadcast(picked), "key").groupBy("key", "y").agg(F.min("text").alias("text")).select("y", "text"), "toxicity-sample")
    n, positive = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or positive in (0, n):
        share = (positive or 0) / max(n, 1)
        return Toxicity({}, float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))))
    p, q = F.col("pos") + 0.5, F.col("n") - F.col("pos") + 0.5
    odds = F.log(p / (positive - F.col("pos") + 0.5)) - F.log(q / (n - positive - F.col("n") + F.col("pos") + 0.5))
    z = F.abs(odds / F.sqrt(1 / p + 1 / q))
    best = _feature_counts(rows).where((F.col("n") >= 2) & (z >= LEAST_Z)).orderBy(F.desc(z), "feature").limit(vocabulary).select("feature").collect()
    names = sorted(r["feature"] for r in best)
    number = {f: i for i, f in enumerate(names)}
    got = sorted((r["y"], r["has"], r["moves"]) for r in _coded(rows, names, others).collect())
    moves = [[(number[x[1:]], 1 if x[0] == "+" else -1) for x in m] for _, _, ms in got for m in ms]
    weight, bias = fit_weights([[number[f] for f in has] for _, has, _ in got], moves, np.array([y for y, _, _ in got], dtype=float), len(names), swap_weight)
    return Toxicity(dict(zip(names, weight.tolist(), strict=True)), bias)


def score(docs: DataFrame, model: Toxicity, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1)."""
    bounded_batches(docs.sparkSession)
    name, at = fresh(docs, "score"), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array(model.scores(b.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


__all__ = ["IDENTITY", "Toxicity", "features", "fit", "fit_weights", "score", "swaps"]
