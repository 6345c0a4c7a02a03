"""Whitening of embeddings: components of the covariance by FEAST, exact sums by Spark.

Entries become whole numbers x = floor(scale * c) + offset, c as double.  The fit list is each distinct
x vector once (copies are combined before the shuffle), and everything is over it, with divisor n:

1. n and the sums S of each dimension, whole numbers;
2. with z = x - round(S / n), so centred before multiplying, the sums of products of z: tasks add up
   whole numbers, so the covariance V is exact but for its last rounding, whatever the mean;
3. FEAST (``feast``) on the driver, which holds dimensions squared numbers, never rows;
4. a pass over the fit list for the covariance of the whitened values, of which the largest distance
   from the identity is told;
5. every row of the table, projected.

Rows whose vector is null or holds a null or non-finite entry are left out.  Null and repeated keys are
rows like others.  Vectors of another length make up a list of their own, with its own n and
components.  Components with an eigenvalue of at most ``RANK`` times the largest are rounding noise
(the vectors do not reach that direction) and have no rows; so vectors that are all equal, a single
vector and vectors without entries give none.  An empty table gives no rows.  Entries
beyond 2**61 / scale are held there.  ``deviation`` is null where it passes a long.  Columns
other than the key and the vector play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourgrid.llm import feast
from hourgrid.llm.common import staged

COMPONENTS = 16
#: Eigenvalues at most so large, as a share of the largest, are none.
RANK = 1e-11
LONG = 2**63 - 1
WHOLE = pa.decimal128(38, 0)


@dataclass
class Model:
    """What projects the vectors of one length."""

    n: int
    shift: np.ndarray  # round(S / n)
    rest: list[int]  # S - n * shift
    values: np.ndarray  # eigenvalues, falling
    project: np.ndarray  # unit eigenvectors over the roots of their values
    explained: np.ndarray
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.shift).astype(np.float64) - np.array([r / self.n for r in self.rest])) @ self.project

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)**2 of each row, exact."""
        z = x - self.shift
        most = self.n * (int(np.abs(z).max(initial=0)) + 1)
        if z.shape[1] * most * most <= LONG:
            return ((self.n * z - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        sums = [sum((self.n * a - r) ** 2 for a, r in zip(row, self.rest, strict=True)) for row in z.tolist()]
        return [s if s <= LONG else None for s in sums]


def whole(table: DataFrame, key: str, vector: str, scale: int, offset: int) -> DataFrame:
    """(key, x): the rows that take part, as whole numbers."""
    c = F.transform(F.col(vector), lambda v: v.cast("double"))
    good = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    end = float(1 << 61)
    x = F.transform(c, lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(end)), F.lit(-end))) + F.lit(offset))
    return table.where(F.col(vector).isNotNull() & good).select(F.col(key).alias("key"), x.alias("x"))


def matrices(x: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of the vectors of each length."""
    x = pa.array(x) if not isinstance(x, pa.Array) else x
    sizes = np.diff(x.offsets.to_numpy())
    flat, first = x.values.to_numpy(), x.offsets.to_numpy()[:-1]
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, at, flat[first[at][:, None] + np.arange(d)]


def products(z: np.ndarray) -> np.ndarray:
    """Exact sums of products, as whole numbers."""
    most = int(np.abs(z).max(initial=0))
    if most * most * max(len(z), 1) < 2**53:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    z = z.astype(object)
    return z.T @ z


def column_sums(m: np.ndarray) -> np.ndarray:
    """Exact sums of the columns, as whole numbers."""
    most = int(np.abs(m).max(initial=0))
    return (m if most * len(m) <= LONG else m.astype(object)).sum(axis=0).astype(object)


def _summed(fit: DataFrame, of, kind: str) -> dict[int, np.ndarray]:
    """Per length, the sum over all tasks of the array ``of(length, matrix)`` gives; one row an entry."""
    exact = kind != "double"
    arrow = WHOLE if exact else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, m in matrices(b.column(0)):
                got = of(d, m)
                if got is not None:
                    total[d] = total[d] + got if d in total else got
        for d, t in total.items():
            t = t.reshape(-1)
            t = [Decimal(int(v)) for v in t] if exact else t
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), d)), pa.array(np.arange(len(t))), pa.array(t, arrow)], ["dim", "i", "part"])

    parts = fit.mapInArrow(run, f"dim long, i long, part {kind}")
    sums: dict[int, dict[int, object]] = {}
    # an entry of a matrix a row: bounded by the squares of the lengths
    for d, i, s in parts.groupBy("dim", "i").agg(F.sum("part").alias("s")).collect():
        sums.setdefault(d, {})[i] = int(s) if exact else float(s)
    return {d: np.array([s[i] for i in range(len(s))], object if exact else float) for d, s in sums.items()}


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """Models by length of the vectors ``x`` of ``rows``, over each distinct vector once."""
    distinct = staged(rows.select("x").distinct(), "fit-list")
    sums = _summed(distinct, lambda d, m: np.append(column_sums(m), len(m)), "decimal(38,0)")
    counts = {d: int(s[-1]) for d, s in sums.items() if d}
    shifts = {d: np.array([(2 * int(s) + counts[d]) // (2 * counts[d]) for s in sums[d][:-1]], np.int64) for d in counts}
    grams = _summed(distinct, lambda d, m: products(m - shifts[d]) if d else None, "decimal(38,0)")
    models = {}
    for d, n in counts.items():
        rest = [int(s) - n * int(c) for s, c in zip(sums[d][:-1], shifts[d], strict=True)]
        g = grams[d].reshape(d, d)
        v = np.array([[(n * int(g[i, j]) - rest[i] * rest[j]) / (n * n) for j in range(d)] for i in range(d)])
        e, u = feast.largest(v, components)
        e, u = (e[e > RANK * e[0]], u[:, e > RANK * e[0]]) if len(e) and e[0] > 0 else (e[:0], u[:, :0])
        models[d] = Model(n, shifts[d], rest, e, u / np.sqrt(e), e / np.trace(v) if len(e) else e)
    if any(len(m.values) for m in models.values()):
        white = _summed(distinct, lambda d, m: _moments(models[d].whitened(m)) if d and len(models[d].values) else None, "double")
        for d, s in white.items():
            k, n = len(models[d].values), models[d].n
            mean, second = s[:k] / n, s[k:].reshape(k, k) / n
            models[d].identity_error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())
    return models


def _moments(w: np.ndarray) -> np.ndarray:
    return np.concatenate([w.sum(axis=0), (w.T @ w).reshape(-1)])


def whiten(table: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every row that takes
    part and every component, numbered from 1 by falling eigenvalue."""
    rows = staged(whole(table, key, vector, scale, offset), "whole")
    models = fit(rows, components)
    numbers = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *[T.StructField(c, t) for c, t in numbers]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in matrices(b.column(1)):
                k = len(models[d].values) if d in models else 0
                for a in range(0, len(at) if k else 0, 4096):
                    m, some = models[d], x[a : a + 4096]
                    rows_of = pa.array(np.repeat(at[a : a + 4096], k))
                    deviation = pa.array(m.deviations(some), pa.int64()).take(pa.array(np.repeat(np.arange(len(some)), k)))
                    full = len(some) * k
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0).take(rows_of), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(some))), pa.array(np.full(full, m.n)), deviation,
                            pa.array(m.whitened(some).reshape(-1)), pa.array(np.tile(m.explained, len(some))), pa.array(np.full(full, m.identity_error)),
                        ],
                        names=schema.names,
                    )

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


__all__ = ["Model", "fit", "whiten"]
