"""Gradient-boosted regression trees for all series and parameter sets at once.

1. :func:`bin_edges` - features are binned once: a fine histogram of equal cells (one partial
   aggregate) is merged to ``bins`` bins of about equal counts; the smallest value of a bin is its edge.
2. :func:`pack` - rows become blocks of at most about ``block_rows`` rows, as byte matrices of bins.
3. Models - a set of parameters, a fold, a series - grow together.  A series in one block needs
   no exchange: a task holds the whole histogram, so it grows all trees of a model, and the models are
   dealt to the tasks.  For larger series every level is one job: blocks add up the histograms of all
   their models, one aggregate keyed by (model, node, feature, bin) sums them, and the best cut of each
   (model, node) comes back.  Jobs grow with trees x depth, not with the number of models.
4. Trees are a node table (:data:`NODES`): :func:`predict` walks it, importances are one ``groupBy``.

Squared error, second-order gain with an L2 term on leaves (as the usual boosting library), trees
level by level, no sampling.  Residuals are whole numbers in units of a power of two, so sums are
exact: trees do not depend on the order of rows, on blocks, or on which of the two ways was taken.
A row goes left if its value is smaller than the threshold or missing.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourgrid.session import cut_lineage

#: Cells of the fine histogram, bins of a feature.
CELLS, BINS = 1024, 64
#: L2 term on leaf values; a cut must gain more than this.
LAMBDA, LEAST_GAIN = 1.0, 1e-6
#: Rows of a block.  Sums of a block are exact as doubles: 2**17 rows of at most 2**(BITS + 2).
BLOCK_ROWS = 1 << 17
#: Bits of a residual before the largest target of the series.
BITS = 31
#: A fold that no row is in: such models train on all rows.
ALL = 1 << 30

NODES = "tree int, node int, feature string, threshold double, gain double, cover long, value double"


def bin_edges(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], cells: int = CELLS, bins: int = BINS) -> DataFrame:
    """One row a series: ``n`` rows, ``reach`` = largest size of the target, ``edges`` = for each feature
    the ascending smallest values of its bins.  Missing values take no part; a feature
    without values has no edges."""
    keys = list(keys)
    x = F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in features])
    d = df.where(F.col(target).isNotNull()).select(*keys, F.col(target).cast("double").alias("_y"), x.alias("_x"))
    of = lambda fn: F.array(*[fn(F.get("_x", F.lit(i))) for i in range(len(features))])
    spans = d.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.abs("_y")).alias("reach"), of(F.min).alias("lo"), of(F.max).alias("hi"))
    each = d.join(spans.select(*keys, "lo", "hi"), keys).select(*keys, F.posexplode(F.arrays_zip("_x", "lo", "hi")).alias("f", "v"))
    each = each.where(F.col("v._x").isNotNull()).select(*keys, "f", F.col("v._x").alias("x"), "v.lo", "v.hi")
    place = F.try_divide(F.col("x") - F.col("lo"), F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))) * F.lit(cells)
    cell = F.coalesce(F.least(F.floor(place), F.lit(cells - 1)), F.lit(0))
    fine = each.groupBy(*keys, "f", cell.alias("cell")).agg(F.count("*").alias("c"), F.min("x").alias("x"))
    feature = Window.partitionBy(*keys, "f")
    before = F.sum("c").over(feature.orderBy("cell")) - F.col("c")
    fine = fine.withColumn("b", F.floor(before * F.lit(bins) / F.sum("c").over(feature)))
    edges = fine.groupBy(*keys, "f", "b").agg(F.min("x").alias("x")).groupBy(*keys, "f").agg(F.array_sort(F.collect_list("x")).alias("e"))
    edges = edges.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("f", "e"))).alias("m"))
    listed = F.array(*[F.coalesce(F.try_element_at("m", F.lit(i)), F.array().cast("array<double>")) for i in range(len(features))])
    return spans.select(*keys, "n", "reach").join(edges.select(*keys, listed.alias("edges")), keys)


def _matrix(lists: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null becomes NaN
    return values.reshape(-1, width)


def binned(x: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    """Bins of the values: the number of edges up to them, less one, 0 at least; missing ones are in bin 0."""
    out = np.zeros(x.shape, np.uint8)
    for f, e in enumerate(edges):
        if len(e):
            v = np.where(np.isnan(x[:, f]), -np.inf, x[:, f])
            out[:, f] = np.maximum(np.searchsorted(np.asarray(e), v, side="right") - 1, 0)
    return out


def pack(df: DataFrame, edges: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], fold: str, order: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks: (keys, chunk, chunks, reach, edges, bins, y, fold); rows are dealt to the chunks of their series by a hash of ``order``."""
    keys = list(keys)
    chunks = F.ceil(F.col("n") / F.lit(block_rows)).cast("int")
    told = edges.withColumn("chunks", chunks)
    d = df.where(F.col(target).isNotNull() & F.col(fold).isNotNull())
    x = F.array(*[F.col(c).cast("double") for c in features])
    rows = d.select(*keys, F.col(target).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"), x.alias("x"), F.xxhash64(*order).alias("h"))
    rows = rows.join(told.select(*keys, "chunks"), keys)
    rows = rows.select(*keys, F.pmod("h", "chunks").cast("int").alias("chunk"), "y", "fold", "x")
    each = told.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    each = each.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("chunk").alias("_chunk"), "chunks", "reach", "edges")
    schema = T.StructType([df.schema[k] for k in keys] + T._parse_datatype_string("chunk int, chunks int, reach double, edges array<array<double>>, bins binary, y binary, fold binary").fields)
    names, width = schema.names, len(features)

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({n: pa.array([], f.type) for n, f in zip(names, arrow, strict=True)})
        e = b.column("edges")[0].as_py()
        bins = binned(_matrix(a.column("x"), width), e)
        y, folds = a.column("y").to_numpy(), a.column("fold").to_numpy().astype("<i4")
        row = [k.as_py() for k in key] + [b.column("chunks")[0].as_py(), b.column("reach")[0].as_py(), e, bins.tobytes(), y.astype("<f8").tobytes(), folds.tobytes()]
        return pa.table({n: pa.array([v], f.type) for n, v, f in zip(names, row, arrow, strict=True)})

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = list(to_arrow_schema(schema))
    return rows.groupBy(*keys, "chunk").cogroup(each.groupBy(*[f"_k_{k}" for k in keys], "_chunk")).applyInArrow(run, schema)


# ---------------------------------------------------------------- growing
@dataclass
class Tree:
    """Nodes in heap order (children of i: 2i + 1, 2i + 2); ``feature`` -1: no cut."""

    depth: int
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)  # bins up to this one go left
    gain: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)
    g: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        size = 2 ** (self.depth + 1) - 1
        self.feature, self.cut = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        self.gain, self.n, self.g = np.zeros(size), np.zeros(size, np.int64), np.zeros(size, np.int64)

    def set(self, node: int, best: tuple) -> None:
        """Cut ``node``: (feature, bin, gain, rows and sum on the left, rows and sum in all)."""
        f, b, gain, nl, gl, n, g = best
        self.n[node], self.g[node] = n, g
        if gain > LEAST_GAIN:
            self.feature[node], self.cut[node], self.gain[node] = f, b, gain
            left = 2 * node + 1
            self.n[left], self.g[left], self.n[left + 1], self.g[left + 1] = nl, gl, n - nl, g - gl

    def down(self, bins: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The next node of rows at ``node``; rows at a node without a cut stay."""
        f = self.feature[node]
        right = bins[np.arange(len(node)), np.maximum(f, 0)] > self.cut[node]
        return np.where(f < 0, node, 2 * node + 1 + right)

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        for _ in range(self.depth):
            node = self.down(bins, node)
        return node

    def values(self, scale: float, rate: float) -> np.ndarray:
        return rate * ((self.g / scale) / (self.n + LAMBDA))


def scale_of(reach: float) -> float:
    """Units of whole-number residuals in one of the target: a power of two."""
    return 2.0 ** (BITS - math.frexp(reach or 1.0)[1])


def histogram(bins: np.ndarray, node: np.ndarray, r: np.ndarray, nodes: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sums of residuals) by (node, feature, bin); rows with a negative node are left out."""
    ok = node >= 0
    if not ok.all():
        bins, node, r = bins[ok], node[ok], r[ok]
    features = bins.shape[1]
    at = (bins + ((node * features)[:, None] + np.arange(features)) * width).ravel()
    shape, size = (nodes, features, width), nodes * features * width
    n = np.bincount(at, minlength=size).reshape(shape)
    return n, np.bincount(at, weights=np.repeat(r, features), minlength=size).reshape(shape)


def best_cuts(n: np.ndarray, g: np.ndarray, scale: float) -> list[tuple]:
    """The best cut of each node from its histogram, as :meth:`Tree.set` takes it; of equal ones the
    first by feature and bin."""
    cn, cg = np.cumsum(n, axis=2), np.cumsum(g, axis=2)
    total, sums = cn[:, :1, -1:], cg[:, :1, -1:]
    rest_n, rest_g = total - cn, sums - cg
    score = cg * cg / (cn + LAMBDA) + rest_g * rest_g / (rest_n + LAMBDA) - sums * sums / (total + LAMBDA)
    score = np.where((cn > 0) & (rest_n > 0), score, -np.inf).reshape(len(n), -1)
    at = score.argmax(axis=1)
    out = []
    for i, k in enumerate(at.tolist()):
        f, b = divmod(k, n.shape[2])
        out.append((f, b, 0.5 * float(score[i, k]) / scale / scale, int(cn[i, f, b]), int(cg[i, f, b]), int(total[i, 0, 0]), int(sums[i, 0, 0])))
    return out


def grow(bins: np.ndarray, y: np.ndarray, train: np.ndarray, depth: int, rate: float, scale: float, trees: int) -> Iterator[tuple[Tree, np.ndarray]]:
    """Trees of one model whose rows are all here, each with the prediction of every row after it."""
    width = int(bins.max(initial=0)) + 1
    whole = np.rint(y * scale)
    now = np.full(len(y), float(whole[train].sum()) / scale / max(int(train.sum()), 1))
    mine, target = bins[train], y[train]
    flat = mine.astype(np.int64)
    for _ in range(trees):
        tree = Tree(depth)
        r, node = np.rint((target - now[train]) * scale), np.zeros(len(mine), np.int64)
        open_nodes = np.zeros(1, np.int64)
        for _ in range(depth):
            slot = np.full(len(tree.n), -1, np.int64)
            slot[open_nodes] = np.arange(len(open_nodes))
            n, g = histogram(flat, slot[node], r, len(open_nodes), width)
            for i, best in zip(open_nodes.tolist(), best_cuts(n, g, scale), strict=True):
                tree.set(i, best)
            cut = open_nodes[tree.feature[open_nodes] >= 0]
            if not len(cut):
                break
            node = tree.down(mine, node)
            open_nodes = np.concatenate([2 * cut + 1, 2 * cut + 2])
        now = now + tree.values(scale, rate)[tree.leaf(bins)]
        yield tree, now


def node_rows(tree: Tree, number: int, features: Sequence[str], edges: Sequence[Sequence[float]], scale: float, rate: float) -> list[tuple]:
    """The rows of :data:`NODES` that a tree has."""
    values, out = tree.values(scale, rate), []
    for i in np.flatnonzero(tree.n).tolist():
        f = int(tree.feature[i])
        inner = f >= 0
        out.append((number, i, features[f] if inner else None, edges[f][int(tree.cut[i]) + 1] if inner else None, float(tree.gain[i]) if inner else None, int(tree.n[i]), None if inner else float(values[i])))
    return out


# ---------------------------------------------------------------- series of one block
@dataclass(frozen=True)
class Job:
    """A model to grow: rows with a label below ``fold`` train, those with it validate, after each
    number of trees in ``stops``."""

    depth: int
    rate: float
    fold: int
    stops: tuple[int, ...]



def _arrays(bins: bytes, y: bytes, fold: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    target = np.frombuffer(y, "<f8")
    return np.frombuffer(bins, np.uint8).reshape(len(target), -1), target, np.frombuffer(fold, "<i4")


def _local(work: DataFrame, keys: Sequence[str], schema: str, rows_of) -> DataFrame:
    """Every (block, job) of ``work`` through ``rows_of``, dealt to tasks one by one."""
    keys = list(keys)
    n = min(max(work.count(), 1), 4096)
    out = T.StructType([work.schema[k] for k in keys] + T._parse_datatype_string(schema).fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = list(to_arrow_schema(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                rows = rows_of(row)
                cols = [[row[k]] * len(rows) for k in keys] + [list(c) for c in zip(*rows, strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], out.names)

    return work.repartition(n).mapInArrow(run, out)


ERRORS = "depth int, rate double, fold int, trees int, err long, n long, scale double"
TREES = "base double, " + NODES


def _errors(row: dict) -> list[tuple]:
    """Whole-number absolute errors of the validation rows after each stop."""
    bins, y, fold = _arrays(row["bins"], row["y"], row["fold"])
    scale, train, valid = scale_of(row["reach"]), fold < row["k"], fold == row["k"]
    out = []
    if train.any() and valid.any():
        for i, (_, now) in enumerate(grow(bins, y, train, row["depth"], row["rate"], scale, max(row["stops"])), 1):
            if i in row["stops"]:
                out.append((row["depth"], row["rate"], row["k"], i, int(np.rint(np.abs(y - now)[valid] * scale).sum()), int(valid.sum()), scale))
    return out


# ---------------------------------------------------------------- series of many blocks
class _Large:
    """Models of series that lie in several blocks, grown level by level with one job a level."""

    def __init__(self, blocks: DataFrame, keys: Sequence[str], jobs: Mapping[tuple, Sequence[Job]], scales: Mapping[tuple, float]):
        self.keys, self.jobs, self.scales = list(keys), {k: list(v) for k, v in jobs.items()}, dict(scales)
        self.blocks = blocks.select(*self.keys, "bins", "y", "fold")
        self.types = [blocks.schema[k] for k in self.keys]
        self.state: DataFrame | None = None
        self.trees: dict[tuple, Tree] = {}
        self.base: dict[tuple, float] = {}

    def _map(self, df: DataFrame, of, schema: str) -> DataFrame:
        keys, out = self.keys, T.StructType(self.types + T._parse_datatype_string(schema).fields)
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = list(to_arrow_schema(out))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    key = tuple(row[k] for k in keys)
                    cols = of(key, row)
                    size = len(cols[0])
                    arrays = [pa.array([k] * size, f.type) for k, f in zip(key, arrow, strict=False)]
                    yield pa.RecordBatch.from_arrays(arrays + [pa.array(c, f.type) for c, f in zip(cols, arrow[len(keys) :], strict=True)], out.names)

        return df.mapInArrow(run, out)

    def start(self) -> None:
        """Base predictions: exact means of the training rows."""
        jobs, scales = self.jobs, self.scales

        def sums(key: tuple, row: dict) -> list:
            _, y, fold = _arrays(row["bins"], row["y"], row["fold"])
            whole = np.rint(y * scales[key])
            at = [fold < j.fold for j in jobs[key]]
            return [list(range(len(at))), [int(a.sum()) for a in at], [int(whole[a].sum()) for a in at]]

        got = self._map(self.blocks, sums, "model int, n long, s long").groupBy(*self.keys, "model").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        for r in got.collect():
            key = tuple(r[k] for k in self.keys)
            self.base[(*key, r["model"])] = float(r["s"]) / scales[key] / max(r["n"], 1)
        base = self.base

        def first(key: tuple, row: dict) -> list:
            n = len(row["fold"]) // 4
            now = np.repeat([base[(*key, m)] for m in range(len(jobs[key]))], n)
            return [[row[c]] for c in ("bins", "y", "fold")] + [[now.astype("<f8").tobytes()]]

        self.state = cut_lineage(self._map(self.blocks, first, "bins binary, y binary, fold binary, now binary"), "boosted")

    def tree(self) -> dict[tuple, Tree]:
        """Grow the next tree of every model, a job a level, then move all predictions on."""
        keys, jobs, scales = self.keys, self.jobs, self.scales
        trees = {(*k, m): Tree(j.depth) for k, js in jobs.items() for m, j in enumerate(js)}
        nodes: dict[tuple, list[int]] = {k: [0] for k in trees}
        for level in range(max(t.depth for t in trees.values())):
            nodes = {k: v for k, v in nodes.items() if v and trees[k].depth > level}
            if not nodes:
                break

            def sums(key: tuple, row: dict, nodes=nodes, level=level) -> list:
                bins, y, fold = _arrays(row["bins"], row["y"], row["fold"])
                now, parts = np.frombuffer(row["now"], "<f8").reshape(-1, len(y)), []
                width, wide = int(bins.max(initial=0)) + 1, bins.astype(np.int64)
                for m, j in enumerate(jobs[key]):
                    mine = nodes.get((*key, m))
                    if not mine:
                        continue
                    t = trees[(*key, m)]
                    node = np.zeros(len(y), np.int64)
                    for _ in range(level):
                        node = t.down(bins, node)
                    slot = np.full(len(t.n), -1, np.int64)
                    slot[mine] = np.arange(len(mine))
                    r = np.rint((y - now[m]) * scales[key])
                    n, g = histogram(wide, np.where(fold < j.fold, slot[node], -1), r, len(mine), width)
                    at = np.nonzero(n)
                    parts.append((np.full(len(at[0]), m), np.array(mine)[at[0]], at[1], at[2], n[at], g[at].astype(np.int64)))
                return [np.concatenate(c) for c in zip(*parts, strict=True)] or [[]] * 6

            hist = self._map(self.state, sums, "model int, node int, f int, b int, n long, g long")
            hist = hist.groupBy(*keys, "model", "node", "f", "b").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
            nodes = {k: [] for k in nodes}
            for key, node, best in self._best(hist):
                t = trees[key]
                t.set(node, best)
                if t.feature[node] >= 0:
                    nodes[key] += [2 * node + 1, 2 * node + 2]
        self._move(trees)
        return trees

    def _best(self, hist: DataFrame) -> Iterator[tuple]:
        """(model, node, best cut): a row for each node, from histograms of features x bins rows."""
        keys, scales = self.keys, self.scales

        def run(key: tuple, t: pa.Table) -> pa.Table:
            f, b = t.column("f").to_numpy(), t.column("b").to_numpy()
            n, g = (np.zeros((1, f.max() + 1, b.max() + 1), k) for k in (np.int64, np.float64))
            n[0, f, b], g[0, f, b] = t.column("n").to_numpy(), t.column("g").to_numpy()
            series = tuple(k.as_py() for k in key[: len(keys)])
            # features without a row here hold nothing; the total is that of the first
            best = best_cuts(n, g, scales[series])[0]
            cols = {c: pa.array([k.as_py()], k.type) for c, k in zip([*keys, "model", "node"], key, strict=True)}
            return pa.table(cols | {c: [v] for c, v in zip(("f", "b", "gain", "nl", "gl", "n", "g"), best, strict=True)})

        kinds = T._parse_datatype_string("model int, node int, f long, b long, gain double, nl long, gl long, n long, g long").fields
        cuts = hist.groupBy(*keys, "model", "node").applyInArrow(run, T.StructType(self.types + kinds))
        for r in cuts.collect():
            yield (*[r[k] for k in keys], r["model"]), r["node"], tuple(r)[-7:]

    def _move(self, trees: dict[tuple, Tree]) -> None:
        jobs, scales = self.jobs, self.scales

        def step(key: tuple, row: dict) -> list:
            bins, y, _ = _arrays(row["bins"], row["y"], row["fold"])
            now = np.frombuffer(row["now"], "<f8").reshape(-1, len(y)).copy()
            for m, j in enumerate(jobs[key]):
                t = trees[(*key, m)]
                now[m] += t.values(scales[key], j.rate)[t.leaf(bins)]
            return [[row[c]] for c in ("bins", "y", "fold")] + [[now.tobytes()]]

        self.state = cut_lineage(self._map(self.state, step, "bins binary, y binary, fold binary, now binary"), "boosted")

    def errors(self, trees: int) -> DataFrame:
        jobs, scales = self.jobs, self.scales

        def of(key: tuple, row: dict) -> list:
            _, y, fold = _arrays(row["bins"], row["y"], row["fold"])
            now, rows = np.frombuffer(row["now"], "<f8").reshape(-1, len(y)), []
            for m, j in enumerate(jobs[key]):
                if trees in j.stops:
                    valid = fold == j.fold
                    rows.append((j.depth, j.rate, j.fold, trees, int(np.rint(np.abs(y - now[m])[valid] * scales[key]).sum()), int(valid.sum()), scales[key]))
            return [list(c) for c in zip(*rows, strict=True)] or [[]] * 7

        return cut_lineage(self._map(self.state, of, ERRORS), "fold-errors")


def _large(blocks: DataFrame, keys: Sequence[str], jobs_of) -> _Large | None:
    """The series of several blocks with their jobs; the driver holds a row for each of them."""
    big = blocks.where("chunks > 1")
    told = big.select(*keys, "reach").distinct().collect()
    if not told:
        return None
    scales = {tuple(r[k] for k in keys): scale_of(r["reach"]) for r in told}
    return _Large(big, keys, {k: jobs_of(k) for k in scales}, scales)


# ---------------------------------------------------------------- user's side
def cross_validate(blocks: DataFrame, keys: Sequence[str], sets: Sequence[Mapping[str, float]], folds: int) -> DataFrame:
    """(keys, param_order, fold, mae): the error of every parameter set and fold.  Sets that differ by
    the number of trees share one model, which is scored on the way."""
    keys = list(keys)
    stops: dict[tuple, list[int]] = {}
    for s in sets:
        stops.setdefault((int(s["max_depth"]), float(s["learning_rate"])), []).append(int(s["n_estimators"]))
    jobs = [Job(d, r, k, tuple(sorted(set(n)))) for (d, r), n in stops.items() for k in range(1, folds + 1)]
    spark = blocks.sparkSession
    job = lambda j: F.struct(F.lit(j.depth).alias("depth"), F.lit(j.rate).alias("rate"), F.lit(j.fold).alias("k"), F.array(*map(F.lit, j.stops)).alias("stops"))
    # a copy of a block for each model of the grid
    work = blocks.where("chunks = 1").select(*keys, "reach", "bins", "y", "fold", F.explode(F.array(*map(job, jobs))).alias("job"))
    work = work.select(*keys, "reach", "bins", "y", "fold", "job.*")
    errors = _local(work, keys, ERRORS, _errors)
    large = _large(blocks, keys, lambda _: jobs)
    if large is not None:
        large.start()
        for i in range(1, max(j.stops[-1] for j in jobs) + 1):
            large.tree()
            if any(i in j.stops for j in jobs):
                errors = errors.union(large.errors(i))
    mean = F.try_divide(F.sum("err") / F.first("scale"), F.sum("n"))
    scores = errors.groupBy(*keys, "depth", "rate", "fold", "trees").agg(mean.alias("mae"))
    listed = [(int(s["max_depth"]), float(s["learning_rate"]), int(s["n_estimators"]), i) for i, s in enumerate(sets)]
    orders = F.broadcast(spark.createDataFrame(listed, "depth int, rate double, trees int, param_order int"))
    return scores.where("mae IS NOT NULL").join(orders, ["depth", "rate", "trees"]).select(*keys, "param_order", "fold", "mae")


def fit(blocks: DataFrame, keys: Sequence[str], params: DataFrame, features: Sequence[str]) -> DataFrame:
    """(keys, base, NODES): one model a series, grown on all rows of its blocks with its row of
    ``params`` (keys, max_depth, learning_rate, n_estimators)."""
    keys, features = list(keys), list(features)
    chosen = params.select(*keys, F.col("max_depth").cast("int").alias("depth"), F.col("learning_rate").cast("double").alias("rate"), F.col("n_estimators").cast("int").alias("trees"))
    work = blocks.where("chunks = 1").join(chosen, keys)

    def rows_of(row: dict) -> list[tuple]:
        bins, y, _ = _arrays(row["bins"], row["y"], row["fold"])
        scale, out = scale_of(row["reach"]), []
        base = float(np.rint(y * scale).sum()) / scale / len(y)
        for i, (tree, _) in enumerate(grow(bins, y, np.ones(len(y), bool), row["depth"], row["rate"], scale, row["trees"])):
            out += [(base, *r) for r in node_rows(tree, i, features, row["edges"], scale, row["rate"])]
        return out

    nodes = _local(work, keys, TREES, rows_of)
    big = {tuple(r[k] for k in keys): r for r in blocks.where("chunks > 1").select(*keys, "reach", "edges").dropDuplicates(keys).join(chosen, keys).collect()}
    large = _large(blocks, keys, lambda k: [Job(big[k]["depth"], big[k]["rate"], ALL, (big[k]["trees"],))])
    if large is not None:
        large.start()
        rows = []
        for i in range(max(r["trees"] for r in big.values())):
            for (*k, _), t in large.tree().items():
                r = big[tuple(k)]
                if i < r["trees"]:
                    rows += [(*k, large.base[(*k, 0)], *x) for x in node_rows(t, i, features, r["edges"], large.scales[tuple(k)], r["rate"])]
        nodes = nodes.union(blocks.sparkSession.createDataFrame(rows, nodes.schema))
    return nodes


def predict(df: DataFrame, nodes: DataFrame, features: Sequence[str], keys: Sequence[str], order: Sequence[str], block_rows: int = BLOCK_ROWS, out: str = "y_hat") -> DataFrame:
    """``df`` with ``out``: the prediction of its series' model, a base and the leaf of every tree.
    Rows go with a copy of their model in chunks of about ``block_rows``; all trees are walked
    at once.  A series without a model has a null."""
    keys, features = list(keys), list(features)
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows")).select(*keys, F.ceil(F.col("_rows") / F.lit(block_rows)).cast("int").alias("_chunks"))
    chunk = F.pmod(F.xxhash64(*order), F.col("_chunks")).cast("int")
    rows = df.join(counts, keys).withColumn("_chunk", chunk).drop("_chunks")
    node = F.array_sort(F.collect_list(F.struct("tree", "node", "feature", "threshold", "value")))
    models = nodes.groupBy(*keys).agg(F.first("base").alias("base"), node.alias("nodes")).join(counts, keys)
    models = models.select(*[F.col(k).alias(f"_m_{k}") for k in keys], F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_m_chunk"), "base", "nodes")
    kept = [c for c in rows.columns if c != "_chunk"]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(out, T.DoubleType())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        t = a.select(kept)
        if not b.num_rows or not a.num_rows:
            return t.append_column(out, pa.nulls(a.num_rows, pa.float64()))
        x = np.stack([a.column(c).cast(pa.float64()).to_numpy() for c in features], axis=1)
        return t.append_column(out, pa.array(walk(x, b.column("nodes")[0].values, b.column("base")[0].as_py(), features)))

    return rows.groupBy(*keys, "_chunk").cogroup(models.groupBy(*[f"_m_{k}" for k in keys], "_m_chunk")).applyInArrow(run, schema)


def walk(x: np.ndarray, nodes: pa.StructArray, base: float, features: Sequence[str]) -> np.ndarray:
    """Predictions of the rows ``x``: down one level of every tree at a time, leaves added in the order of the trees."""
    tree, node, feature, threshold, value = (nodes.field(i) for i in range(5))
    tree, node = tree.to_numpy(), node.to_numpy()
    size, number = int(node.max()) + 1, {t: i for i, t in enumerate(np.unique(tree).tolist())}
    at = np.array([number[t] for t in tree.tolist()], np.int64) * size + node
    place = {f: i for i, f in enumerate(features)}
    which = np.full(len(number) * size, -1, np.int32)
    which[at] = [place[f] if f is not None else -1 for f in feature.to_pylist()]
    limit, leaf = np.zeros(len(which)), np.zeros(len(which))
    limit[at] = np.nan_to_num(threshold.to_numpy(zero_copy_only=False).astype(float))
    leaf[at] = np.nan_to_num(value.to_numpy(zero_copy_only=False).astype(float))
    out = np.full(len(x), base)
    step = max(1, (1 << 22) // max(len(x), 1))
    for a in range(0, len(number), step):
        first = np.arange(a, min(a + step, len(number))) * size
        n = np.zeros((len(x), len(first)), np.int64)
        while True:
            f = which[first + n]
            if (f < 0).all():
                break
            v = np.take_along_axis(x, np.maximum(f, 0), axis=1)
            n = np.where(f < 0, n, 2 * n + 1 + (v >= limit[first + n]))
        for i in range(len(first)):  # one by one: the order of the sum is that of the trees
            out += leaf[first[i] + n[:, i]]
    return out


def gain_importance(nodes: DataFrame, features: Sequence[str], keys: Sequence[str] = ("region",)) -> DataFrame:
    """(keys, feature, importance): mean gain of a feature's cuts, as a share of the sum over the features;
    0 for a feature that no cut uses."""
    keys = list(keys)
    used = nodes.where(F.col("feature").isNotNull()).groupBy(*keys, "feature").agg(F.avg("gain").alias("g"))
    total = F.sum("g").over(Window.partitionBy(*keys))
    each = nodes.select(*keys).distinct().withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    share = used.withColumn("importance", F.try_divide(F.col("g"), F.nullif(total, F.lit(0.0)))).drop("g")
    return each.join(share, [*keys, "feature"], "left").withColumn("importance", F.coalesce("importance", F.lit(0.0)))


def split_counts(nodes: DataFrame, keys: Sequence[str] = ("region",), top: int | None = 15) -> DataFrame:
    """(keys, feature, splits, cover): cuts of each feature and the rows they parted; the ``top``
    features of a series by cuts, ties by name."""
    keys = list(keys)
    out = nodes.where(F.col("feature").isNotNull()).groupBy(*keys, "feature").agg(F.count("*").alias("splits"), F.sum("cover").alias("cover"))
    if top is None:
        return out
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("splits"), "feature"))
    return out.withColumn("_r", rank).where(F.col("_r") <= top).drop("_r")


def param_sets(grid: Mapping[str, Sequence[float]]) -> list[dict[str, float]]:
    """Cartesian product of the grid in the order the grid lists it."""
    return [dict(zip(grid, combo, strict=True)) for combo in itertools.product(*grid.values())]
