"""Boosted trees against a plain row-by-row version; blocks, missing values, short and constant series."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hourgrid.operators import boosting, metrics, model
from hourgrid.operators.splits import expanding_folds

FEATURES = ["x", "z", "c"]
SCHEMA = "region string, period timestamp_ntz, x double, z double, c double, y double, fold int"


def plain_edges(rows, f, cells=boosting.CELLS, bins=boosting.BINS):
    xs = sorted(r[f] for r in rows if r[f] is not None and not math.isnan(r[f]))
    if not xs:
        return []
    lo, hi = xs[0], xs[-1]
    cell = [min(math.floor((x - lo) / (hi - lo) * cells), cells - 1) if hi > lo else 0 for x in xs]
    out = {}
    for x, c in zip(xs, cell):
        b = sum(1 for d in cell if d < c) * bins // len(xs)
        out.setdefault(b, x)
    return sorted(out.values())


def plain_boost(rows, edges, train, depth, rate, trees, scale):
    """Node lists and the predictions of all rows after each tree, by loops."""
    def bin_of(r, f):
        v = r[f]
        return 0 if v is None or math.isnan(v) else max(sum(1 for e in edges[f] if e <= v) - 1, 0)

    bins = [{f: bin_of(r, f) for f in FEATURES} for r in rows]
    rint = lambda v: float(round(v))  # noqa: E731  half to even, as the library
    t_rows = [i for i in range(len(rows)) if train(rows[i])]
    now = [sum(rint(rows[i]["y"] * scale) for i in t_rows) / scale / len(t_rows)] * len(rows)
    steps = []
    for _ in range(trees):
        res, node, cuts = {i: rint((rows[i]["y"] - now[i]) * scale) for i in t_rows}, [0] * len(rows), {}
        for level in range(depth):
            for at in range(2**level - 1, 2 ** (level + 1) - 1):
                mine = [i for i in t_rows if node[i] == at]
                best = None
                for fi, f in enumerate(FEATURES):
                    for b in sorted({bins[i][f] for i in mine}):
                        left = [i for i in mine if bins[i][f] <= b]
                        if len(left) in (0, len(mine)):
                            continue
                        gl, gt = sum(res[i] for i in left), sum(res[i] for i in mine)
                        s = gl * gl / (len(left) + 1) + (gt - gl) * (gt - gl) / (len(mine) - len(left) + 1) - gt * gt / (len(mine) + 1)
                        if best is None or s > best[0]:
                            best = (s, fi, f, b)
                if best and 0.5 * best[0] / scale / scale > 1e-6:
                    cuts[at] = (best[2], edges[best[2]][best[3] + 1], 0.5 * best[0] / scale / scale, len(mine))
                    for i in range(len(rows)):
                        if node[i] == at:
                            node[i] = 2 * at + (1 if bins[i][best[2]] <= best[3] else 2)
        value = {}
        for at in {node[i] for i in t_rows}:
            mine = [i for i in t_rows if node[i] == at]
            value[at] = rate * ((sum(res[i] for i in mine) / scale) / (len(mine) + 1))
        now = [p + value.get(n, 0.0) for p, n in zip(now, node)]
        steps.append((cuts, value, list(now)))
    return steps


@pytest.fixture(scope="module")
def series(spark):
    r = random.Random(7)
    rows = []
    for name, n in (("a", 60), ("b", 43), ("short", 3), ("flat", 20)):
        for i in range(n):
            x, z = float(r.randrange(9)), r.choice([None, float("nan"), r.random(), r.random(), r.random()])
            y = 4.0 if name == "flat" else 3 * x + (z if z is not None and not math.isnan(z) else -5) + r.random()
            rows.append((name, None, x, z, 1.0, y, None))
    from datetime import datetime, timedelta

    rows = [(n, datetime(2024, 1, 1) + timedelta(hours=i), *rest) for i, (n, _, *rest) in enumerate(rows)]
    df = spark.createDataFrame(rows, SCHEMA).drop("fold")
    return expanding_folds(df, ("region",)).cache()


def by_region(df):
    out = {}
    for r in df.orderBy("period").collect():
        out.setdefault(r["region"], []).append(r.asDict())
    return out


GRID = {"n_estimators": [2, 4], "max_depth": [1, 3], "learning_rate": [0.5]}


def test_search_refit_and_predictions_equal_the_plain_version(series):
    rows, keys = by_region(series), ["region"]
    scales = {k: boosting.scale_of(max(abs(r["y"]) for r in v)) for k, v in rows.items()}
    edges = {k: {f: plain_edges(v, f) for f in FEATURES} for k, v in rows.items()}
    blocks = model.training_blocks(series, FEATURES, "y")
    scores = model.grid_search(blocks, GRID).collect()
    assert len(scores) == 3 * 4 * 4  # a series of 3 rows has no folds
    sets = model.param_sets(GRID)
    for s in scores:
        p, v = sets[s.param_order], rows[s.region]
        assert s.params == model.params_text(p)
        steps = plain_boost(v, edges[s.region], lambda r, k=s.fold: r["fold"] is not None and r["fold"] < k, p["max_depth"], p["learning_rate"], p["n_estimators"], scales[s.region])
        errs = [abs(r["y"] - e) for r, e in zip(v, steps[-1][2]) if r["fold"] == s.fold]
        assert s.mae == pytest.approx(sum(errs) / len(errs), abs=1e-6)
    best = metrics.best_params(model.grid_search(blocks, GRID))
    nodes = model.fit_best(blocks, best, GRID, FEATURES).cache()
    chosen = {r.region: sets[r.best_param_order] for r in best.collect()}
    assert set(chosen) == {"a", "b", "flat"}
    told = {}
    for n in nodes.collect():
        told.setdefault((n.region, n.tree), {})[n.node] = n
    want = {}
    for k, p in chosen.items():
        steps = plain_boost(rows[k], edges[k], lambda r: True, p["max_depth"], p["learning_rate"], p["n_estimators"], scales[k])
        want[k] = steps[-1][2]
        for t, (cuts, value, _) in enumerate(steps):
            got = told[(k, t)]
            assert {i: (n.feature, n.threshold, n.gain, n.cover) for i, n in got.items() if n.feature} == cuts
            assert {i: n.value for i, n in got.items() if not n.feature} == value
    for rows_of in (boosting.BLOCK_ROWS, 10):
        out = boosting.predict(series, nodes, FEATURES, keys, ["period"], rows_of)
        assert out.count() == series.count()
        for k, v in by_region(out).items():
            assert [r["y_hat"] for r in v] == want.get(k, [None] * len(v))
    gains = {(r.region, r.feature): r.importance for r in boosting.gain_importance(nodes, FEATURES).collect()}
    assert gains["a", "x"] > gains["a", "z"] > gains["a", "c"] == 0 and sum(v for k, v in gains.items() if k[0] == "a") == pytest.approx(1)
    assert gains["flat", "x"] == 0
    counts = boosting.split_counts(nodes, top=1).collect()
    assert {r.region: r.feature for r in counts} == {"a": "x", "b": "x"}
    assert counts[0].splits == sum(1 for (k, _), t in told.items() if k == counts[0].region for n in t.values() if n.feature == "x")


def test_many_blocks_give_the_same_models(series):
    """The job-a-level way, forced by small blocks, gives the trees and errors of the other one, to the bit."""
    one, many = (model.training_blocks(series, FEATURES, "y", block_rows=n) for n in (boosting.BLOCK_ROWS, 15))
    assert one.count() == 4 and many.where("chunks > 1").select("region").distinct().count() == 3
    grid = {"n_estimators": [1, 2], "max_depth": [2], "learning_rate": [0.3]}
    a, b = (sorted(map(tuple, model.grid_search(x, grid).collect())) for x in (one, many))
    assert a == b and len(a) == 3 * 2 * 4
    params = one.select("region").distinct().withColumns({"max_depth": F.lit(2), "learning_rate": F.lit(0.3), "n_estimators": F.when(F.col("region") == "a", 2).otherwise(1)})
    a, b = (sorted(map(str, boosting.fit(x, ["region"], params, FEATURES).collect())) for x in (one, many))
    assert a == b and a


def test_no_rows(spark, series):
    blocks = model.training_blocks(series.limit(0), FEATURES, "y")
    assert blocks.count() == 0
    scores = model.grid_search(blocks, GRID)
    assert scores.count() == 0
    nodes = model.fit_best(blocks, metrics.best_params(scores), GRID, FEATURES)
    assert nodes.count() == 0 and boosting.split_counts(nodes).count() == 0
    assert boosting.predict(series, nodes, FEATURES, ["region"], ["period"]).where("y_hat IS NULL").count() == series.count()


def test_best_cut_takes_the_first_of_equal_ones():
    import numpy as np

    n = np.array([[[2, 0, 2], [2, 2, 0]]])
    g = np.array([[[8.0, 0, -8.0], [8.0, -8.0, 0]]])
    f, b, gain, nl, gl, total, s = boosting.best_cuts(n, g, 1.0)[0]
    assert (f, b, nl, gl, total, s) == (0, 0, 2, 8, 4, 0) and gain == 0.5 * 2 * 64 / 3
