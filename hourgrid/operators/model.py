"""Boosted-tree models of all series: search of parameters, refit, predictions, importances.

The trees are those of :mod:`hourgrid.operators.boosting`; here are the steps in terms of folds, parameter
sets and result tables.  Everything is keyed: no loop over series.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.operators import boosting
from hourgrid.operators.boosting import gain_importance, param_sets, predict, split_counts
from hourgrid.schemas import N_FOLDS
from hourgrid.session import cut_lineage

#: Label of rows without a fold (series with too few rows to part): no fold trains or validates on them.
NO_FOLD = 1 << 20


def params_text(p: Mapping[str, float]) -> str:
    return ",".join(f"{k}={p[k]}" for k in sorted(p))


def parse_params(text: str) -> dict[str, float]:
    return {k: float(v) for k, v in (part.split("=") for part in text.split(","))}


def sets_table(spark: SparkSession, grid: Mapping[str, Sequence[float]]) -> DataFrame:
    """(param_order, params, max_depth, learning_rate, n_estimators), a row a parameter set."""
    rows = [(i, params_text(p), int(p["max_depth"]), float(p["learning_rate"]), int(p["n_estimators"])) for i, p in enumerate(param_sets(grid))]
    return spark.createDataFrame(rows, "param_order int, params string, max_depth int, learning_rate double, n_estimators int")


def training_blocks(
    folded: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = ("region",), ts: str = "period", block_rows: int = boosting.BLOCK_ROWS, bins: int = boosting.BINS
) -> DataFrame:
    """Training rows, labelled by ``expanding_folds``, as blocks of binned features, written once."""
    folded = folded.withColumn("fold", F.coalesce("fold", F.lit(NO_FOLD)))
    edges = cut_lineage(boosting.bin_edges(folded, features, target, keys, bins=bins), "edges")
    return cut_lineage(boosting.pack(folded, edges, features, target, keys, "fold", [ts], block_rows), "blocks")


def grid_search(blocks: DataFrame, grid: Mapping[str, Sequence[float]], keys: Sequence[str] = ("region",), n_splits: int = N_FOLDS) -> DataFrame:
    """Fold scores ``(keys, params, param_order, fold, mae)`` of all series, parameter sets and folds;
    a series too short for folds has none."""
    sets = param_sets(grid)
    scores = boosting.cross_validate(blocks, keys, sets, n_splits)
    named = F.broadcast(sets_table(blocks.sparkSession, grid).select("param_order", "params"))
    return scores.join(named, "param_order").select(*keys, "params", "param_order", "fold", "mae")


def fit_best(blocks: DataFrame, best: DataFrame, grid: Mapping[str, Sequence[float]], features: Sequence[str], keys: Sequence[str] = ("region",)) -> DataFrame:
    """Node table of the models refitted on all training rows with the sets that ``best_params`` chose."""
    sets = F.broadcast(sets_table(blocks.sparkSession, grid).withColumnRenamed("param_order", "best_param_order"))
    return boosting.fit(blocks, keys, best.select(*keys, "best_param_order").join(sets, "best_param_order"), features)


__all__ = ["fit_best", "gain_importance", "grid_search", "param_sets", "params_text", "parse_params", "predict", "sets_table", "split_counts", "training_blocks"]
