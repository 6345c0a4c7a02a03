"""Date split, expanding-window folds, train-only scaling, fixed-length sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.operators.ordered import DEFAULT_BLOCK_ROWS, IDX, _ns_join, row_index
from hourgrid.schemas import N_FOLDS, SEQ_LEN


def time_split(df: DataFrame, split: str, ts: str = "period", flag: str = "is_test") -> DataFrame:
    """``is_test`` = row at or after ``split`` (train: strictly before), one pass."""
    return df.withColumn(flag, F.col(ts) >= F.lit(split).cast("timestamp_ntz"))


def expanding_folds(
    df: DataFrame,
    keys: Sequence[str] = ("region",),
    n_splits: int = N_FOLDS,
    ts: str = "period",
    out: str = "fold",
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """Label rows of each series for expanding-window cross-validation.

    With n rows and t = n div (n_splits + 1): the first n - n_splits*t rows are
    only ever trained on (fold 0); the rest form validation folds 1..n_splits of
    t rows each.  Fold k trains on rows with label < k and validates on label k.
    A series with fewer than n_splits + 1 rows gets NULL labels."""
    keys = list(keys)
    d = row_index(df, keys, ts, total="_n", block_rows=block_rows)
    t = F.floor(F.col("_n") / F.lit(n_splits + 1))
    start = F.col("_n") - F.lit(n_splits) * t
    label = F.when(t <= 0, F.lit(None)).when(F.col(IDX) < start, F.lit(0)).otherwise(
        F.lit(1) + F.floor((F.col(IDX) - start) / F.nullif(t, F.lit(0)))
    )
    return d.withColumn(out, label.cast("int")).drop("_n", IDX)


def fit_scaler(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("region",), fit_on=None) -> DataFrame:
    """Per key: mean and population standard deviation of each column over the
    rows selected by ``fit_on`` (default: not ``is_test``).  A zero (or undefined)
    deviation becomes scale 1.  One row per key."""
    keys = list(keys)
    cond = fit_on if fit_on is not None else ~F.col("is_test")
    aggs = []
    for c in cols:
        aggs.append(F.avg(c).alias(f"{c}__mean"))
        sd = F.stddev_pop(c)
        aggs.append(F.when(sd.isNull() | (sd == F.lit(0.0)), F.lit(1.0)).otherwise(sd).alias(f"{c}__scale"))
    return df.filter(cond).groupBy(*keys).agg(*aggs)


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("region",), inverse: bool = False) -> DataFrame:
    """(x - mean) / scale with the key's statistics, or back with ``inverse``.
    The statistics table has one row per key; AQE broadcasts it when it measures small."""
    keys = list(keys)
    d = _ns_join(df, scaler, keys)
    if inverse:
        exprs = {c: F.col(c) * F.col(f"{c}__scale") + F.col(f"{c}__mean") for c in cols}
    else:
        exprs = {c: (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__scale") for c in cols}
    d = d.withColumns(exprs)
    return d.drop(*[f"{c}__{s}" for c in cols for s in ("mean", "scale")])


def original_units(df: DataFrame, scaler: DataFrame, target: str, cols: Sequence[str] = ("y", "y_hat"), keys: Sequence[str] = ("region",)) -> DataFrame:
    """``cols`` hold scaled values of ``target``, such as predictions of a model on scaled rows: back to its units."""
    of = {f"{c}__{s}": F.col(f"{target}__{s}") for c in cols for s in ("mean", "scale")}
    return apply_scaler(df, scaler.select(*keys, *[e.alias(n) for n, e in of.items()]), cols, keys, inverse=True)


def standardise(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("region",), fit_on=None) -> tuple[DataFrame, DataFrame]:
    """Fit on training rows, apply to all rows.  Returns (scaled rows, scaler)."""
    scaler = fit_scaler(df, cols, keys, fit_on)
    return apply_scaler(df, scaler, cols, keys), scaler


#: Rows of a run of sequences.
RUN_ROWS = 1024


def sequence_runs(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    window: int = SEQ_LEN,
    keys: Sequence[str] = ("region", "is_test"),
    ts: str = "period",
    block_rows: int = DEFAULT_BLOCK_ROWS,
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """The sequences of :func:`sequences` as runs: ``steps``, the features of up to ``window + run_rows``
    rows in a row, and ``items``, the sequences in it: where each starts in ``steps``, its time and target.

    A step is stored 1 + window / run_rows times on average, not ``window`` times; a run is of bounded size
    and is what a training reader loads: sequence i is ``steps[start : start + window]``."""
    keys = list(keys)
    small_runs = min(run_rows, block_rows)
    d = row_index(df, keys, ts, block_rows=block_rows)
    own = F.floor(F.col(IDX) / F.lit(small_runs))
    last = F.floor((F.col(IDX) + F.lit(window)) / F.lit(small_runs))
    # only the last `window` rows of a run go to the following ones, too
    step = F.struct(F.col(IDX).alias("i"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    each = d.withColumn("run", F.explode(F.sequence(own, last)))
    item = F.when((F.col("run") == own) & (F.col(IDX) >= window), F.struct(F.col(IDX).alias("i"), F.col(ts).alias(ts), F.col(target).alias("y")))
    runs = each.groupBy(*keys, "run").agg(F.array_sort(F.collect_list(step)).alias("s"), F.array_sort(F.collect_list(item)).alias("t"))
    first = F.get("s", F.lit(0))["i"]
    items = F.transform("t", lambda x: F.struct((x["i"] - F.lit(window) - first).cast("int").alias("start"), x[ts].alias(ts), x["y"].alias("y")))
    return runs.where(F.size("t") > 0).select(*keys, "run", F.col("s.x").alias("steps"), items.alias("items"))


def sequences(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    window: int = SEQ_LEN,
    keys: Sequence[str] = ("region", "is_test"),
    ts: str = "period",
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """For every row with at least ``window`` rows before it in its series: the
    features of those ``window`` rows (oldest first) as ``seq`` (array of arrays)
    and the row's own target as ``y``.  Splits are separate series by default, so
    no sequence crosses the split.  The runs of :func:`sequence_runs`, laid out row by row."""
    return sequence_rows(sequence_runs(df, features, target, window, keys, ts, block_rows), window, keys, ts)


def sequence_rows(runs: DataFrame, window: int = SEQ_LEN, keys: Sequence[str] = ("region", "is_test"), ts: str = "period") -> DataFrame:
    """A row for each sequence of the ``runs``."""
    each = runs.select(*keys, "steps", F.explode("items").alias("t"))
    return each.select(*keys, F.col(f"t.{ts}").alias(ts), F.slice("steps", F.col("t.start") + 1, F.lit(window)).alias("seq"), F.col("t.y").alias("y"))
