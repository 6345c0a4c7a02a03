"""Exact top-k search by inner product, in tiles of queries and shards.

Vectors are dealt by a hash to shards, queries to blocks; each tile is one block and one
shard, both of bounded size, and computes one matrix product (in column steps).  A tile
keeps the best ``k`` of each query, ties to the smaller id, and the lists of the tiles are
merged as a tree of ``FAN_IN`` lists a step.

Components become floor(scale * x).  Sums are exact: as float64 while they stay below 2**53,
else in Python's integers (scores beyond a long are held at its ends).

Rows are numbered in the order of their ids, so ties by number are ties by id.  Every row is a candidate and,
where asked for, a query of its own, rows that repeat an id or a vector as well; only the
query's own row is none of its candidates.

Vectors that are null or hold a null or non-finite component, and rows with a null id, take
no part.  Vectors of another dimension than the query's are no candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.llm.common import staged

#: Rows of a block of queries and of a shard: with 64 components 8 MB each.
BLOCK_ROWS = 16_384
#: A shard is not cut below this many rows for the sake of more tasks.
LEAST_ROWS = 1_024
#: Scores held by one step of a tile.
STEP_SCORES = 1 << 22
FAN_IN = 32


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Mask of the ``k`` largest of each row, ties to the smaller column; NaN is no score."""
    s = np.where(np.isnan(scores), -np.inf, scores)
    if s.shape[1] <= k:
        return s > -np.inf
    limit = np.partition(s, -k, axis=1)[:, -k][:, None]
    more, equal = s > limit, (s == limit) & (s > -np.inf)
    return more | equal & (np.cumsum(equal, axis=1) <= k - more.sum(axis=1)[:, None])


def tile(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the best ``k`` of each query; the ids of vectors ascend."""
    if not len(qid) or not len(vid):
        return qid[:0], vid[:0], np.zeros(0, np.int64)
    if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1] >= 2**53:
        return _tile_of_large(qid, q, vid, v, k)
    held: list[tuple[np.ndarray, ...]] = []
    rows = max(1, min(len(qid), STEP_SCORES // min(len(vid), 4096)))
    for a in range(0, len(qid), rows):
        part, ids = q[a : a + rows], qid[a : a + rows]
        top = None
        for b in range(0, len(vid), 4096):
            s = part @ v[b : b + 4096].T
            s[ids[:, None] == vid[None, b : b + 4096]] = np.nan
            keep = best(s, k)
            r, c = np.nonzero(keep)
            new = (r, vid[b + c], s[r, c])
            top = new if top is None else tuple(map(np.concatenate, zip(top, new, strict=True)))
            if b:
                order = np.lexsort((top[1], -top[2], top[0]))
                top = tuple(x[order] for x in top)
                first = np.flatnonzero(np.r_[True, top[0][1:] != top[0][:-1]])
                place = np.arange(len(top[0])) - np.repeat(first, np.diff(np.r_[first, len(top[0])]))
                top = tuple(x[place < k] for x in top)
        held.append((ids[top[0]], top[1], top[2].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*held, strict=True))  # type: ignore[return-value]


def _tile_of_large(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with Python's integers, a query at a time."""
    ends, rows = np.iinfo(np.int64), []
    whole = [list(map(int, x)) for x in v]
    for i, x in zip(qid.tolist(), q, strict=True):
        x = list(map(int, x))
        got = [(-max(ends.min, min(ends.max, sum(a * b for a, b in zip(x, y, strict=True)))), j) for j, y in zip(vid.tolist(), whole, strict=True) if i != j]
        rows += [(i, j, -s) for s, j in sorted(got)[:k]]
    cols = np.array(rows, dtype=np.int64).reshape(-1, 3)
    return cols[:, 0], cols[:, 1], cols[:, 2]


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of rows, ascending, and their vectors."""
    if not t.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 1))
    ids = t.column(-3).to_numpy()
    m = pa.concat_arrays([c.flatten() for c in t.column(-1).chunks]).to_numpy().reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    return ids[order], m[order]


def vectors(table: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(n, id, x, dim): the rows that take part as scaled whole numbers, numbered in the order of their ids."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    # floor as a double: a long would overflow for large components
    whole = F.transform(x, lambda v: F.rint(v * scale) - F.when(F.rint(v * scale) > v * scale, 1.0).otherwise(0.0))
    rows = table.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & good).select(F.col(key).cast("long").alias("id"), whole.alias("x"))
    # rows of one id are parted by their vectors, equal ones by their place: none of them fills a task
    rows = rows.withColumn("h", F.xxhash64("x")).withColumn("place", F.monotonically_increasing_id())
    in_order = rows.repartitionByRange("id", "h", "place").sortWithinPartitions("id", "h", "place")
    return in_order.select(F.monotonically_increasing_id().alias("n"), "id", "x", F.size("x").alias("dim"))


def top_k(table: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best rows for every row where ``is_query``
    (an expression over ``id``) holds; all candidates if they are fewer."""
    spark = table.sparkSession
    rows = staged(vectors(table, key, vector, scale), "vectors")
    total, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-total // block_rows), min(wanted, -(-total // LEAST_ROWS)), 1)
    blocks = max(-(-n_queries // block_rows), 1)
    spread = lambda parts: F.pmod(F.xxhash64("n"), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = rows.where(is_query).select("dim", spread(blocks).alias("block"), each(shards).alias("shard"), "n", "id", "x")
    right = rows.select(F.col("dim").alias("vdim"), each(blocks).alias("vblock"), spread(shards).alias("vshard"), F.col("n").alias("vn"), F.col("id").alias("vid"), F.col("x").alias("vx"))

    def run(keys: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        q, v, s = tile(*_matrix(a), *_matrix(b), k)
        ids = [_ids(t, of) for t, of in ((a, q), (b, v))]
        return pa.table({"query": q, "query_id": ids[0], "shard": pa.array(np.full(len(q), keys[2].as_py()), pa.int32()), "vec": v, "vec_id": ids[1], "score": s})

    tiles = ["dim", "block", "shard"]
    lists = left.groupBy(tiles).cogroup(right.groupBy(*[f"v{c}" for c in tiles])).applyInArrow(run, "query long, query_id long, shard int, vec long, vec_id long, score long")
    order = [F.desc("score"), F.asc("vec")]
    while shards > 1:
        shards = -(-shards // FAN_IN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int"))
        some = Window.partitionBy("query", "shard").orderBy(*order)
        lists = lists.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k).drop("rank")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return lists.select("query_id", rank.alias("rank"), "vec_id", "score")


def _ids(t: pa.Table, numbers: np.ndarray) -> np.ndarray:
    """Ids of the rows with these numbers."""
    if not len(numbers):
        return np.zeros(0, np.int64)
    n, ids = t.column(-3).to_numpy(), t.column(-2).to_numpy()
    order = np.argsort(n)
    return ids[order][np.searchsorted(n[order], numbers)]


__all__ = ["best", "tile", "top_k"]
