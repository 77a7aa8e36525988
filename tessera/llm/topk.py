"""Exact top-k search by tiled matrix products.

Vectors are dealt into shards and queries into blocks, both of bounded size,
as packed matrices. Every block meets every shard in one matrix product; the
tile keeps each query's k best by partial selection, and the per-query lists
are merged as a tree: within groups of shards, then over groups.

Components are quantised to ``floor(scale * x)`` as doubles, so products and
sums are whole numbers and scores exact while they stay under 2^53. Vectors
that are null, empty or hold a null or non-finite component take no part, and
neither do rows without an id. Vectors of different lengths never meet. Ties
go to the smaller id; a query's own id is not a candidate; ids that repeat are
candidates each time and one query.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import exchange as X
from tessera.llm.session import partitions, prepare

#: Vectors of a shard, queries of a block, lists merged at once.
SHARD, BLOCK, FAN = 4096, 256, 16
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("shard", pa.int64())])


def _usable(vectors: DataFrame, scale: float) -> DataFrame:
    parts = F.col("embedding").cast("array<double>")
    fine = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(parts, lambda x: F.floor(x * F.lit(scale)).cast("double"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine).select("vec_id", whole.alias("v"))


def _packed(vectors: DataFrame, groups: int, kind: int, most: int) -> DataFrame:
    """Matrices of the vectors of each group, by length; a group is ordered by id."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[tuple]:
            number = X.batch_ids()
            for route, held in X.runs(batches):
                by: dict[int, list] = {}
                for _, i, v in held:
                    by.setdefault(len(v), []).append((i, v))
                for n, got in by.items():
                    for a in range(0, len(got), most):
                        cut = got[a : a + most]
                        m = np.array([v for _, v in cut])
                        small = m.astype(np.float32)
                        yield route, next(number), kind, X.pack(np.array([n]), np.array([i for i, _ in cut], np.int64), (small if (small == m).all() else m).ravel())

        return X.rows(items())

    spread = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("route"), "vec_id", "v")
    p = partitions(vectors.sparkSession)
    return spread.repartition(p, "route").sortWithinPartitions("route", "vec_id").mapInArrow(build, X.ENVELOPE)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id; ids ascend."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        found = np.sort(np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]]))
    else:
        found = np.arange(len(scores))
    return found[np.lexsort((ids[found], -scores[found]))]


def _tiles(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[tuple]:
    current, shards = None, []
    for batch in batches:
        for route, _, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if route != current:
                current, shards = route, []
            (n,), ids, flat = X.unpack(payload)
            matrix = flat.reshape(-1, n).astype(np.float64)
            if kind == 0:
                shards.append((n, ids, matrix))
                continue
            for m, cand, values in shards:
                if m != n:
                    continue
                product = matrix @ values.T
                for i, q in enumerate(ids):
                    row = product[i]
                    own = np.searchsorted(cand, [q, q + 1])
                    if own[1] > own[0]:
                        row = np.delete(row, np.s_[own[0] : own[1]])
                        names = np.delete(cand, np.s_[own[0] : own[1]])
                    else:
                        names = cand
                    for j in _best(row, names, k):
                        yield int(q), int(names[j]), int(row[j]), route


def _merged(lists: DataFrame, k: int, *keys: Column | str) -> DataFrame:
    order = Window.partitionBy("query_id", *keys).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """``vectors(vec_id, embedding)``: query_id, rank from 1, vec_id, score for each row where ``is_query``."""
    spark = prepare(vectors.sparkSession)
    usable = _usable(vectors, scale)
    total, asked = vectors.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    shards, blocks = max(1, ceil(total / SHARD)), max(1, ceil(asked / BLOCK))
    queries = usable.where(is_query).dropDuplicates(["vec_id"])
    # every block goes to every shard: the stated query set against all rows
    sent = _packed(queries, blocks, 1, BLOCK).withColumn("route", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    held = _packed(usable, shards, 0, SHARD)
    tiles = held.unionAll(sent.select(held.columns)).repartition(partitions(spark), "route").sortWithinPartitions("route", "kind", "batch")
    lists = tiles.mapInArrow(lambda it: X.rows(_tiles(it, k), _OUT), "query_id long, vec_id long, score long, shard long")
    near = _merged(lists, k, F.floor(F.col("shard") / F.lit(FAN)))
    return _merged(near.drop("rank"), k).select("query_id", "rank", "vec_id", "score")
