"""Bloom filters over rows of whole numbers, sized by the number of rows.

A filter spares rows that surely match nothing a shuffle; whatever it lets
through still meets an exact join. Beyond ``MOST`` bits there is no filter, and
every row meets that join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import exchange as X
from tessera.llm.tokens import U, mix

#: Least and most bits of a filter; bits for a row.
LEAST, MOST, PER_ROW = 1 << 16, 1 << 28, 12


def marks(size: int, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The three bits of each row in a filter of ``size`` bits, a power of two."""
    h = np.zeros(len(columns[0]), dtype=U)
    for c in columns:
        h = mix(h + np.asarray(c).astype(np.int64).view(U))
    return tuple(((h >> U(k)) & U(size - 1)).astype(np.int64) for k in (0, 18, 36))


def contains(bits: np.ndarray | None, *columns: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(columns[0]), bool)
    out = np.ones(len(columns[0]), bool)
    for at in marks(8 * len(bits), *columns):
        out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
    return out


def build(rows: DataFrame, count: int | None = None) -> np.ndarray | None:
    """The filter of ``rows``, of which there are ``count``, MOST / 8 bytes at most, or None beyond; nulls are left out.

    Bits are dealt to slices; each slice is made in one task from the bits that fall in it.
    """
    rows = rows.na.drop()
    size, wanted = LEAST, PER_ROW * (rows.count() if count is None else count)
    while size < wanted:
        size *= 2
    if size > MOST:
        return None
    slices = max(1, size >> 20)
    each = size // slices

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            at = np.unique(np.concatenate(marks(size, *batch.columns)))
            for k, (own,) in X.split(at // each, slices, at % each):
                yield k, 0, 0, X.pack(own.astype(np.uint32), level=1)

    def unite(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for k, held in X.runs(batches):
            bits = np.zeros(each, bool)
            for *_, payload in held:
                bits[X.unpack(payload)[0]] = True
            yield k, 0, 0, np.packbits(bits).tobytes()

    met = rows.mapInArrow(lambda it: X.rows(part(it)), X.ENVELOPE).repartition(slices, "route").sortWithinPartitions("route")
    out = np.zeros((slices, each // 8), np.uint8)
    for r in met.mapInArrow(lambda it: X.rows(unite(it)), X.ENVELOPE).collect():  # one row for each slice
        out[r["route"]] = np.frombuffer(r["payload"], np.uint8)
    return out.ravel()


def semi(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The ``rows`` whose ``column`` is among ``ids``, and a few others by chance."""
    bits = build(ids)
    if bits is None:
        return rows.join(ids, column, "left_semi")
    return rows.where(maybe_in(ids, column, bits=bits))


def maybe_in(ids: DataFrame, *columns: str, bits: np.ndarray | None = None) -> Column:
    """False for rows whose ``columns`` surely match no row of ``ids``, nulls included; ``bits`` is their filter if it is made."""
    bits = ids.sparkSession.sparkContext.broadcast(build(ids) if bits is None else bits)
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))

    @F.pandas_udf("boolean")
    def hit(*values: pd.Series) -> pd.Series:
        return pd.Series(contains(bits.value, *(v.to_numpy().astype(np.int64) for v in values)), index=values[0].index)

    return known & hit(*(F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in columns))


def without(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose ``column`` is among ``ids``; only possible hits are shuffled."""
    hit = maybe_in(ids.select(column), column)
    return docs.where(~hit).unionByName(docs.where(hit).join(ids.select(column).distinct().hint("shuffle_hash"), column, "left_anti"))
