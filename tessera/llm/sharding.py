"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Rows with equal texts form a group and a group is placed whole, on the shard
where the dot product of the group's size vector with the shard's residual
capacity is highest (each dimension as a share of its total).

*Large groups* hold more than 1/64 of a shard's fair share in some dimension;
there are at most 64 * 3 * shards of them whatever the input, so they are placed
one after the other, largest first. Only one that exceeds a whole fair share is cut into
parts, by doc_id, since no shard could take it as a whole and stay near equal.
*All other groups* are dealt by text hash into slices of bounded size. Each
slice packs its groups on its own against its part of what capacity the large
groups left, so slices run in parallel and their sums balance.

The law that holds is ``bytes``: sizes near equal. Slots are numbered by slice,
then doc_id. Null texts count as empty; a null doc_id is a row like any other;
repeated rows are rows of one group; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import exchange as X
from tessera.llm.session import materialize, partitions, prepare

#: A large group's least part of a fair share; the part above which a group is cut; rows of a slice.
LARGE, CUT, SLICE_ROWS = 1 / 64, 1, 50_000
#: How much each dimension counts in the dot product: the law is about bytes.
WEIGHTS = np.array([16.0, 1.0, 1.0])
OVERHEAD = 16
WORD = r"[^\x20\x09-\x0D]+"
_OUT = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("text_crc32", pa.int64()), ("shard", pa.int32()), ("slice", pa.int64()), ("place", pa.int64())])


def measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
    )


class Bins:
    """Shards as residual capacities in shares of each dimension's total."""

    def __init__(self, capacity: np.ndarray) -> None:
        self.free = capacity.copy()

    def place(self, item: np.ndarray) -> int:
        best = int((self.free @ (WEIGHTS * item)).argmax())
        self.free[best] -= item
        return best


def _slices(batches: Iterable[pa.RecordBatch], share: np.ndarray) -> Iterator[tuple]:
    for slice_, held in X.runs(batches, "slice"):
        groups: dict[tuple, list] = {}
        placed: list[tuple] = []
        for _, doc, size, crc, h, tokens, shard in held:
            if shard is not None:
                placed.append((doc, size, crc, shard))
            else:
                groups.setdefault((h, crc, size, tokens), []).append(doc)
        if groups:
            items = np.array([(k[2] * len(v), k[3] * len(v), len(v)) for k, v in groups.items()], dtype=float)
            items /= np.maximum(items.sum(axis=0), 1)
            names, bins = list(groups), Bins(share)
            for i in np.argsort(-items.max(axis=1), kind="stable"):
                h, crc, size, _ = names[i]
                shard = bins.place(items[i])
                placed += [(doc, size, crc, shard) for doc in groups[names[i]]]
        placed.sort(key=lambda r: (r[3], r[0] is not None, r[0] or 0))
        at = dict.fromkeys(range(len(share)), 0)
        for doc, size, crc, shard in placed:
            yield doc, size, crc, shard, slice_, at[shard]
            at[shard] += 1


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each row of ``docs(doc_id, text)``."""
    spark = prepare(docs.sparkSession)
    base = materialize(measured(docs))
    key = ["h", "text_crc32", "size", "tokens"]
    total = base.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()
    whole = np.array([max(1, x or 0) for x in total], dtype=float)
    fair = whole / shards
    rows_of = F.count(F.lit(1))
    groups = base.groupBy(*key).agg(rows_of.alias("n"))
    part = F.greatest(F.col("n") * F.col("size") / float(fair[0]), F.col("n") * F.col("tokens") / float(fair[1]), F.col("n") / float(fair[2]))
    large = groups.withColumn("part", part).where(F.col("part") > LARGE)
    found = {tuple(r[k] for k in key): max(1, ceil(r["part"] / CUT)) if r["part"] > CUT else 1 for r in large.collect()}  # at most 3 * shards / LARGE rows
    kinds = "h long, text_crc32 long, size long, tokens long"
    pieces = F.broadcast(spark.createDataFrame([(*k, n) for k, n in found.items()], f"{kinds}, pieces long"))
    held = base.join(pieces, key, "left").withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.col("pieces")))
    parts = [(tuple(r[k] for k in key), r["piece"], r["n"]) for r in held.where("pieces IS NOT NULL").groupBy(*key, "piece").agg(rows_of.alias("n")).collect()] if found else []
    bins, placed = Bins(np.full((shards, 3), 1 / shards)), []
    sized = [(np.array([k[2] * n, k[3] * n, n]) / whole, k, piece) for k, piece, n in parts]
    for item, k, piece in sorted(sized, key=lambda x: (-x[0].max(), x[1:])):
        placed.append((*k, piece, bins.place(item)))
    share = np.maximum(bins.free, 0)
    share /= np.maximum(share.sum(axis=0), 1e-12)
    homes = F.broadcast(spark.createDataFrame(placed, f"{kinds}, piece long, shard int"))
    count = max(1, ceil(whole[2] / SLICE_ROWS))
    dealt = held.join(homes, [*key, "piece"], "left").withColumn(
        "slice", F.when(F.col("shard").isNull(), F.pmod(F.xxhash64(*key), F.lit(count))).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(count)))
    )
    dealt = dealt.select("slice", "doc_id", "size", "text_crc32", "h", "tokens", "shard")
    dealt = dealt.repartition(min(count, partitions(spark)), "slice").sortWithinPartitions("slice", "h", "text_crc32", "doc_id")
    kind = "doc_id long, size long, text_crc32 long, shard int, slice long, place long"
    done = materialize(dealt.mapInArrow(lambda it: X.rows(_slices(it, share), _OUT), kind))
    counts = done.groupBy("shard", "slice").agg(rows_of.alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return done.join(offsets, ["shard", "slice"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.col("place")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
