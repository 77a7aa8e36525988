"""Packed exchanges: numpy blocks as binary rows, routed by Spark's shuffle.

A row is ``(route, batch, kind, payload)``. A task packs what it has for one
route into one payload, so the shuffle moves a few large rows in place of one
row for each value, and a key that many rows share is combined within the
task before it is sent. ``batch`` names the block of input rows that a payload
came from and is derived from the input partition, so a task that is run again
after an executor was lost makes the same rows.
"""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.tokens import mix

ENVELOPE = "route long, batch long, kind int, payload binary"
_FIELDS = pa.schema([("route", pa.int64()), ("batch", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
#: Bytes of payload in one Arrow batch.
FLUSH = 8 << 20


_COUNT, _ARRAY = struct.Struct("<I"), struct.Struct("<4sQ")
#: Kept between calls, since making them takes longer than most payloads: names of types and their reverse, compressors by level, the decompressor.
_names: dict[np.dtype, bytes] = {}
_types: dict[bytes, np.dtype] = {}
_deflate: dict[int, zstandard.ZstdCompressor] = {}
_inflate: list[zstandard.ZstdDecompressor] = []


def pack(*arrays: np.ndarray, level: int | None = None) -> bytes:
    """Arrays as bytes. Before compression the bytes of numbers are sorted by place value: high ones are alike."""
    parts = [_COUNT.pack(len(arrays))]
    for a in arrays:
        kind = a.dtype
        if kind not in _names:
            _names[kind] = kind.str.encode().ljust(4)
        parts.append(_ARRAY.pack(_names[kind], a.size))
        if level is None or kind.itemsize == 1 or not a.size:
            parts.append(a.tobytes())
        else:
            parts.append(np.ascontiguousarray(a).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes())
    data = b"".join(parts)
    if level is None:
        return data
    if level not in _deflate:
        _deflate[level] = zstandard.ZstdCompressor(level=level)
    return _deflate[level].compress(data)


def unpack(data: bytes) -> list[np.ndarray]:
    planes = data[:4] == b"\x28\xb5\x2f\xfd"
    if planes:
        if not _inflate:
            _inflate.append(zstandard.ZstdDecompressor())
        data = _inflate[0].decompress(data)
    out, at = [], _COUNT.size
    for _ in range(_COUNT.unpack_from(data)[0]):
        name, n = _ARRAY.unpack_from(data, at)
        if name not in _types:
            _types[name] = np.dtype(name.decode().strip())
        kind = _types[name]
        at += _ARRAY.size
        if planes and kind.itemsize > 1:
            out.append(np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, -1).T.copy().view(kind).ravel())
        else:
            out.append(np.frombuffer(data, kind, n, at))
        at += n * kind.itemsize
    return out


def release() -> None:
    """Give memory that a task no longer uses back to the system: workers live on after it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def rows(items: Iterable[tuple[int, int, int, bytes]], schema: pa.Schema = _FIELDS) -> Iterator[pa.RecordBatch]:
    """Arrow batches of tuples, cut by the size of their byte fields."""
    held: list[tuple] = []
    size = 0
    for item in items:
        held.append(item)
        size += 64 + sum(len(x) for x in item if isinstance(x, bytes))
        if size > FLUSH or len(held) >= 10_000:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)
    del held
    release()


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def batch_ids() -> Iterator[int]:
    """Numbers for the blocks of the task's input partition."""
    first = TaskContext.get().partitionId() << 32
    return iter(range(first, first + (1 << 32)))


def route_of(batch: int, count: int) -> int:
    """Where a block's rows meet: its number is mixed first, since partition numbers fill the upper half alone."""
    return int(mix(np.array([batch], np.uint64))[0] % np.uint64(count))


def routed(df: DataFrame, count: int) -> DataFrame:
    """Bring the rows of a route together, in order of route, batch and kind."""
    return df.repartition(count, "route").sortWithinPartitions("route", "batch", "kind")


def runs(batches: Iterable[pa.RecordBatch], key: str = "route") -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each run of equal keys."""
    current, held = None, []
    for batch in batches:
        place = batch.schema.get_field_index(key)
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            k = row[place]
            if held and k != current:
                yield current, held
                held = []
            current = k
            held.append(row)
    if held:
        yield current, held


def split(bucket: np.ndarray, count: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """``arrays`` cut by bucket; order within a bucket stays."""
    order = np.argsort(bucket.astype(np.uint16) if count <= 65536 else bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(count + 1))
    held = [a[order] for a in arrays]
    for b in np.flatnonzero(edges[1:] > edges[:-1]):
        yield int(b), [a[edges[b] : edges[b + 1]] for a in held]


def bucket_of(hashes: np.ndarray, count: int) -> np.ndarray:
    """Bucket by the hash's upper half."""
    return ((hashes >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
