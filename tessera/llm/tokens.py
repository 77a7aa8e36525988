"""Vectorised word hashing over UTF-8 bytes.

Words are maximal runs outside ``\\x20 \\x09-\\x0D`` with A-Z lower-cased. All
separators and letters concerned are ASCII, so working on bytes is exact for
UTF-8. A word is represented by a 64-bit hash of its bytes and length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Powers that are kept at least; bytes up to which a word is hashed along with others.
WINDOW, SHORT = 1 << 17, 256
#: Words that are hashed at once: their values stay in a processor's cache.
AT_ONCE = 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, a bijection of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BASE = U(0xD6E8FEB86659FD93)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_SIZE = U(0x9E3779B97F4A7C15)
#: The lowest bytes of a 64-bit value, by their number.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 2 * WINDOW)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def separators(buf: np.ndarray) -> np.ndarray:
    return (buf == 0x20) | (buf - np.uint8(0x09) < 5)


def lowered(buf: np.ndarray) -> np.ndarray:
    return buf + ((buf - np.uint8(0x41) < 26).view(np.uint8) << np.uint8(5))


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word."""
    edge = np.empty(len(buf) + 2, dtype=bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = separators(buf)
    at = np.flatnonzero(edge[1:] != edge[:-1])
    return at[0::2], at[1::2]


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A hash of each span's bytes: eight bytes at a time for all spans that have them, and at once for long ones."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = lowered(buf) if lower else buf
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    if len(starts) <= AT_ONCE:
        return _hashed(padded, eight, starts, ends)
    return np.concatenate([_hashed(padded, eight, starts[a : a + AT_ONCE], ends[a : a + AT_ONCE]) for a in range(0, len(starts), AT_ONCE)])


def _hashed(padded: np.ndarray, eight: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    out = mix((eight[starts] & _LOWEST[np.minimum(size, 8)]) + size.astype(U) * _SIZE)
    more, at = np.flatnonzero(size > 8), 8
    while len(more) and at < SHORT:
        left = size[more] - at
        out[more] = mix((out[more] ^ (eight[starts[more] + at] & _LOWEST[np.minimum(left, 8)])) * _BASE)
        at += 8
        more = more[left > 8]
    for i in more.tolist():
        whole = np.zeros(-(-(int(size[i]) - at) // 8) * 8, np.uint8)
        whole[: size[i] - at] = padded[starts[i] + at : ends[i]]
        parts = whole.view("<u8").astype(U)
        out[i] = mix(out[i : i + 1] ^ mix(parts + np.arange(1, len(parts) + 1, dtype=U) * _SIZE).sum(dtype=U))[0]
    return out


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, a newline after each value, and where each starts (one more at the end)."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    sizes = np.diff(offsets)
    if column.null_count:
        sizes = np.where(np.asarray(column.is_null()), 0, sizes)
    begins = np.zeros(n + 1, np.int64)
    np.cumsum(sizes + 1, out=begins[1:])
    buf = np.empty(int(begins[-1]), dtype=np.uint8)
    buf[begins[1:] - 1] = 0x0A
    if column.null_count or int(sizes.sum()) != int(offsets[-1] - offsets[0]):
        for i in np.flatnonzero(sizes).tolist():
            buf[begins[i] : begins[i] + sizes[i]] = data[offsets[i] : offsets[i] + sizes[i]]
    else:  # texts stand one after the other: all but the places of newlines, in order
        text = np.ones(len(buf), bool)
        text[begins[1:] - 1] = False
        buf[text] = data[offsets[0] : offsets[-1]]
    return buf, begins


def words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column and, for each value, where its words begin (one more at the end)."""
    buf, begins = raw(column)
    starts, ends = spans(buf)
    return hash_spans(buf, starts, ends, lower), np.searchsorted(starts, begins)


def chunks(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Regroup record batches so that each holds about ``most`` bytes of ``column`` or one row."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        a = 0
        for i, n in enumerate(lengths):
            if size and size + n > most:
                held.append(batch.slice(a, i - a))
                yield _joined(held)
                held, size, a = [], 0, i
            size += int(n)
        held.append(batch.slice(a))
    if held and sum(len(x) for x in held):
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if sum(map(len, batches)) else batches[0]


def crc32_of_ids(ids: Iterable[int | None]) -> np.ndarray:
    """crc32 of each id's decimal text; -1 where the id is null."""
    import zlib

    return np.array([-1 if x is None else zlib.crc32(str(x).encode()) for x in ids], dtype=np.int64)
