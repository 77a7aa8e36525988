"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

A task cuts whole texts into words, numbers the distinct ones of a block and
keeps, for each position, the number of its word. The distinct words go, packed
by hash, to one bucket each, where every word that occurs anywhere is split
into its pre-tokens and encoded once. The ids return to the blocks that asked,
and each text is put together by position. Decoding joins ids to the bytes of
the token table, whose size is that of the vocabulary.

A word is a run of characters between ASCII white space with the one space
before it, or a stretch of white space that the pattern splits off. The pattern
never matches across these borders, so words hold whole pre-tokens. Texts with
white space or separators beyond ASCII are cut by the pattern itself.

A null text is encoded as an empty one, to no ids. Ids and order of rows play
no part, repeated rows each get their own row, and columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm import exchange as X
from tessera.llm.session import partitions, prepare, stable
from tessera.llm.tokens import U, chunks, hash_spans, mix, raw, separators

BLOCK, REPLY = 0, 1
#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
ENCODED = "doc_id long, n_tokens long, ids array<int>"
_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
#: UTF-8 of white space and separators beyond ASCII's six.
_WIDE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8d\xa8\xa9\xaf]|\xe2\x81[\x9f\xa0]|\xe3\x80\x80|\xef\xbb\xbf")


def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def _encoder(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=vocabulary(path), special_tokens={})


@cache
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all ids one after the other, where each begins, and its length."""
    ranks = vocabulary(path)
    words = [b""] * (max(ranks.values()) + 1)
    for word, i in ranks.items():
        words[i] = word
    sizes = np.array([len(w) for w in words], np.int64)
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches ``data[start : start + size]`` one after the other."""
    ends = np.cumsum(size)
    return data[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def word_starts(buf: np.ndarray, begins: np.ndarray, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; a newline stands after each text."""
    space = separators(buf)
    before, after = np.empty_like(space), np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    blank = np.empty(len(buf), bool)
    blank[0], blank[1:] = False, buf[:-1] == 0x20
    mark = (space & ~before) | (space & ~after) | (~space & before & ~blank)
    mark[begins[:-1]] = True
    data = buf.tobytes()
    if _WIDE.search(data):
        find = regex.compile(pattern).findall
        for a, b in zip(begins[:-1].tolist(), (begins[1:] - 1).tolist(), strict=True):
            if _WIDE.search(data, a, b):
                sizes = [len(x.encode()) for x in find(data[a:b].decode())]
                mark[a:b] = False
                mark[a + np.cumsum([0, *sizes[:-1]])] = True
    mark[begins[1:] - 1] = True  # the newline after a text ends its last word and is no word
    at = np.flatnonzero(mark)
    ends = np.append(at[1:], len(buf))
    real = np.ones(len(at), bool)
    real[np.searchsorted(at, begins[1:] - 1)] = False
    return at[real], ends[real]


def _numbered(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words in rising order, where each occurs first, and the number of each word's.

    Words of equal hash are compared byte by byte; a word whose bytes differ from its number's gets another hash.
    """
    h = hash_spans(buf, starts, ends, lower=False)
    while True:
        distinct, first, places = np.unique(h, return_index=True, return_inverse=True)
        like = first[places]
        size = ends - starts
        odd = size != size[like]
        for a in range(0, len(h), 100_000):
            at = a + np.flatnonzero(~odd[a : a + 100_000] & (like[a : a + 100_000] != np.arange(a, min(a + 100_000, len(h)))))
            if len(at):
                differ = gather(buf, starts[at], size[at]) != gather(buf, starts[like[at]], size[at])
                odd[at] = np.logical_or.reduceat(differ, np.cumsum(size[at]) - size[at])
        if not odd.any():
            return distinct, first, places
        h[odd] = mix(h[odd] + U(1))


def _cut(batches: Iterable[pa.RecordBatch], pattern: str, count: int, kind: int) -> Iterator[tuple]:
    """Blocks with positions, or the distinct words of the same blocks; a word's number is its rank by hash."""
    number = X.batch_ids()
    for chunk in chunks(batches, "text", BLOCK_BYTES):
        batch = next(number)
        buf, begins = raw(chunk.column("text"))
        starts, ends = word_starts(buf, begins, pattern)
        distinct, first, places = _numbered(buf, starts, ends)
        if kind == BLOCK:
            ids = np.array(chunk.column("doc_id").fill_null(0).to_pylist(), dtype=np.int64)
            known = np.asarray(chunk.column("doc_id").is_valid())
            yield X.route_of(batch, count), batch, BLOCK, X.pack(ids, known, np.diff(np.searchsorted(starts, begins)), places.astype(np.uint32), level=1)
            continue
        bucket = X.bucket_of(distinct, count)  # ascends, as the hashes do
        sizes = (ends - starts)[first]
        edges = np.searchsorted(bucket, np.arange(count + 1))
        for b in np.flatnonzero(edges[1:] > edges[:-1]):
            cut = slice(edges[b], edges[b + 1])
            yield int(b), batch, BLOCK, X.pack(np.array([edges[b]], np.uint32), sizes[cut].astype(np.uint32), gather(buf, starts[first[cut]], sizes[cut]), level=3)


def _encode(held: list[tuple], path: str, pattern: str, count: int) -> Iterator[tuple]:
    piece, find, known = _encoder(path, pattern)._encode_single_piece, regex.compile(pattern).findall, {}
    for _, batch, _, payload in held:
        base, lengths, data = X.unpack(payload)
        data, out, begin = data.tobytes(), [], 0
        for end in np.cumsum(lengths, dtype=np.int64).tolist():
            word = data[begin:end]
            begin = end
            ids = known.get(word)
            if ids is None:
                ids = known[word] = [i for x in find(word.decode()) for i in piece(x)]
            out.append(ids)
        sizes = np.array([len(x) for x in out], np.uint32)
        flat = np.fromiter((i for x in out for i in x), np.uint32, int(sizes.sum()))
        yield X.route_of(batch, count), batch, REPLY, X.pack(base, sizes, flat if len(flat) and flat.max() > 65535 else flat.astype(np.uint16), level=1)


def _reassemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, replies, current = None, [], None
    for part in batches:
        for _, batch, kind, payload in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if batch != current:
                if block is not None:
                    yield from _texts(block, replies)
                current, block, replies = batch, None, []
            if kind == BLOCK:
                block = X.unpack(payload)
            else:
                replies.append(X.unpack(payload))
    if block is not None:
        yield from _texts(block, replies)
    del block, replies
    X.release()


def _texts(block: list[np.ndarray], replies: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The ids of each text of a block."""
    docs, known, sizes, places = block
    words = sum(len(r[1]) for r in replies)
    start, length = np.zeros(words, np.int64), np.zeros(words, np.int64)
    at = 0
    for (base,), counts, ids in replies:
        cut, counts = slice(int(base), int(base) + len(counts)), counts.astype(np.int64)
        start[cut], length[cut] = at + np.cumsum(counts) - counts, counts
        at += len(ids)
    flat = np.concatenate([r[2] for r in replies]).astype(np.int32) if replies else np.zeros(0, np.int32)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    a = 0
    while a < len(docs):  # some texts at a time: ids take more room than words
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + 200_000, side="right")) - 1)
        of = places[edges[a] : edges[b]]
        n = length[of]
        ids = gather(flat, start[of], n)
        marks = np.concatenate([[0], np.cumsum(n)])[edges[a : b + 1] - edges[a]]
        column = pa.ListArray.from_arrays(pa.array(marks, pa.int32()), pa.array(ids, pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(docs[a:b], pa.int64(), mask=~known[a:b]), pa.array(np.diff(marks), pa.int64()), column], schema=_ENCODED)
        a = b


def encode(docs: DataFrame, path: str, pattern: str, then: Callable | None = None, schema: str = ENCODED) -> DataFrame:
    """``doc_id, n_tokens, ids`` for each row of ``docs(doc_id, text)``; path names a file of ranks on every machine.

    ``then`` takes the Arrow batches of the result further, to ``schema``, in the worker that makes them.
    The texts are cut twice, once for their words and once for their positions: cheaper than moving positions through both exchanges.
    """
    p = partitions(prepare(docs.sparkSession))
    count = 4 * p

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return X.rows(r for _, held in X.runs(batches) for r in _encode(held, path, pattern, count))

    plain = stable(docs.select("doc_id", "text"))
    words = plain.mapInArrow(lambda it: X.rows(_cut(it, pattern, count, REPLY)), X.ENVELOPE)
    blocks = plain.mapInArrow(lambda it: X.rows(_cut(it, pattern, count, BLOCK)), X.ENVELOPE)
    met = X.routed(words, p).mapInArrow(answer, X.ENVELOPE)
    last = X.routed(blocks.unionAll(met), p)
    return last.mapInArrow(_reassemble if then is None else lambda it: then(_reassemble(it)), schema)


def lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and borders of a list column without nulls."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def decoded(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Batches with ids, and with the column ``decoded`` behind the others."""
    data, start, size = token_bytes(path)
    for batch in batches:
        for a in range(0, len(batch), 128):
            part = batch.slice(a, 128)
            ids, at = lists(part.column("ids"))
            sums = np.concatenate([[0], np.cumsum(size[ids])])[at]
            text = gather(data, start[ids], size[ids])
            column = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(sums.astype(np.int32)), pa.py_buffer(text)])
            yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, "decoded"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the column ``decoded``: the bytes that the ids stand for."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    return encoded.mapInArrow(lambda it: decoded(it, path), schema)


def _decimals(size: int) -> np.ndarray:
    """Each number's decimal text and a space, zeroes behind it."""
    return np.array([f"{i} ".encode() for i in range(size)], dtype="S").view(np.uint8).reshape(size, -1)


def digests(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Digests in place of ids and decoded bytes."""
    table = _decimals(size)
    width = (table > 0).sum(axis=1)
    for batch in batches:
        digests = []
        for a in range(0, len(batch), 128):
            ids, at = lists(batch.column("ids").slice(a, 128))
            wide = table[ids].ravel()
            text = wide[wide > 0].tobytes()
            ends = np.concatenate([[0], np.cumsum(width[ids])])[at].tolist()
            digests += [hashlib.sha256(text[b : e - (e > b)]).hexdigest() for b, e in zip(ends[:-1], ends[1:], strict=True)]
        texts = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column("decoded")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_tokens"), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row: what the ids and the bytes they decode to add up to."""
    size = len(token_bytes(path)[1])
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return encode(docs, path, pattern, lambda it: digests(decoded(it, path), size), kinds)
