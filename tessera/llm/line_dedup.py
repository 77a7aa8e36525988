"""Line deduplication by an exact set-similarity join.

A line's tokens are its distinct words (ASCII case folded). A line goes when an
earlier line, by doc_id and then line number, has the same set or one whose
Jaccard similarity with it reaches the threshold. Lines of fewer than
``least`` tokens are left alone; with 1, all lines that hold a word are compared.

1. Words are counted over the whole corpus. The most frequent, ``HEAD`` at most,
   are ordered by rising count, all others come before them in order of hash; any
   fixed order gives exact results, this one puts the rare ones first.
2. *Equal sets.* Token sets meet by a signature of 128 bits and are compared
   token by token; of equal ones the earliest line stays. Those of a block of
   texts collapse before they are sent, so a very frequent line comes once from
   each block. All later steps see distinct sets only.
3. *Prefix filter.* Two similar sets share one of their first
   n - ceil(t n) + 1 tokens. Sets are sent, packed by hash of these tokens, to
   where the token's lines meet. A posting has the line's place, its number of
   tokens, the token's position and a bitmap of all tokens.
4. In a token's list pairs must pass the *length filter*, the *positional
   filter* (tokens left after the shared one must suffice) and the bitmap bound
   (symmetric difference). Lists of over ``TILE`` postings are cut, and pairs of
   pieces that the length filter allows are dealt out as tasks of their own.
   Each line proposes at most ``FIRST`` of its most similar earlier lines from
   a list; the number is no limit of the result, see 6.
5. *Verification.* Jaccard is computed on the token sets, for each line's best
   candidate and then for the others of lines that this leaves.
6. The lists of lines that proposed fewer than they had are kept; those of
   which none was verified propose all from them.

Null and empty texts have no lines to remove; an empty table gives an empty
one. Rows without doc_id are neither compared nor changed. Rows that repeat a
doc_id count as one document: they keep lines that only they share, and a line
number that goes in one goes in all. Lines are split at ``\\n``, however long
they or their text are; a document all of whose lines go keeps an empty text.
Other columns pass through; ones named ``n_lines`` or ``removed`` are replaced.
Words are told apart by 63 bits of a hash of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bloom
from tessera.llm import exchange as X
from tessera.llm.session import discard, materialize, partitions, prepare, reclaim, stable
from tessera.llm.tokens import U, chunks, hash_spans, mix, raw, spans, words

#: Words ordered by count; pairs that a line proposes from one list at first; bytes of text in a block.
HEAD, FIRST, BLOCK_BYTES = 1 << 16, 8, 8 << 20
#: Postings of a list that are paired at once; sets packed together.
TILE, PACKED = 4096, 30_000
#: Tokens to a 64-bit word of a bitmap at most, and its widest in words.
BITS, WIDEST = 48, 32
#: Bins of counts to a doubling.
BINS = 16
#: Marks the key of one of the HEAD words, whose rank stands RANK bits up.
FREQUENT, RANK = U(1 << 63), U(40)
#: Kinds of rows: sums of a task, frequent words, distinct sets, lines equal to an earlier one.
HIST, WORDS, SETS, SURE = range(4)
#: Kinds of found rows: pairs, kept lists, pieces of long lists; pairs tested at once and held by a task.
PAIR, LIST, PIECE = range(3)
STEP, HELD = 400_000, 400_000
COLUMNS = ("doc_id", "line", "other_doc", "other_line")
LONGS = ", ".join(f"{c} long" for c in COLUMNS)
_LONGS = pa.schema([(c, pa.int64()) for c in COLUMNS])
FOUND = "kind int, route long, tiles array<long>, payload binary"
_FOUND = pa.schema([("kind", pa.int32()), ("route", pa.int64()), ("tiles", pa.list_(pa.int64())), ("payload", pa.binary())])
KEPT = "kind int, payload binary"
_KEPT = pa.schema([("kind", pa.int32()), ("payload", pa.binary())])
_ONE, _TWO = U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3)


class Lines:
    """The words of a block of texts by line."""

    def __init__(self, chunk: pa.RecordBatch) -> None:
        self.buf, begins = raw(chunk.column("text"))
        breaks = np.flatnonzero(self.buf == 0x0A)  # one after each line: texts end in one too
        self.begin = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else np.zeros(0, np.int64)
        self.end = breaks
        row = np.searchsorted(begins, self.begin, side="right") - 1
        first = np.searchsorted(self.begin, begins[:-1])
        self.number = np.arange(len(breaks)) - first[row]
        ids = chunk.column("doc_id")
        self.known = np.asarray(ids.is_valid())[row]
        self.doc = np.array(ids.fill_null(0).to_pylist(), dtype=np.int64)[row]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and line of each word of lines whose document has an id."""
        starts, ends = spans(self.buf)
        line = np.repeat(np.arange(len(self.end)), np.diff(np.append(np.searchsorted(starts, self.begin), len(starts))))
        if not self.known.all():
            use = self.known[line]
            starts, ends, line = starts[use], ends[use], line[use]
        return hash_spans(self.buf, starts, ends), line


class Head:
    """The frequent words: their hashes in rising order, found through the upper bits, and each one's rank by rising count."""

    SLOTS = 18

    def __init__(self, h: np.ndarray, rank: np.ndarray) -> None:
        self.h, self.rank = h, rank
        self.begin = np.searchsorted(h >> U(64 - self.SLOTS), np.arange((1 << self.SLOTS) + 1, dtype=U)).astype(np.int32)
        self.most = int(np.diff(self.begin).max())

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """The rank of each word, or -1."""
        out = np.full(len(h), -1, np.int64)
        slot = (h >> U(64 - self.SLOTS)).astype(np.int64)
        at, end = self.begin[slot], self.begin[slot + 1]
        todo = np.flatnonzero(at < end)
        for _ in range(self.most):
            hit = self.h[at[todo]] == h[todo]
            out[todo[hit]] = self.rank[at[todo[hit]]]
            at[todo] += 1
            todo = todo[~hit & (at[todo] < end[todo])]
        return out


def token_sets(h: np.ndarray, line: np.ndarray, head: Head) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (line, key) in order of line and key. Keys sort words by rarity and are equal for equal words only."""
    # each word is looked up once; words get numbers in the order of their keys, so that lines and numbers sort as one value
    coded = pa.array(h).dictionary_encode()
    distinct = np.asarray(coded.dictionary)
    rank = head.ranks(distinct)
    key, number = np.unique(np.where(rank >= 0, FREQUENT | (rank.astype(U) << RANK), distinct >> U(1)), return_inverse=True)
    joint = np.sort((line << 32) | number[np.asarray(coded.indices)])
    joint = joint[np.concatenate(([True], joint[1:] != joint[:-1]))] if len(joint) else joint
    return key[joint & 0xFFFFFFFF], joint >> 32


def prefix(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return n - -(-num * n // den) + 1


def need(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least overlap of similar sets of a and b tokens."""
    return -(-num * (a + b) // (num + den))


def words_wide(n: np.ndarray) -> np.ndarray:
    """64-bit words in the bitmap of a line of n tokens: a power of two."""
    return np.minimum(1 << np.ceil(np.log2(np.maximum(n, BITS) / BITS)).astype(np.int64), WIDEST)


def bitmaps(key: np.ndarray, n: np.ndarray, wide: int) -> np.ndarray:
    """One row of ``wide`` words for each run of n keys: bits that an odd number of them fall on.

    Keys that two sets share cancel out, so bitmaps differ in no more bits than the sets in keys.
    """
    bit = mix(key) & U(64 * wide - 1)
    out = np.zeros(len(n) * wide, dtype=U)
    owner = np.repeat(np.arange(len(n)), n)
    np.bitwise_xor.at(out, owner * wide + (bit >> U(6)).astype(np.int64), U(1) << (bit & U(63)))
    return out.reshape(-1, wide)


def spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places begin .. begin + n - 1 of each run, one after the other."""
    ends = np.cumsum(n)
    return np.repeat(begin - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


# 1. frequent words


def _count(batches: Iterable[pa.RecordBatch], count: int) -> Iterator[tuple]:
    number = X.batch_ids()
    for chunk in chunks(batches, "text", BLOCK_BYTES):
        batch = next(number)
        h, at = words(chunk.column("text"))
        known = np.asarray(chunk.column("doc_id").is_valid())
        h, n = np.unique(h if known.all() else h[np.repeat(known, np.diff(at))], return_counts=True)
        for b, (x, c) in X.split(X.bucket_of(h, count), count, h, n.astype(np.uint32)):
            yield b, batch, 0, X.pack(x, c, level=1)


def _bin(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(n) * BINS).astype(np.int64)


def _heaviest(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple]:
    """The words of each bucket that can be among the most frequent, and how many words of the task are in each bin."""
    bins = np.zeros(64 * BINS, np.int64)
    for _, held in X.runs(batches):
        blobs = [X.unpack(p) for *_, p in held]
        distinct, back = np.unique(np.concatenate([b[0] for b in blobs]), return_inverse=True)
        total = np.rint(np.bincount(back, np.concatenate([b[1] for b in blobs]))).astype(np.int64)
        bins += np.bincount(_bin(total), minlength=len(bins))
        top = np.argsort(-total, kind="stable")[:most]
        yield WORDS, X.pack(distinct[top], total[top], level=1)
    yield HIST, X.pack(bins, level=1)


def _above(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[tuple]:
    for batch in batches:
        for payload in batch.column("payload").to_pylist():
            h, n = X.unpack(payload)
            take = _bin(n) >= least
            yield from zip(h[take].view(np.int64).tolist(), n[take].tolist(), strict=True)


def frequent_words(docs: DataFrame, most: int = HEAD) -> Head:
    """The most frequent words.

    They are taken by whole bins of counts, as many as hold ``most`` words or fewer.
    """
    p = partitions(docs.sparkSession)
    counted = X.routed(docs.select("doc_id", "text").mapInArrow(lambda it: X.rows(_count(it, p)), X.ENVELOPE), p)
    table = materialize(counted.mapInArrow(lambda it: X.rows(_heaviest(it, most), _KEPT), KEPT))
    tasks = [X.unpack(r["payload"])[0] for r in table.where(F.col("kind") == HIST).collect()]  # one row of fixed size for each task
    bins = np.sum([np.zeros(64 * BINS, np.int64), *tasks], axis=0)
    above = np.cumsum(bins[::-1])[::-1]
    least = int(np.argmax(above <= most)) if above[-1] <= most else len(bins)
    kind = pa.schema([("h", pa.int64()), ("n", pa.int64())])
    top = table.where(F.col("kind") == WORDS).mapInArrow(lambda it: X.rows(_above(it, least), kind), "h long, n long").collect()  # at most ``most`` rows
    discard(table)
    h = np.array([r["h"] for r in top], dtype=np.int64).view(U)
    order = np.lexsort((h, [r["n"] for r in top]))
    rank = np.empty(len(top), np.int64)
    rank[order] = np.arange(len(top))
    by = np.argsort(h)
    return Head(h[by], rank[by])


# 2. equal sets


class Sets:
    """Token sets one after the other: where each stands, its number of tokens, and the keys in rising order."""

    def __init__(self, doc: np.ndarray, line: np.ndarray, n: np.ndarray, key: np.ndarray, begin: np.ndarray | None = None) -> None:
        self.doc, self.line, self.n, self.key = doc, line, n, key
        self.begin = np.cumsum(n) - n if begin is None else begin

    def __len__(self) -> int:
        return len(self.n)

    def taken(self, at: np.ndarray) -> Sets:
        return Sets(self.doc[at], self.line[at], self.n[at], self.key[spread(self.begin[at], self.n[at])])

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.add.reduceat(mix(self.key ^ salt), self.begin) if len(self) else np.zeros(0, U) for salt in (_ONE, _TWO))

    def arrays(self) -> list[np.ndarray]:
        """Frequent words go by two bytes of rank, others by eight of hash."""
        often = self.key >= FREQUENT
        rare = self.n - (np.add.reduceat(often.astype(np.int64), self.begin) if len(self) else 0)
        return [self.doc, self.line.astype(np.uint32), self.n.astype(np.uint32), rare.astype(np.uint32), self.key[~often], (self.key[often] >> RANK).astype(np.uint16)]

    def cut(self, a: int, b: int) -> Sets:
        """Sets a .. b - 1, where they stand without gaps."""
        return Sets(self.doc[a:b], self.line[a:b], self.n[a:b], self.key[self.begin[a] : self.begin[b - 1] + self.n[b - 1]])

    @staticmethod
    def parts(arrays: list[np.ndarray], edges: np.ndarray) -> Iterator[list[np.ndarray]]:
        """The arrays of the sets between each two edges that differ."""
        _, _, n, rare, hashes, ranks = arrays
        both = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[edges]
        eight = np.concatenate([[0], np.cumsum(rare, dtype=np.int64)])[edges]
        for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            yield [*(x[edges[k] : edges[k + 1]] for x in arrays[:4]), hashes[eight[k] : eight[k + 1]], ranks[both[k] - eight[k] : both[k + 1] - eight[k + 1]]]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> Sets:
        doc, line, n, rare, hashes, ranks = arrays
        n, rare = n.astype(np.int64), rare.astype(np.int64)
        often = spread(np.zeros(len(n), np.int64), n) >= np.repeat(rare, n)
        key = np.empty(len(often), U)
        key[~often], key[often] = hashes, FREQUENT | (ranks.astype(U) << RANK)
        return cls(doc, line.astype(np.int64), n, key)

    @classmethod
    def joined(cls, parts: list[Sets]) -> Sets:
        return cls(*(np.concatenate([getattr(s, c) for s in parts]) for c in ("doc", "line", "n", "key")))


def earliest(sets: Sets, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """For each set the place of its earliest equal, itself if it is that."""
    order = np.lexsort((sets.line, sets.doc, sets.n, two, one))
    a, b = order[:-1], order[1:]
    at = np.flatnonzero((one[a] == one[b]) & (two[a] == two[b]) & (sets.n[a] == sets.n[b]))
    m = sets.n[a[at]]
    if len(at):  # a signature is no proof
        differ = sets.key[spread(sets.begin[a[at]], m)] != sets.key[spread(sets.begin[b[at]], m)]
        at = at[~np.logical_or.reduceat(differ, np.cumsum(m) - m)]
    first = np.arange(len(order))
    first[at + 1] = 0
    out = np.empty(len(order), np.int64)
    out[order] = order[np.maximum.accumulate(first)]
    return out


def _line_sets(batches: Iterable[pa.RecordBatch], head: Head, least: int, count: int) -> Iterator[tuple]:
    """The distinct sets of each block, by signature, each with the lines that repeat it."""
    number = X.batch_ids()
    for chunk in chunks(batches, "text", BLOCK_BYTES):
        batch = next(number)
        lines = Lines(chunk)
        h, line = lines.hashes()
        if not len(h):
            continue
        key, line = token_sets(h, line, head)
        del h
        begin = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        own = line[begin]
        sets = Sets(lines.doc[own], lines.number[own].astype(np.int64), np.diff(np.append(begin, len(line))), key)
        del lines, line, key
        if least > 1:
            sets = sets.taken(np.flatnonzero(sets.n >= least))
        one, two = sets.signatures()
        to = earliest(sets, one, two)
        kept = np.flatnonzero(to == np.arange(len(sets)))
        bucket = X.bucket_of(one[kept], count)
        by = np.argsort(bucket, kind="stable")
        kept, bucket = kept[by], bucket[by]
        place = np.empty(len(sets), np.int64)
        place[kept] = np.arange(len(kept))
        copies = np.flatnonzero(to != np.arange(len(sets)))
        copies = copies[np.argsort(place[to[copies]], kind="stable")]
        doc, line, of = sets.doc[copies], sets.line[copies].astype(np.uint32), place[to[copies]]
        one, two, sets = one[kept], two[kept], sets.taken(kept).arrays()
        edges = np.searchsorted(bucket, np.arange(count + 1))
        ends = np.searchsorted(of, edges)
        parts = Sets.parts(sets, edges)
        for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            a, z, c, d = edges[b], edges[b + 1], ends[b], ends[b + 1]
            yield b, batch, SETS, X.pack(one[a:z], two[a:z], *next(parts), doc[c:d], line[c:d], (of[c:d] - a).astype(np.uint32), level=1)


def _collapse(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The earliest line of each set, and the others as its copies."""
    for _, held in X.runs(batches):
        blobs = [X.unpack(p) for *_, p in held]
        del held
        sets = Sets.of([np.concatenate([x[k] for x in blobs]) for k in range(2, 8)])
        base = np.cumsum([0, *(len(x[0]) for x in blobs)])
        one, two, doc, line, of = (np.concatenate([x[k] for x in blobs]) for k in (0, 1, 8, 9, 10))
        of = of.astype(np.int64) + np.repeat(base[:-1], [len(x[10]) for x in blobs])
        del blobs
        to = earliest(sets, one, two)
        later = np.flatnonzero(to != np.arange(len(sets)))
        doc, line, of = np.concatenate([sets.doc[later], doc]), np.concatenate([sets.line[later], line.astype(np.int64)]), to[np.concatenate([later, of])]
        other = (doc != sets.doc[of]) | (line != sets.line[of])
        if other.any():
            yield SURE, X.pack(doc[other], line[other], sets.doc[of[other]], sets.line[of[other]], level=1)
        kept = np.flatnonzero(to == np.arange(len(sets)))
        for a in range(0, len(kept), PACKED):
            yield SETS, X.pack(*sets.taken(kept[a : a + PACKED]).arrays(), level=1)


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload in batch.column("payload").to_pylist():
            yield _longs(*X.unpack(payload))


# 3. and 4. candidates


def _packed_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[Sets]:
    for batch in batches:
        for payload in batch.column("payload").to_pylist():
            yield Sets.of(X.unpack(payload))


def _together(parts: Iterable[Sets], most: int) -> Iterator[Sets]:
    """Sets regrouped so that about ``most`` stand together."""
    held: list[Sets] = []
    for x in parts:
        held.append(x)
        if sum(map(len, held)) >= most:
            yield Sets.joined(held)
            held = []
    if held:
        yield Sets.joined(held)


def _postings(batches: Iterable[pa.RecordBatch], num: int, den: int, count: int) -> Iterator[tuple]:
    """For each bucket of tokens the postings in order of bitmap width: six arrays, the bitmaps one after the other."""
    for sets in _together(_packed_sets(batches), PACKED):
        wides = words_wide(sets.n)
        sets, wides = sets.taken(by := np.argsort(wides, kind="stable")), wides[by]
        edges = np.flatnonzero(np.concatenate(([True], wides[1:] != wides[:-1], [True])))
        bits = np.concatenate([bitmaps((x := sets.cut(a, b)).key, x.n, int(wides[a])).ravel() for a, b in zip(edges[:-1], edges[1:], strict=True)])
        p = prefix(sets.n, num, den)
        who = np.repeat(np.arange(len(sets)), p)
        token = sets.key[spread(sets.begin, p)]
        bucket = X.bucket_of(mix(token), count)
        by = np.argsort(bucket.astype(np.uint16) if count <= 65536 else bucket, kind="stable")
        edges = np.searchsorted(bucket[by], np.arange(count + 1))
        who, wide = who[by], wides[who[by]]
        bits = bits[spread((np.cumsum(wides) - wides)[who], wide)].view(np.uint8)  # as bytes: those of a bitmap are of one kind
        ends = np.concatenate([[0], np.cumsum(8 * wide)])[edges]
        pos = spread(np.zeros(len(p), np.int64), p)[by].astype(np.uint32)
        token, n, doc, line = token[by], sets.n[who].astype(np.uint32), sets.doc[who], sets.line[who].astype(np.uint32)
        for r in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            at = slice(edges[r], edges[r + 1])
            yield r, 0, 0, X.pack(token[at], bits[ends[r] : ends[r + 1]], n[at], pos[at], doc[at], line[at], level=1)


def _fold(bits: np.ndarray, wide: int) -> np.ndarray:
    while bits.shape[1] > wide:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _shared(token: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Whether a posting's token, of those in order, has others that it is paired with."""
    if not len(token):
        return np.zeros(0, bool)
    start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    size = np.diff(np.append(start, len(token)))
    ones, twos = (np.add.reduceat((side == k).astype(np.int64), start) for k in (1, 2))
    return np.repeat(np.where(twos > 0, size > 1, (ones > 0) & (ones < size)), size)


class Postings:
    """Postings of lists, in order of token and number of tokens. Pairs are made of those of side 2, or of one side with the other."""

    FIELDS = ("token", "bits", "n", "pos", "doc", "line", "side")

    def __init__(self, *fields: np.ndarray) -> None:
        for name, x in zip(self.FIELDS, fields, strict=True):
            setattr(self, name, x)

    def taken(self, at: np.ndarray) -> Postings:
        return Postings(*(getattr(self, f)[at] for f in self.FIELDS))

    def ordered(self) -> Postings:
        return self.taken(np.lexsort((self.n, self.token)))

    def shared(self) -> Postings:
        """Without tokens that have one posting alone, or postings of one side alone, where tokens are in order."""
        return self.taken(_shared(self.token, self.side))

    def packed(self) -> bytes:
        return X.pack(np.array([self.bits.shape[1]]), *(getattr(self, f).ravel() for f in self.FIELDS), level=1)

    @classmethod
    def unpacked(cls, data: bytes) -> Postings:
        (wide,), token, bits, *rest = X.unpack(data)
        return cls(token, bits.reshape(-1, wide), *rest)


def _joint(token: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Values that sort as (token, n) do, for tokens already in order."""
    step = np.zeros(len(token), np.int64)
    step[1:] = token[1:] != token[:-1]
    return np.cumsum(step) * (1 << 32) + np.minimum(n, (1 << 32) - 1)


def _bits_at(bits: np.ndarray, begin: np.ndarray, wide: np.ndarray, own: int) -> np.ndarray:
    """The bitmaps that begin in these places, folded to ``own`` words."""
    if (wide == own).all():
        return bits[begin[:, None] + np.arange(own)]
    out = np.empty((len(begin), own), U)
    for w in np.unique(wide).tolist():
        at = wide == w
        out[at] = _fold(bits[begin[at, None] + np.arange(w)], own)
    return out


class Pairs:
    """Candidates and other rows on their way out of a task; pairs go packed by hash of the later line."""

    def __init__(self, count: int) -> None:
        self.count, self.held, self.size = count, [], 0

    def add(self, pairs: tuple[np.ndarray, ...]) -> Iterator[tuple]:
        self.held.append(pairs)
        self.size += len(pairs[0])
        if self.size > HELD:
            yield from self.sent()

    def sent(self) -> Iterator[tuple]:
        if self.size:
            doc, line, *rest = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held, self.size = [], 0
            for r, part in X.split(X.bucket_of(mix(mix(doc.view(U)) + line.astype(U)), self.count), self.count, doc, line, *rest):
                yield PAIR, r, None, X.pack(*part, level=1)


def _tiled(own: Postings, num: int, den: int, tile: int) -> tuple[Postings, Iterator[tuple]]:
    """Postings without those of long lists, and pieces of these with the tiles that each is part of."""
    start = np.flatnonzero(np.concatenate(([True], own.token[1:] != own.token[:-1])))
    size = np.diff(np.append(start, len(own.token)))
    long = np.flatnonzero(size > tile)
    if not len(long):
        return own, iter(())
    size_of = own.n.astype(np.int64)
    pieces = []
    for a, m in zip(start[long].tolist(), size[long].tolist(), strict=True):
        edges = [*range(a, a + m, tile // 2), a + m]
        number = np.arange(len(edges), dtype=U)
        seed = mix(own.token[a : a + 1] + U(own.bits.shape[1]))
        name = lambda i, j: int(mix(mix(seed + number[i : i + 1]) + number[j : j + 1])[0].astype(np.int64))  # noqa: B023, E731
        for k in range(len(edges) - 1):
            # a piece meets itself and later ones whose least n is not too large
            pieces.append((edges[k], edges[k + 1], 2, [name(k, k)]))
            reach = [j for j in range(k + 1, len(edges) - 1) if size_of[edges[j]] * num <= size_of[edges[k + 1] - 1] * den]
            before = [i for i in range(k) if size_of[edges[k]] * num <= size_of[edges[i + 1] - 1] * den]
            pieces += [(edges[k], edges[k + 1], side, tiles) for side, tiles in ((0, [name(k, j) for j in reach]), (1, [name(i, k) for i in before])) if tiles]

    def rows() -> Iterator[tuple]:
        for a, b, side, tiles in pieces:
            part = own.taken(np.arange(a, b))
            part.side = np.where(part.side == 2, side, part.side).astype(np.int8)
            yield PIECE, 0, tiles, part.packed()

    return own.taken(~np.isin(own.token, own.token[start[long]])), rows()


def candidates(own: Postings, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places (later line, earlier line) that pass the filters, and their bitmaps' distance; by later line and distance."""
    token, bits, n, pos, doc, line, side = (getattr(own, f) for f in own.FIELDS)
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    # the most tokens that a partner may have, for those left after the shared one to suffice
    most = (num + den) * (n - pos) // num - n
    # n rises within a list: partners of i end where the length filter or the positional filter does
    start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    end = np.repeat(np.append(start[1:], len(token)), np.diff(np.append(start, len(token))))
    reach = np.minimum(end, np.searchsorted(_joint(token, n), _joint(token, np.clip(np.minimum(den * n // num, most), 0, None)), side="right"))
    width = np.maximum(reach - np.arange(len(token)) - 1, 0)
    cut = np.cumsum(width)
    later, earlier, gap = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    a = 0
    while a < len(token):
        b = max(a + 1, int(np.searchsorted(cut, (cut[a - 1] if a else 0) + STEP, side="right")))
        i = np.repeat(np.arange(a, b), width[a:b])
        j = spread(np.arange(a + 1, b + 1), width[a:b])
        a = b
        ok = n[i] <= most[j]
        i, j = i[ok], j[ok]
        ok = ((side[i] != side[j]) | (side[i] == 2)) & ((doc[i] != doc[j]) | (line[i] != line[j]))
        i, j = i[ok], j[ok]
        far = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        ok = far <= n[i] + n[j] - 2 * need(n[i], n[j], num, den)
        i, j, far = i[ok], j[ok], far[ok]
        swap = (doc[i] > doc[j]) | ((doc[i] == doc[j]) & (line[i] > line[j]))
        later.append(np.where(swap, i, j))
        earlier.append(np.where(swap, j, i))
        gap.append(far)
    later, earlier, gap = np.concatenate(later), np.concatenate(earlier), np.concatenate(gap)
    order = np.lexsort((gap, later))
    return later[order], earlier[order], gap[order]


def _propose(own: Postings, num: int, den: int, first: int, out: Pairs) -> Iterator[tuple]:
    """The first candidates of each line, and the lists of lines that had more."""
    if not len(own.token):
        return
    a, b, gap = candidates(own, num, den)
    start = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(a)))
    take = spread(np.zeros(len(size), np.int64), size) < first
    yield from out.add((own.doc[a[take]], own.line[a[take]], own.doc[b[take]], own.line[b[take]], gap[take].astype(np.uint32)))
    more = a[start[size > first]]
    if len(more):
        yield LIST, 0, None, own.taken(np.isin(own.token, np.unique(own.token[more]))).packed()


def _meet(batches: Iterable[pa.RecordBatch], num: int, den: int, first: int, tile: int, count: int) -> Iterator[tuple]:
    out = Pairs(count)
    for _, held in X.runs(batches):
        blobs = [X.unpack(payload) for *_, payload in held]
        del held
        fields = {}
        for k in (1, 0, 2, 3, 4, 5):  # bitmaps first: they hold the payloads
            fields[k] = np.concatenate([x[k] for x in blobs])
            for x in blobs:
                x[k] = None
        token, bits, n, pos, doc, line = (fields.pop(k) for k in range(6))
        bits, wide = bits.view(U), words_wide(n.astype(np.int64))
        begin = np.cumsum(wide) - wide
        # many tokens of prefixes belong to one line alone; bitmaps are read of what is left only
        _, back, met = np.unique(token, return_inverse=True, return_counts=True)
        every = np.flatnonzero(met[back] > 1)
        every = every[np.argsort((back[every] << 32) | n[every])]
        size, widths = n[every].astype(np.int64), wide[every]
        for own in np.unique(widths).tolist():
            # lines of the next wider bitmap join those of this one that they can be similar to
            border = BITS * own
            near = every[((widths == own) | (widths == 2 * own)) & (size * den >= num * border) & (size * num <= den * border)]
            same = every[widths == own]
            for at, side in ((same, np.full(len(same), 2, np.int8)), (near, (wide[near] > own).astype(np.int8))):
                take = _shared(token[at], side)
                at, side = at[take], side[take]
                if len(at):
                    held = Postings(token[at], _bits_at(bits, begin[at], wide[at], own), n[at], pos[at], doc[at], line[at], side)
                    short, pieces = _tiled(held, num, den, tile)
                    yield from pieces
                    yield from _propose(short, num, den, first, out)
        del token, bits, n, pos, doc, line, back
    yield from out.sent()


def _tiles(batches: Iterable[pa.RecordBatch], num: int, den: int, first: int, count: int) -> Iterator[tuple]:
    out = Pairs(count)
    for _, held in X.runs(batches, "tile"):
        parts = [Postings.unpacked(data) for _, data in held]
        yield from _propose(Postings(*(np.concatenate([getattr(x, f) for x in parts]) for f in Postings.FIELDS)).ordered().shared(), num, den, first, out)
    yield from out.sent()


def _best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidate of least distance of each line."""
    for _, held in X.runs(batches):
        doc, line, other_doc, other_line, gap = (np.concatenate(x) for x in zip(*(X.unpack(p) for _, p in held), strict=True))
        order = np.lexsort((other_line, other_doc, gap, line, doc))
        doc, line = doc[order], line[order]
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])))
        yield _longs(doc[new], line[new], other_doc[order][new], other_line[order][new])


def _every(batches: Iterable[pa.RecordBatch], num: int, den: int, only: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """All pairs of the lines that the filter ``only`` holds: those found, and those that kept lists hold."""
    for batch in batches:
        for kind, data in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            if kind == PAIR:
                pairs = X.unpack(data)[:4]
            else:
                own = Postings.unpacked(data)
                a, b, _ = candidates(own, num, den)
                pairs = [own.doc[a], own.line[a], own.doc[b], own.line[b]]
            take = bloom.contains(only, *pairs[:2])
            yield _longs(*(x[take] for x in pairs))


def _longs(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], schema=_LONGS)


# 5. and 6. verification


def _sets_in(batches: Iterable[pa.RecordBatch], bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The sets of the lines that the filter lets through."""
    for sets in _packed_sets(batches):
        if bits is not None:
            sets = sets.taken(np.flatnonzero(bloom.contains(bits, sets.doc, sets.line)))
        doc, line, _, rare, hashes, ranks = sets.arrays()
        columns = [pa.array(doc, pa.int64()), pa.array(line, pa.int64())]
        for n, data in ((rare.astype(np.int64) * 8, hashes), ((sets.n - rare) * 2, ranks)):
            columns.append(pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.cumsum([0, *n]).astype(np.int32)), pa.py_buffer(data.tobytes())]))
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "line", "rare", "often"])


def _sets_of(kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """``doc_id, line, rare, often``: the token sets of all lines in ``pairs``, and of some others."""
    refs = pairs.select("doc_id", "line").unionAll(pairs.select("other_doc", "other_line"))
    bits = kept.sparkSession.sparkContext.broadcast(bloom.build(refs, 2 * pairs.count()))  # of bounded size
    return kept.where(F.col("kind") == SETS).mapInArrow(lambda it: _sets_in(it, bits.value), "doc_id long, line long, rare binary, often binary")


def _similar(batch: pa.RecordBatch, num: int, den: int) -> np.ndarray:
    """Whether the sets of each pair are similar; all pairs in one sort for each kind of word."""
    size, common = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
    for column, kind in (("rare", U), ("often", np.uint16)):
        owner, tokens = [], []
        for name in (column, f"other_{column}"):
            blobs = batch.column(name).to_pylist()
            n = np.array([len(x) // np.dtype(kind).itemsize for x in blobs])
            owner.append(np.repeat(np.arange(len(blobs), dtype=np.int64), n))
            tokens.append(np.frombuffer(b"".join(blobs), kind))
            size += n
        number = np.unique(np.concatenate(tokens), return_inverse=True)[1] if kind is U else np.concatenate(tokens)
        both = np.sort((np.concatenate(owner) << 32) | number.astype(np.int64))
        common += np.bincount(both[1:][both[1:] == both[:-1]] >> 32, minlength=len(batch))
    return den * common >= num * (size - common)


def _verified(kept: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sets are similar."""
    sets = materialize(_sets_of(kept, pairs))  # both sides are joined to it
    own = pairs.select(*COLUMNS).join(sets, ["doc_id", "line"])
    others = sets.select(F.col("doc_id").alias("other_doc"), F.col("line").alias("other_line"), F.col("rare").alias("other_rare"), F.col("often").alias("other_often"))

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(list(COLUMNS)).filter(pa.array(_similar(batch, num, den), pa.bool_()))

    out = materialize(own.join(others, ["other_doc", "other_line"]).mapInArrow(check, LONGS))
    discard(sets)
    return out


def later_matches(docs: DataFrame, num: int = 75, den: int = 100, least: int = 5, first: int = FIRST, tile: int = TILE) -> DataFrame:
    """``doc_id, line, other_doc, other_line``: each line to remove and an earlier one that it matches."""
    spark = prepare(docs.sparkSession)
    docs = stable(docs.select("doc_id", "text"))
    p, line = partitions(spark), ["doc_id", "line"]
    count = 2 * p
    order = spark.sparkContext.broadcast(frequent_words(docs))  # at most HEAD words
    met = X.routed(docs.mapInArrow(lambda it: X.rows(_line_sets(it, order.value, least, count)), X.ENVELOPE), p)
    kept = materialize(met.mapInArrow(lambda it: X.rows(_collapse(it), _KEPT), KEPT))
    del met
    reclaim(spark)
    sure = kept.where(F.col("kind") == SURE).mapInArrow(_unpacked, LONGS)
    sent = kept.where(F.col("kind") == SETS).mapInArrow(lambda it: X.rows(_postings(it, num, den, 2 * count)), X.ENVELOPE)
    found = materialize(X.routed(sent, p).mapInArrow(lambda it: X.rows(_meet(it, num, den, first, tile, p), _FOUND), FOUND))
    del sent
    reclaim(spark)
    tables, good = [kept, found], sure
    pieces = found.where(F.col("kind") == PIECE)
    if not pieces.isEmpty():
        dealt = pieces.select(F.explode("tiles").alias("tile"), "payload").repartition(p, "tile").sortWithinPartitions("tile")
        tables.append(materialize(dealt.mapInArrow(lambda it: X.rows(_tiles(it, num, den, first, p), _FOUND), FOUND)))
        found = found.unionAll(tables[-1])
    # the most similar candidate first, all others only of lines that it leaves
    pairs = found.where(F.col("kind") == PAIR).select("route", "payload").repartition(p, "route").sortWithinPartitions("route")
    best = materialize(pairs.mapInArrow(_best, LONGS))
    tables.append(best)
    if not best.isEmpty():
        good = good.unionAll(verified := _verified(kept, best, num, den))
        left = materialize(best.select(*line).join(verified.select(*line), line, "left_anti"))
        tables += [verified, left]
        if not left.isEmpty():
            asked = spark.sparkContext.broadcast(bloom.build(left))  # it lets some others propose too
            every = found.where(F.col("kind") != PIECE).mapInArrow(lambda it: _every(it, num, den, asked.value), LONGS)
            others = materialize(every.distinct())
            good = good.unionAll(verified := _verified(kept, others, num, den))
            tables += [others, verified]
    first_of = good.groupBy(*line).agg(F.min(F.struct("other_doc", "other_line")).alias("o"))
    out = materialize(first_of.select(*line, "o.other_doc", "o.other_line"))
    discard(*tables)
    reclaim(spark)
    return out


def dedup_lines(docs: DataFrame, **options: int) -> DataFrame:
    """``docs`` with the matched lines cut from ``text``; ``n_lines`` and ``removed`` (line numbers from 0) are added."""
    docs = stable(docs.drop("n_lines", "removed"))
    gone = materialize(later_matches(docs, **options).groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("removed")))
    none = F.array().cast("array<bigint>")
    lines = F.split("text", "\n", -1)
    size = F.coalesce(F.size(lines), F.lit(0)).alias("n_lines")
    hit = bloom.maybe_in(gone.select("doc_id"), "doc_id")
    same = docs.where(~hit).select(*docs.columns, size, none.alias("removed"))
    joined = docs.where(hit).join(gone.hint("shuffle_hash"), "doc_id", "left").withColumn("removed", F.coalesce("removed", none))
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col("removed"), i.cast("long")))
    text = F.when(F.size("removed") > 0, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text")
    return same.unionByName(joined.select(*(text if c == "text" else F.col(c) for c in docs.columns), size, "removed"))
