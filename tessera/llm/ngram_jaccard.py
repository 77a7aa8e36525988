"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Two documents link when the Jaccard similarity of their distinct word shingles
reaches a threshold. A document of n shingles can only link when it shares at
least T = ceil(threshold * n) of them, which drives every step:

1. *Index.* Tasks hash the shingles of whole texts and send them, packed by
   hash bucket, to where each bucket's inverted lists meet. What comes back for
   each document are the shingles that other documents hold too, with the
   length of their lists. Documents with fewer than T of these are settled.
2. Documents with equal shingle sets become one representative; the index step
   runs again over representatives only.
3. *Lists.* Of T-1 longest lists of a document no partner can be found in
   those alone, so partners always meet in a shorter one. Lists that the same
   documents share count once.
4. *Search.* In a tile each document queries an inverted index: the short lists
   are merged and counted, documents that reach T - L go on to binary probes of
   the L long lists, and those that reach the required overlap are verified
   exactly. Documents already in one component are not compared again, so a tile
   returns a spanning forest of its links, never all pairs.
   First each document meets those with the same smallest document in their
   lists, in tiles of bounded size that all hold this document. Then every list
   that still holds several components is searched: its documents outside the
   list's largest component query all of the list, in pairs of pieces of bounded
   size if it is long. Sets are sent there only of documents whose length and
   bitmap leave them a partner of another component in that list.

Nulls, empty texts and texts without words have an empty set and link with
nothing; so do rows without doc_id, whose component is null. Rows that share a
doc_id are one document, which links by any of its texts. An empty table gives
no rows; texts may be of any length; ties do not arise, since all links count.
Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bloom
from tessera.llm import exchange as X
from tessera.llm.components import components
from tessera.llm.session import discard, materialize, partitions, prepare, stable
from tessera.llm.tokens import U, chunks, mix, words

BLOCK, REPLY = 0, 1
#: Documents of one side of a tile.
TILE = 1024
#: Documents of one side of a tile where bitmaps alone are compared; shingles to 64 bits of these.
LIGHT, SPARSE = 4096, 24
#: Weight of a probe against a merge step in the choice of L.
MU = 0.01

BITMAP = "doc_id long, n long, m long, bits binary"
PROFILE = "doc_id long, n long, s1 long, s2 long, shared binary"
_PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("shared", pa.binary())])


def required(n: int, num: int, den: int) -> int:
    """The least overlap of a set of n with any partner."""
    return -(-num * n // den)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, at = words(column)
    h = mix(h)
    steps = [U(pow(0x9E3779B97F4A7C15, j, 1 << 64)) for j in range(width)]
    full = np.zeros(max(0, len(h) - width + 1), dtype=U)
    for j, step in enumerate(steps):
        full += h[j : len(h) - width + 1 + j] * step if len(full) else full
    full = mix(full)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            order = np.array(steps[: b - a], dtype=U) * U(2 * (b - a) + 1)
            out.append(mix((h[a:b] * order).sum(keepdims=True, dtype=U)))
        else:
            out.append(np.zeros(0, dtype=U))
    return out


def _signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone."""
    if not len(s):
        return 0, 0
    return int(s.sum(dtype=U).astype(np.int64)), int(mix(s ^ U(0xA0761D6478BD642F)).sum(dtype=U).astype(np.int64))


def _send(ids: list[int | None], sets: list[np.ndarray], batch: int, count: int) -> Iterator[tuple]:
    sizes = np.array([len(s) for s in sets], dtype=np.uint32)
    known = np.array([i is not None for i in ids], dtype=bool)
    flat = np.concatenate([s for s, k in zip(sets, known, strict=True) if k] or [np.zeros(0, U)])
    doc = np.repeat(np.arange(len(sets), dtype=np.uint32)[known], sizes[known])
    sig = np.array([_signature(s) for s in sets], dtype=np.int64).reshape(-1, 2)
    yield count + X.route_of(batch, count), batch, BLOCK, X.pack(np.array([i or 0 for i in ids], dtype=np.int64), known, sizes, sig[:, 0], sig[:, 1])
    for b, (h, d) in X.split(X.bucket_of(flat, count), count, flat, doc):
        docs, per = np.unique(d, return_counts=True)
        yield b, batch, BLOCK, X.pack(docs, per.astype(np.uint32), h)


def _answer(key: int, held: list[tuple], count: int) -> Iterator[tuple]:
    """At a bucket: which hashes have lists of two documents or more. Other rows pass through."""
    if key >= count:
        yield from held
        return
    blobs = [(batch, *X.unpack(payload)) for _, batch, _, payload in held]
    flat = np.concatenate([h for *_, h in blobs])
    if not len(flat):
        return
    ordered = np.sort(flat)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    df = np.diff(np.append(first, len(ordered)))
    many = df > 1
    keys, df = ordered[first[many]], df[many]
    del ordered, flat
    if not len(keys):
        return
    for batch, docs, per, h in blobs:
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        if hit.any():
            d = np.repeat(docs, per)[hit]
            ids, n = np.unique(d, return_counts=True)
            yield count + X.route_of(batch, count), batch, REPLY, X.pack(ids, n.astype(np.uint32), h[hit], np.minimum(df[at[hit]], 2**32 - 1).astype(np.uint32))


def _assemble(held: list[tuple], num: int, den: int) -> Iterator[tuple]:
    """For each document of a block: its shared hashes and their list lengths, rarest first, if T can be reached."""
    blocks: dict[int, list] = {}
    for _, batch, kind, payload in held:
        blocks.setdefault(batch, [None, []])
        if kind == BLOCK:
            blocks[batch][0] = X.unpack(payload)
        else:
            blocks[batch][1].append(X.unpack(payload))
    for (ids, known, sizes, s1, s2), replies in blocks.values():
        got = np.zeros(len(ids), dtype=np.int64)
        for docs, per, _, _ in replies:
            np.add.at(got, docs, per)
        live = (got > 0) & (got * den >= num * sizes.astype(np.int64))
        cut: dict[int, np.ndarray] = {}
        if live.any():
            doc = np.concatenate([np.repeat(d, p) for d, p, _, _ in replies])
            h, df = np.concatenate([r[2] for r in replies]), np.concatenate([r[3] for r in replies])
            keep = live[doc]
            doc, h, df = doc[keep], h[keep], df[keep]
            order = np.lexsort((h, df, doc))
            doc, h, df = doc[order], h[order], df[order]
            edges = np.searchsorted(doc, np.arange(len(ids) + 1))
            cut = {i: (h[edges[i] : edges[i + 1]], df[edges[i] : edges[i + 1]]) for i in np.flatnonzero(live)}
        for i in range(len(ids)):
            yield int(ids[i]) if known[i] else None, int(sizes[i]), int(s1[i]), int(s2[i]), X.pack(*cut[i]) if i in cut else None


def _profile(envelopes: DataFrame, count: int, num: int, den: int) -> DataFrame:
    p = partitions(envelopes.sparkSession)

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return X.rows(r for key, held in X.runs(batches) for r in _answer(key, held, count))

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return X.rows((r for _, held in X.runs(batches, "batch") for r in _assemble(held, num, den)), _PROFILE)

    met = X.routed(envelopes, p).mapInArrow(answer, X.ENVELOPE)
    return X.routed(met, p).mapInArrow(assemble, PROFILE)


def profiles(docs: DataFrame, width: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """Set size, set signature and, where T can be reached, the shared shingles of each document."""
    count = 4 * partitions(docs.sparkSession)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[tuple]:
            number = X.batch_ids()
            for chunk in chunks(batches, "text"):
                yield from _send(chunk.column("doc_id").to_pylist(), shingle_sets(chunk.column("text"), width), next(number), count)

        return X.rows(items())

    return _profile(docs.select("doc_id", "text").mapInArrow(emit, X.ENVELOPE), count, num, den)


def _again(reps: DataFrame, num: int, den: int) -> DataFrame:
    """The index step over representatives and the shingles they still share."""
    count = 4 * partitions(reps.sparkSession)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[tuple]:
            number = X.batch_ids()
            for batch in chunks(batches, "shared", 8 << 20):
                sets = [np.sort(X.unpack(x)[0]) for x in batch.column("shared").to_pylist()]
                it = _send(batch.column("doc_id").to_pylist(), sets, b := next(number), count)
                _, _, _, head = next(it)
                ids, known, _, s1, s2 = X.unpack(head)
                yield count + X.route_of(b, count), b, BLOCK, X.pack(ids, known, np.array(batch.column("n").to_pylist(), dtype=np.uint32), s1, s2)
                yield from it

        return X.rows(items())

    return _profile(reps.select("doc_id", "n", "shared").mapInArrow(emit, X.ENVELOPE), count, num, den)


def _short_lists(batches: Iterable[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, keys = [], []
        for d, n, shared in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "shared")), strict=True):
            h, _ = X.unpack(shared)
            take = h[: len(h) - required(n, num, den) + 1]
            docs.append(np.full(len(take), d, dtype=np.int64))
            keys.append(take.view(np.int64))
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(docs))], names=["h", "doc_id"])


class _Sets:
    """Union-find over ids."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def divide_skip(queries: list[tuple], index: list[tuple], num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links between queries and index: a spanning forest of them.

    Items are (id, component, n, hashes rarest first). The items of one component count as linked.
    """
    ids = np.array([x[0] for x in index], dtype=np.int64)
    comps = np.array([x[1] for x in index], dtype=np.int64)
    ns = np.array([x[2] for x in index], dtype=np.int64)
    flat = np.concatenate([x[3] for x in index])
    owner = np.repeat(np.arange(len(index), dtype=np.int64), [len(x[3]) for x in index])
    order = np.argsort(flat, kind="stable")  # each inverted list stays in order of position
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    keys, ends = flat[first], np.append(first[1:], len(flat))
    sets = _Sets()
    for qid, comp, n, hashes in queries:
        need = required(n, num, den)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        at = at[keys[at] == hashes]
        if len(at) < need:
            continue
        lengths = ends[at] - first[at]
        rank = np.argsort(-lengths, kind="stable")
        at, lengths = at[rank], lengths[rank]
        skip = min(need - 1, ceil(need / (MU * log2(int(lengths[0]) + 1) + 1)))
        merged = np.concatenate([owner[first[k] : ends[k]] for k in at[skip:]])
        counts = np.bincount(merged, minlength=len(index))
        mine = sets.find(comp)
        fits = (counts >= need - skip) & (den * n >= num * ns) & (den * ns >= num * n)
        found = np.flatnonzero(fits)
        if len(found):
            found = found[[sets.find(int(c)) != mine for c in comps[found]]]
            found = found[ids[found] != qid]
        if not len(found):
            continue
        total = counts[found]
        for k in at[:skip]:
            long = owner[first[k] : ends[k]]
            p = np.minimum(np.searchsorted(long, found), len(long) - 1)
            total = total + (long[p] == found)
        for j in found[den * total >= num * (n + ns[found] - total)]:
            if sets.join(comp, int(comps[j])):
                yield qid, int(ids[j])


def _bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document the number of its shared shingles and a bitmap: bits that an odd number of them fall on.

    Shingles that two documents share cancel out, so bitmaps differ in no more bits than the sets in shingles.
    """
    for batch in batches:
        sets = [X.unpack(x)[0] for x in batch.column("shared").to_pylist()]
        bits = []
        for h in sets:
            size = 64 << max(0, ceil(log2(max(len(h), 1) / SPARSE)))
            bits.append(np.packbits(np.bincount((mix(h) & U(size - 1)).astype(np.int64), minlength=size) & 1 > 0).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), pa.array([len(h) for h in sets], pa.int64()), pa.array(bits, pa.binary())], names=["doc_id", "n", "m", "bits"])


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    while bits.shape[1] > size:
        bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
    return bits


def _near(batches: Iterable[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The documents of each list that length and bitmap allow to be similar to one of another component."""
    for _, held in X.runs(batches, "tile"):
        _, side, h, doc, comp, n, m, bits = zip(*held, strict=True)
        side, doc, comp, n, m = (np.array(x, np.int64) for x in (side, doc, comp, n, m))
        width = np.array([len(x) for x in bits])
        # bitmaps of one width stand together; rows are in order of n
        planes = {w: np.frombuffer(b"".join(x for x in bits if len(x) == w), np.uint8).reshape(-1, w) for w in set(width.tolist())}
        place = np.zeros(len(n), np.int64)
        for w in planes:
            place[width == w] = np.arange(int((width == w).sum()))
        flag = np.zeros(len(n), bool)
        for q in np.flatnonzero(side == 2).tolist():
            a, b = np.searchsorted(n, -(-num * n[q] // den)), np.searchsorted(n, den * n[q] // num, side="right")
            other = a + np.flatnonzero(comp[a:b] != comp[q])
            for w in np.unique(width[other]).tolist():
                at = other[width[other] == w]
                size = min(w, int(width[q]))
                own = _folded(planes[int(width[q])][place[q]][None], size)
                far = np.bitwise_count(_folded(planes[w][place[at]], size) ^ own).sum(axis=1, dtype=np.int64)
                hit = at[far <= m[at] + m[q] - 2 * -(-num * (n[at] + n[q]) // (num + den))]
                if len(hit):
                    flag[hit] = flag[q] = True
        if flag.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.array(h, np.int64)[flag]), pa.array(doc[flag])], names=["h", "doc_id"])


def _search(rows: DataFrame, num: int, den: int) -> DataFrame:
    """``rows(tile, side, doc_id, component, n, shared)``: links found in each tile. Side 0 queries, 1 is searched, 2 does both."""

    def tile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in X.runs(batches, "tile"):
            items = [(side, (d, c, n, X.unpack(s)[0])) for _, side, d, c, n, s in held]
            queries, index = [x for s, x in items if s != 1], [x for s, x in items if s != 0]
            if queries and index:
                links = list(divide_skip(queries, index, num, den))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

    p = partitions(rows.sparkSession)
    return rows.select("tile", "side", "doc_id", "component", "n", "shared").repartition(p, "tile").sortWithinPartitions("tile", "doc_id").mapInArrow(tile, "a long, b long")


def link_components(reps: DataFrame, num: int, den: int, tile: int = TILE) -> DataFrame:
    """``reps(doc_id, n, shared)``: edges ``(a, b)`` that connect exactly the documents linked directly or through others."""
    rows_of = F.count(F.lit(1))
    postings = materialize(reps.mapInArrow(lambda it: _short_lists(it, num, den), "h long, doc_id long"))
    marks = [F.bit_xor(F.xxhash64("doc_id", F.lit(k))).alias(f"mark{k}") for k in (0, 1)]
    lists = postings.groupBy("h").agg(F.min("doc_id").alias("head"), rows_of.alias("size"), *marks).where("size > 1")
    lists = lists.groupBy("size", "mark0", "mark1", "head").agg(F.min("h").alias("h"))
    members = materialize(postings.join(lists.select("h", "head", "size"), "h"))
    discard(postings)
    # around the smallest document of any of its lists
    home = materialize(members.groupBy("doc_id").agg(F.min("head").alias("block")))
    sizes = home.groupBy("block").agg(F.ceil(rows_of / F.lit(tile)).cast("long").alias("tiles"))
    cols = ["tile", "side", "doc_id", "component", "n", "shared"]
    own = home.join(sizes, "block").select("doc_id", F.xxhash64("block", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("tiles"))).alias("tile"))
    slots = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("slot")
    heads = sizes.select(F.col("block").alias("doc_id"), slots).select("doc_id", F.xxhash64("doc_id", "slot").alias("tile"))
    around = own.unionAll(heads).join(reps.select("doc_id", "n", "shared"), "doc_id")
    inner = materialize(_search(around.withColumns({"side": F.lit(2), "component": F.col("doc_id")}), num, den))
    # lists that still hold several components
    found = components(inner).withColumnRenamed("id", "doc_id")
    marked = members.join(found, "doc_id", "left").select("h", "size", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    per = marked.groupBy("h", "component").agg(rows_of.alias("c"))
    main = per.groupBy("h").agg(F.max_by("component", F.struct("c", "component")).alias("main"), rows_of.alias("kinds")).where("kinds > 1")
    rest = materialize(marked.join(main.drop("kinds"), "h"))
    discard(members, home)
    if rest.isEmpty():
        return inner
    bitmaps = materialize(reps.mapInArrow(_bitmaps, BITMAP))
    flagged = _tiled(rest, "size", LIGHT).join(bitmaps, "doc_id").select("tile", "side", "h", "doc_id", "component", "n", "m", "bits")
    flagged = flagged.repartition(partitions(reps.sparkSession), "tile").sortWithinPartitions("tile", "n", "doc_id").mapInArrow(lambda it: _near(it, num, den), "h long, doc_id long")
    rest = materialize(rest.drop("size").join(flagged.distinct(), ["h", "doc_id"]))
    if rest.isEmpty():
        return inner
    rest = rest.join(rest.groupBy("h").agg(rows_of.alias("size")), "h")
    rest = _tiled(rest, "size", tile).join(reps.select("doc_id", "n", "shared"), "doc_id").select(cols)
    return inner.unionAll(materialize(_search(rest, num, den)))


def _tiled(rows: DataFrame, size: str, tile: int) -> DataFrame:
    """``rows(h, doc_id, component, main)`` of each list dealt to pairs of pieces of about ``tile``; those outside the largest component ask."""
    pieces = F.ceil(F.col(size) / F.lit(tile)).cast("long")
    out = rows.withColumn("piece", F.pmod(F.xxhash64("doc_id", F.lit(11)), pieces)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    return out.withColumns({"tile": F.xxhash64("h", F.least("piece", "other"), F.greatest("piece", "other")), "side": F.when(F.col("component") == F.col("main"), 1).otherwise(2)})


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row ``(doc_id, n_shingles, component_id)`` for each row; documents link at ``den * overlap >= num * union``."""
    prepare(docs.sparkSession)
    prof = profiles(stable(docs.select("doc_id", "text")), width, num, den)
    # a row's number is given once, when the table is written; that of a set's first row names the set
    prof = materialize(prof.withColumn("rep", F.monotonically_increasing_id()))
    key = ["n", "s1", "s2"]
    live = prof.where(F.col("shared").isNotNull())
    copies = live.groupBy(*key).agg(F.min(F.struct("doc_id", "rep")).alias("o")).select(*key, "o.doc_id", "o.rep")
    copies = materialize(copies)
    # a row that the filter lets through by chance is one more set that links with its equal
    reps = bloom.semi(live, copies.select("rep"), "rep").select(F.col("rep").alias("doc_id"), "n", "shared")
    again = materialize(_again(reps, num, den).where(F.col("shared").isNotNull()))
    found = components(link_components(again, num, den)).withColumnRenamed("id", "rep")
    discard(again)
    # a component's id is its smallest document
    sets = copies.join(found, "rep", "left").withColumn("component", F.coalesce("component", -F.col("rep") - 1))
    least = sets.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    sets = sets.join(least, "component").select(*key, "component_id")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    out = materialize(prof.select("doc_id", *key).join(sets, key, "left").select("doc_id", F.col("n").alias("n_shingles"), own))
    discard(prof, copies)
    # a document of several texts joins the components of all
    several = out.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("b"), F.max("component_id").alias("c")).where("b < c")
    several = materialize(out.join(several, "doc_id").select(F.col("component_id").alias("a"), "b"))
    if several.isEmpty():
        return out
    merged = components(several).withColumnRenamed("id", "component_id")
    return out.join(merged, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id"))


def one_of_each(docs: DataFrame, **options: int) -> DataFrame:
    """The documents whose id is the smallest of their component, columns as they were; rows that repeat an id stay together, rows without id stay."""
    docs = stable(docs)
    gone = materialize(jaccard_components(docs, **options).where("component_id <> doc_id").select("doc_id"))
    return bloom.without(docs, gone)
