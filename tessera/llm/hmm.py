"""Hidden Markov language model over words.

*Counts.* Word counts of all training texts meet, packed by hash, in buckets
whose tables stay distributed; only totals reach the driver.

*Model.* K latent states emit any word of the training texts, END, or a word
never seen. A state's emissions are its expected counts with a prior of
``PRIOR`` tokens of the unigram distribution, which keeps one unit for the
unseen, so every text has a proper probability. The expected counts of a word
by state lie in the bucket of its hash; the driver holds starts, moves and sums
by state, whose size is fixed.

*Training.* Baum-Welch on ``sample`` training texts, the first by a hash of the
id, gives a first guess; ``passes`` over all training texts follow. In a pass
each block of texts asks the buckets for the expected counts of its distinct
words, runs the scaled forward-backward recursion and sends new ones back. How
a word's count parts among states goes to 16 bits, by which the model is defined.
A word goes once for a block, however often it occurs, so no word is hot.

*Scoring.* The same exchange, then the scaled forward recursion.

Null and empty texts consist of END alone. Rows without doc_id count as held
out. Without training texts the score is the base score. Repeated rows are
trained on and scored each time; other columns are ignored; an empty table
gives no rows. A text is never cut: a recursion goes over whole texts, and
needs some 100 bytes for each of a text's words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import exchange as X
from tessera.llm.session import discard, materialize, partitions, prepare, reclaim, stable
from tessera.llm.tokens import U, chunks, words

#: States; tokens of the prior of each; bytes of text in a block; tokens of it that a recursion goes over at once.
STATES, PRIOR, BLOCK_BYTES, STEP = 6, 50.0, 12 << 20, 1_400_000
#: Bytes of text that are counted at once.
COUNT_BYTES = 8 << 20
#: Counts of a bucket; words that a block asks for; its expected counts of them; a block; emissions for it; sums of a task.
COUNTS, WANT, GOT, BLOCK, EMIT, SUMS = range(6)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: Column, mod: int = 7, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == remainder, F.lit(True))


@dataclass
class Totals:
    """Training texts; tokens and distinct tokens, END included."""

    ends: int
    tokens: int
    kinds: int

    def base(self, count: np.ndarray) -> np.ndarray:
        """The unigram probability of words of these counts."""
        return (count + 1.0) / (self.tokens + self.kinds + 1.0)


@dataclass
class Chain:
    """A model without its emissions of words: expected tokens and ENDs by state, and a first guess of words if any."""

    start: np.ndarray
    move: np.ndarray
    total: np.ndarray
    end: np.ndarray
    guess: tuple[np.ndarray, np.ndarray] | None = None

    def emissions(self, expected: np.ndarray, base: np.ndarray) -> np.ndarray:
        return (expected + PRIOR * base[:, None]) / (self.total + PRIOR)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol by state


def shares(expected: np.ndarray) -> np.ndarray:
    """How expected counts (word by state) part among states, to 16 bits: half the bytes of floats, and most are 0 or 1."""
    return np.rint(expected * (65535 / np.maximum(expected.sum(axis=1, keepdims=True), 1e-300))).astype(np.uint16)


def counts_of(shares: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Expected counts of words of which so many are counted."""
    parts = shares.astype(np.float64)
    return parts * (total / np.maximum(parts.sum(axis=1), 1))[:, None]


def with_ends(symbols: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequences with END after each; where they begin, one more at the end."""
    n = len(at) - 1
    out = np.full(len(symbols) + n, end, np.int32)
    out[np.arange(len(symbols)) + np.repeat(np.arange(n), np.diff(at))] = symbols
    return out, at + np.arange(n + 1)


def _by_length(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of sequences from long to short, their begins, and how many are alive at each step."""
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    steps = np.arange(int(size.max()) if len(size) else 0)
    return order, at[:-1][order], np.searchsorted(-size[order], -steps, side="left")


def forward(model: Model, symbols: np.ndarray, at: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list, list]:
    """log10 likelihood of each sequence by the scaled forward recursion; alphas and scales by step where kept."""
    order, begin, alive = _by_length(at)
    total = np.zeros(len(order))
    alphas, scales = [], []
    alpha = None
    for t, n in enumerate(alive.tolist()):
        emitted = model.emit[symbols[begin[:n] + t]]
        alpha = emitted * (model.start if t == 0 else alpha[:n] @ model.move)
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:n] += np.log10(scale)
        if keep:
            alphas.append(alpha)
            scales.append(scale)
    out = np.empty(len(order))
    out[order] = total
    return out, alphas, scales


def expected(model: Model, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions (symbol by state)."""
    _, begin, alive = _by_length(at)
    _, alphas, scales = forward(model, symbols, at, keep=True)
    k = len(model.start)
    move = np.zeros((k, k))
    posterior = np.empty((len(symbols), k))
    beta = np.zeros((0, k))
    start = np.zeros(k)
    for t in range(len(alive) - 1, -1, -1):
        n = int(alive[t])
        here = np.ones((n, k))
        if t + 1 < len(alive):
            m = int(alive[t + 1])
            later = model.emit[symbols[begin[:m] + t + 1]] * beta / scales[t + 1][:, None]
            here[:m] = later @ model.move.T
            move += alphas[t][:m].T @ later
        beta = here
        posterior[begin[:n] + t] = alphas[t] * beta
        if t == 0:
            start = (alphas[0] * beta).sum(axis=0)
    emit = np.stack([np.bincount(symbols, posterior[:, s], minlength=len(model.emit)) for s in range(k)], axis=1)
    return start, move * model.move, emit


def maximised(start: np.ndarray, move: np.ndarray, emit: np.ndarray, base: np.ndarray, prior: float = PRIOR) -> Model:
    """Parameters from expected counts, with a prior of ``prior`` tokens of the unigram distribution for each state."""
    emit = emit + prior * base[:, None]
    move = move + 1.0
    start = start + 1.0
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def first_model(base: np.ndarray, states: int, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    emit = base[:, None] * rng.gamma(2.0, 0.5, (len(base), states))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9)
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _count(batches: Iterable[pa.RecordBatch], count: int) -> Iterator[tuple]:
    number = X.batch_ids()
    for chunk in chunks(batches, "text", COUNT_BYTES):
        batch = next(number)
        h, n = np.unique(words(chunk.column("text"))[0], return_counts=True)
        for b, (x, c) in X.split(X.bucket_of(h, count), count, h, n.astype(np.int64)):
            yield b, batch, COUNTS, X.pack(x, c, level=1)


def _total(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for route, held in X.runs(batches):
        blobs = [X.unpack(p) for *_, p in held]
        h, back = np.unique(np.concatenate([b[0] for b in blobs]), return_inverse=True)
        yield route, 0, COUNTS, X.pack(h, np.rint(np.bincount(back, np.concatenate([b[1] for b in blobs]))).astype(np.int64), level=1)


def _sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for payload in batch.column("payload").to_pylist():
            h, c = X.unpack(payload)
            yield int(c.sum()), len(h)


def count_words(docs: DataFrame) -> tuple[Totals, DataFrame]:
    """Totals of the training texts and the table of all counts, a row for each bucket."""
    p = partitions(docs.sparkSession)
    count = 4 * p
    train = docs.where(~held_out(F.col("doc_id"))).select("text")
    met = X.routed(train.mapInArrow(lambda it: X.rows(_count(it, count)), X.ENVELOPE), p)
    table = materialize(met.mapInArrow(lambda it: X.rows(_total(it)), X.ENVELOPE))
    kind = pa.schema([("n", pa.int64()), ("kinds", pa.int64())])
    sizes = table.select("payload").mapInArrow(lambda it: X.rows(_sizes(it), kind), "n long, kinds long")
    n, kinds = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    ends = train.count()
    return Totals(ends, n + ends, kinds + (ends > 0)), table


def _blocks(batches: Iterable[pa.RecordBatch], count: int) -> Iterator[tuple]:
    """Blocks of texts, training texts apart from others, and the words that each asks for."""
    number = X.batch_ids()
    for chunk in chunks(batches, "text", BLOCK_BYTES):
        out = np.asarray(chunk.column("held_out"))
        for part in (False, True):
            batch = next(number)
            own = chunk.filter(pa.array(out == part))
            if not len(own):
                continue
            h, at = words(own.column("text"))
            h, back = np.unique(h, return_inverse=True)
            edges = np.searchsorted(X.bucket_of(h, count), np.arange(count + 1))  # buckets follow the order of hashes
            ids = own.column("doc_id")
            yield count + X.route_of(batch, count), batch, BLOCK, part, X.pack(np.array(ids.fill_null(0).to_pylist(), np.int64), np.asarray(ids.is_valid()), at.astype(np.int64), back.astype(np.uint32), np.diff(edges).astype(np.uint32), level=1)
            for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                yield b, batch, WANT, part, X.pack(edges[b : b + 1], h[edges[b] : edges[b + 1]], level=1)


def first_guess(docs: DataFrame, states: int, sample: int, rounds: int) -> Chain:
    """Baum-Welch on a sample, over all its words."""
    usable = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text")
    chosen = usable.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = [r["text"] for r in usable.join(F.broadcast(chosen.distinct()), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    h, at = words(pa.array(texts, pa.string()))
    h, back = np.unique(h, return_inverse=True)
    symbols, at = with_ends(back.astype(np.int32), at, len(h))
    base = np.bincount(symbols, minlength=len(h) + 1) + 1.0
    base /= base.sum()
    model = first_model(base, states)
    size = np.full(states, len(symbols) / states)
    start, move, emit = model.start, model.move, model.emit * size
    for _ in range(rounds):
        start, move, emit = expected(model, symbols, at)
        model = maximised(start, move, emit, base)
    return Chain(model.start, model.move, emit.sum(axis=0), emit[-1], (h, emit[:-1]))


def _emissions(key: int, held: list[tuple], totals: Totals, chain: Chain | None, count: int) -> Iterator[tuple]:
    """What blocks ask for, expected counts by state and counts, from a bucket's counts and the expected counts that blocks sent to it."""
    table, c = np.zeros(0, U), np.zeros(0, np.int64)
    asked, got = {}, {}
    for _, batch, kind, payload in held:
        if kind == COUNTS:
            table, c = X.unpack(payload)
        elif kind == WANT:
            begin, h = X.unpack(payload)
            at = np.minimum(np.searchsorted(table, h), max(len(table) - 1, 0))
            asked[batch] = begin, at, table[at] == h if len(table) else np.zeros(len(h), bool)
        else:
            got[batch] = X.unpack(payload)
    k = len(chain.start) if chain else 0
    sums = np.zeros((len(table), k))
    if chain and chain.guess and len(table) and len(chain.guess[0]):
        h, e = chain.guess
        at = np.minimum(np.searchsorted(h, table), len(h) - 1)
        hit = h[at] == table
        sums[hit] = e[at[hit]]
    for batch, (e, n) in got.items():  # words of training texts all have counts, each once
        sums[asked[batch][1]] += counts_of(e.reshape(-1, k), n)
    for batch, (begin, at, hit) in asked.items():
        n, e = np.zeros(len(at), np.int64), np.zeros((len(at), k))
        n[hit], e[hit] = c[at[hit]], sums[at[hit]]
        yield count + X.route_of(batch, count), batch, EMIT, X.pack(begin, shares(e).ravel(), e.sum(axis=1).astype(np.float32), n, level=1)


def _gathered(held: list[tuple], totals: Totals, chain: Chain | None) -> Iterator[tuple]:
    """Blocks with their model and the counts of their words."""
    blocks: dict[int, list] = {}
    for _, batch, kind, payload in held:
        own = blocks.setdefault(batch, [None, []])
        if kind == BLOCK:
            own[0] = payload
        else:
            own[1].append(payload)
    for batch, (payload, parts) in blocks.items():
        ids, valid, at, back, sizes = X.unpack(payload)
        kinds, k = int(sizes.sum()), len(chain.start) if chain else 0
        n, model = np.zeros(kinds, np.int64), None
        emit = np.zeros((kinds + 1, k))
        for part in parts:
            (a,), e, total, c = X.unpack(part)
            if k:
                emit[a : a + len(c)] = counts_of(e.reshape(-1, k), total)
            n[a : a + len(c)] = c
        if chain:
            emit[:-1] = chain.emissions(emit[:-1], totals.base(n))
            emit[-1] = chain.emissions(chain.end[None], totals.base(np.array([totals.ends])))[0]
            model = Model(chain.start, chain.move, emit)
        yield batch, ids, valid, *with_ends(back.astype(np.int32), at, kinds), sizes, n, model


def _stretches(symbols: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole sequences of about STEP symbols together: the first and the last, symbols, and where each begins."""
    a = 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + STEP, side="right")) - 1)
        yield a, b, symbols[at[a] : at[b]], at[a : b + 1] - at[a]
        a = b


def _expect(batches: Iterable[pa.RecordBatch], totals: Totals, chain: Chain) -> Iterator[tuple]:
    sums = None
    for _, held in X.runs(batches, "batch"):
        for batch, _, _, symbols, at, sizes, _, model in _gathered(held, totals, chain):
            start = move = emit = 0.0
            for _, _, part, begins in _stretches(symbols, at):
                for_part = expected(model, part, begins)
                start, move, emit = start + for_part[0], move + for_part[1], emit + for_part[2]
            parts, n = shares(emit[:-1]), np.rint(emit[:-1].sum(axis=1)).astype(np.uint32)
            own = np.concatenate([start, move.ravel(), counts_of(parts, n).sum(axis=0) + emit[-1], emit[-1]])
            sums = own if sums is None else sums + own
            edges = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            for b in np.flatnonzero(sizes).tolist():
                yield b, batch, GOT, X.pack(parts[edges[b] : edges[b + 1]].ravel(), n[edges[b] : edges[b + 1]], level=1)
    if sums is not None:
        yield -1, 0, SUMS, X.pack(sums)


def _asked(buckets: list[DataFrame], totals: Totals, chain: Chain | None, p: int) -> DataFrame:
    met = X.routed(reduce(DataFrame.unionAll, buckets), p)
    shared = met.sparkSession.sparkContext.broadcast((totals, chain))
    return met.mapInArrow(lambda it: X.rows(r for key, held in X.runs(it) for r in _emissions(key, held, *shared.value, 4 * p)), X.ENVELOPE)


def train(docs: DataFrame, totals: Totals, table: DataFrame, blocks: DataFrame, states: int = STATES, sample: int = 600, rounds: int = 8, passes: int = 3) -> tuple[Chain, DataFrame | None]:
    """Baum-Welch from a sample's guess, over all training texts; the chain and the expected counts of words."""
    spark, p, k = docs.sparkSession, partitions(docs.sparkSession), states
    own = blocks.where("NOT part").drop("part")
    chain, got = first_guess(docs, states, sample, rounds), None
    before: list[DataFrame] = []
    for _ in range(passes):
        emissions = _asked([table, own.where(f"kind = {WANT}"), *([got] if got else [])], totals, chain, p)
        shared = spark.sparkContext.broadcast((totals, chain))
        met = X.routed(own.where(f"kind = {BLOCK}").unionAll(emissions), p)
        made = materialize(met.mapInArrow(lambda it, shared=shared: X.rows(_expect(it, *shared.value)), X.ENVELOPE))
        flat = np.sum([X.unpack(r["payload"])[0] for r in made.where(f"kind = {SUMS}").select("payload").collect()], axis=0)  # one row of fixed size for each task
        start, move = flat[:k] + 1.0, flat[k : k + k * k].reshape(k, k) + 1.0
        chain = Chain(start / start.sum(), move / move.sum(axis=1, keepdims=True), flat[-2 * k : -k], flat[-k:])
        discard(*before)
        del emissions, met
        reclaim(spark)  # else the pass's shuffle files stay on disk
        got, before = made.where(f"kind = {GOT}"), [made]
    return chain, got


def _finish(held: list[tuple], totals: Totals, chain: Chain | None) -> Iterator[tuple]:
    whole = np.log10(totals.tokens + totals.kinds + 1.0)
    for batch, ids, valid, symbols, at, _, c, model in _gathered(held, totals, chain):
        count = np.append(c, totals.ends)
        n = np.diff(at)
        base = np.add.reduceat(np.log10(count + 1.0)[symbols], at[:-1]) - n * whole
        known = np.add.reduceat((count > 0)[symbols].astype(np.int64), at[:-1])
        score = np.concatenate([forward(model, part, begins)[0] for _, _, part, begins in _stretches(symbols, at)]) if model else base
        for i in range(len(ids)):
            yield int(ids[i]) if valid[i] else None, batch % 2 == 1, int(n[i]), int(known[i]), totals.tokens, float(base[i]), float(score[i])


def score(docs: DataFrame, **options: int) -> DataFrame:
    """One row of SCHEMA for each row of ``docs(doc_id, text)``."""
    spark = prepare(docs.sparkSession)
    docs = stable(docs.select("doc_id", "text"))
    p = partitions(spark)
    totals, table = count_words(docs)
    fields = pa.schema([("route", pa.int64()), ("batch", pa.int64()), ("kind", pa.int32()), ("part", pa.bool_()), ("payload", pa.binary())])
    plain = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    blocks = materialize(plain.mapInArrow(lambda it: X.rows(_blocks(it, 4 * p), fields), "route long, batch long, kind int, part boolean, payload binary"))
    chain, got = train(docs, totals, table, blocks, **options) if totals.tokens else (None, None)
    every = blocks.drop("part")
    emissions = _asked([table, every.where(f"kind = {WANT}"), *([got] if got else [])], totals, chain, p)
    shared = spark.sparkContext.broadcast((totals, chain))
    kind = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])
    met = X.routed(every.where(f"kind = {BLOCK}").unionAll(emissions), p)
    # blocks of other than training texts have odd numbers
    return met.mapInArrow(lambda it: X.rows((r for _, held in X.runs(it, "batch") for r in _finish(held, *shared.value)), kind), SCHEMA)
