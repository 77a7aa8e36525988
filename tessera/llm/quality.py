"""Quality classifier: Bradley-Terry pairwise ranking.

Every text becomes a vector, computed over the whole text: statistics of its
bytes and words (lengths, repetition, shares of kinds of bytes), and how its
words and its stretches of four bytes spread over hash buckets. Among labelled
documents each pair of a good and a bad one is a preference; weights are fitted
by logistic loss on the difference of the two vectors, as in the Bradley-Terry
model, so a document's score is its strength.
The cut is the quantile of the training scores at the share of bad labels.

The fit is over all labelled rows that are not held out and over all pairs of
them. Their vectors are written once; each Newton step goes over them twice.
The first pass lays the strengths of either kind on a grid of ``GRID`` points a
unit; from it follows, for each strength, the sum over all documents of the
other kind, where the logistic function is interpolated between grid points
(relative error below 4e-6). The second sums the gradient, and the curvature by
``GROUPS`` groups of like strength, which only steers the steps. What comes to
the driver are sums, and of strengths those next to the cut. The cut is exact.

Null texts count as empty and are scored like any other; rows without doc_id
count as held out; labels that repeat (the higher counts) or are null do no
harm, and each row of a repeated doc_id counts; without labels of both kinds
every score is 0.5. Equal texts score alike, texts may be of any length, an
empty table gives no rows, and columns besides those named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import bloom
from tessera.llm import exchange as X
from tessera.llm.session import discard, materialize, prepare
from tessera.llm.tokens import U, chunks, hash_spans, mix, raw, spans

#: Texts that the fit works on at once.
STEP = 2000
#: Grid points of a unit of strength; parts of a document that may lie at either of its two points; groups of either kind.
GRID, PARTS, GROUPS = 256, 1 << 16, 32
#: Strengths among which the cut is looked up; cells in which a stretch with more of them is counted.
FEW, CELLS = 1 << 16, 1 << 12
#: Numbers of a sum that travel in one row; tasks in which the rows meet (a Newton step has five pieces).
PIECE, MEET = 1 << 16, 6
#: Statistics of a text; buckets of words, and of stretches of four bytes.
PLAIN, BUCKETS = 18, 256
FEATURES = PLAIN + 2 * BUCKETS

# Kinds of bytes: other symbols, small and capital letters, digits, blanks, newlines, marks of sentences, beyond ASCII.
OTHER, SMALL, CAPITAL, DIGIT, BLANK, NEWLINE, MARK, WIDE = KINDS = range(8)
_KIND = np.full(256, OTHER, dtype=np.int64)
for _kind, _set in ((SMALL, range(97, 123)), (CAPITAL, range(65, 91)), (DIGIT, range(48, 58)), (BLANK, b" \t\r\x0b\x0c"), (NEWLINE, b"\n"), (MARK, b".,;:!?'\"()-"), (WIDE, range(128, 256))):
    _KIND[list(_set)] = _kind


def _per(owner: np.ndarray, bucket: np.ndarray, n: int, kinds: int) -> np.ndarray:
    """How often each of ``kinds`` occurs with each of n owners."""
    return np.bincount(owner * kinds + bucket, minlength=n * kinds).reshape(n, kinds).astype(float)


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text: statistics of its bytes and words, and how its words and stretches spread over hash buckets."""
    buf, begins = raw(column)
    n = len(column)
    if not n:
        return np.zeros((0, FEATURES), np.float32)
    starts, ends = spans(buf)
    h = hash_spans(buf, starts, ends)
    at = np.searchsorted(starts, begins)
    owner, word_of = np.repeat(np.arange(n), np.diff(begins)), np.repeat(np.arange(n), np.diff(at))
    counts = _per(owner, _KIND[buf], n, len(KINDS))
    counts[:, NEWLINE] -= 1  # the one that stands after each text
    size, words = np.diff(begins) - 1.0, np.diff(at).astype(float)
    some = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(word_of, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(word_of, length**2, n) / some - mean**2, 0))
    # runs of equal words within a text
    key = np.sort((word_of.astype(U) << U(32)) | (h >> U(32)))
    run = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    run_of, times = (key[run] >> U(32)).astype(np.int64), np.diff(np.append(run, len(key)))
    most = np.zeros(n)
    np.maximum.at(most, run_of, times)
    again = (h[1:] == h[:-1]) & (word_of[1:] == word_of[:-1]) if len(h) else np.zeros(0, bool)
    tail = _KIND[buf[ends - 1]]
    letters = np.maximum(counts[:, SMALL] + counts[:, CAPITAL] + counts[:, WIDE], 1)
    plain = [np.log1p(words), np.log1p(size), counts[:, CAPITAL] / letters]
    plain += [counts[:, k] / np.maximum(size, 1) for k in (OTHER, DIGIT, BLANK, NEWLINE, MARK, WIDE)]
    plain += [np.minimum(mean, 40), np.minimum(spread, 40), np.bincount(run_of, minlength=n) / some, most / some, np.bincount(word_of[1:][again], minlength=n) / some]
    plain += [np.bincount(word_of, tail == k, n) / some for k in (OTHER, MARK, DIGIT)] + [np.bincount(word_of, length == 1, n) / some]
    padded = np.concatenate([buf, np.zeros(4, np.uint8)])
    four = mix(np.ndarray((len(buf),), "<u4", padded, strides=(1,)).astype(U))
    inside = np.arange(len(buf)) + 4 < begins[owner + 1]
    hashed = [_per(word_of, (h % U(BUCKETS)).astype(np.int64), n, BUCKETS), _per(owner[inside], (four[inside] % U(BUCKETS)).astype(np.int64), n, BUCKETS)]
    return np.concatenate([np.stack(plain, axis=1), *(np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1)) for x in hashed)], axis=1).astype(np.float32)


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for chunk in chunks(batches, "text"):
        yield from zip(chunk.column("doc_id").to_pylist(), (x.tobytes() for x in features(chunk.column("text"))), strict=True)


@dataclass
class Ranking:
    """A fitted Bradley-Terry model: strength(x) = weights . expand(x); the cut lies at strength 0."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def expanded(self, x: np.ndarray) -> np.ndarray:
        return expand((x - self.mean) / self.scale)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.expanded(x) @ self.weights - self.cut


def expand(z: np.ndarray) -> np.ndarray:
    """Statistics count by themselves, their squares and sizes; buckets by themselves."""
    z = np.clip(z, -8, 8)
    plain = z[:, :PLAIN]
    return np.concatenate([z, plain * plain / 4, np.abs(plain)], axis=1)


#: Vectors and labels; sums over all of them, array by array; counts n and m of all, by whole-number key.
Blocks = Iterable[tuple[np.ndarray, np.ndarray]]
Sums = Callable[[np.ndarray, np.ndarray], list[np.ndarray]]
Tally = tuple[np.ndarray, np.ndarray, np.ndarray]


def _added(blocks: Blocks, f: Sums) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for x, good in blocks:
        part = f(x, good)
        out = [a + b for a, b in zip(out, part, strict=True)] if out else part
    return out


def _tallied(parts: Iterable[Tally]) -> Tally:
    key, n, m = (np.concatenate(c) for c in zip(*parts, strict=True))
    key, at = np.unique(key, return_inverse=True)
    out = np.zeros((2, len(key)), np.int64)
    np.add.at(out[0], at, n)
    np.add.at(out[1], at, m)
    return key, *out


class Held:
    """Labelled vectors in memory."""

    def __init__(self, x: np.ndarray, good: np.ndarray) -> None:
        self.x, self.good = x, good

    def _blocks(self) -> Blocks:
        return ((self.x[a : a + STEP], self.good[a : a + STEP]) for a in range(0, len(self.x), STEP))

    def added(self, f: Sums) -> list[np.ndarray]:
        return _added(self._blocks(), f)

    def tallied(self, f: Callable[[np.ndarray, np.ndarray], Tally]) -> Tally:
        return _tallied(f(x, good) for x, good in self._blocks())


def _blocks(batches: Iterable[pa.RecordBatch]) -> Blocks:
    for batch in batches:
        if len(batch):
            yield np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, FEATURES), np.asarray(batch.column("quality"))


class Stored:
    """Labelled vectors in a table ``(quality, x)``. Each core sums what it reads; the sums meet by piece."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table.coalesce(int(table.sparkSession.conf.get("spark.sql.leafNodeDefaultParallelism")))

    def added(self, f: Sums) -> list[np.ndarray]:
        def part(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
            batch, piece = next(X.batch_ids()), 0
            for kind, a in enumerate(_added(_blocks(batches), f)):
                for at in range(0, a.size, PIECE):
                    yield piece, batch, kind, X.pack(a.ravel()[at : at + PIECE])
                    piece += 1

        def unite(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
            for piece, held in X.runs(batches):
                whole = X.unpack(held[0][-1])[0].astype(float)
                for *_, payload in held[1:]:
                    whole += X.unpack(payload)[0]
                yield piece, 0, held[0][2], X.pack(whole)

        met = X.routed(self.table.mapInArrow(lambda it: X.rows(part(it)), X.ENVELOPE), MEET)
        rows = sorted(met.mapInArrow(lambda it: X.rows(unite(it)), X.ENVELOPE).collect(), key=lambda r: r["route"])  # one for each piece
        return [np.concatenate([X.unpack(r["payload"])[0] for r in rows if r["kind"] == k]) for k in sorted({r["kind"] for r in rows})]

    def tallied(self, f: Callable[[np.ndarray, np.ndarray], Tally]) -> Tally:
        def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[Tally] = []
            for x, good in _blocks(batches):
                held = [_tallied([*held, f(x, good)])]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=["key", "n", "m"])

        met = self.table.mapInArrow(part, "key long, n long, m long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
        out = met.toArrow()  # one row for each key
        return _tallied([tuple(out.column(c).to_numpy() for c in ("key", "n", "m"))])


def _moments(x: np.ndarray, good: np.ndarray) -> list[np.ndarray]:
    x = x.astype(float)
    return [np.array([len(x) - good.sum(), good.sum()], float), x.sum(axis=0), (x * x).sum(axis=0)]


def _lay(s: np.ndarray, good: np.ndarray) -> Tally:
    """Each strength at the two grid points around it: of each kind and lower point the documents, and their parts at the upper."""
    at = np.floor(s * GRID)
    return _tallied([(2 * at.astype(np.int64) + good, np.ones(len(s), np.int64), np.rint((s * GRID - at) * PARTS).astype(np.int64))])


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


@dataclass
class Field:
    """How the strengths of either kind lie on the grid, and what all documents of one kind do to one of the other."""

    first: int
    share: np.ndarray  # by kind and grid point; sums to 1

    @classmethod
    def of(cls, tally: Tally) -> Field:
        key, n, m = tally
        at, good = key >> 1, key & 1
        first = int(at.min())
        share = np.zeros((2, int(at.max()) - first + 2))
        np.add.at(share, (good, at - first), n - m / PARTS)
        np.add.at(share, (good, at - first + 1), m / PARTS)
        return cls(first, share / share.sum(axis=1, keepdims=True))

    def _against(self, share: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """At each grid point t the mean of f(t - u) over the points u of a kind."""
        n = len(share)
        size = 1 << (3 * n).bit_length()
        kernel = np.fft.rfft(f(np.arange(1 - n, n) / GRID), size)
        return np.fft.irfft(np.fft.rfft(share, size) * kernel, size)[n - 1 : 2 * n - 1]

    def loss(self) -> float:
        return float(self.share[1] @ self._against(self.share[0], lambda d: _softplus(-d)))

    def pull(self) -> np.ndarray:
        """By kind and grid point: how often, by the model, a document there meets one of the other kind in the wrong order."""
        return np.maximum([self._against(self.share[1], lambda d: 1 / (1 + np.exp(-np.clip(d, -700, 700)))), self._against(self.share[0], lambda d: 1 / (1 + np.exp(np.clip(d, -700, 700))))], 0)

    def groups(self) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For either kind the upper edges of groups of like strength and their shares; the mean curvature of a pair by its groups (good, bad).

        Groups have like parts in the pull, so that they are narrow where documents are in the wrong order or near it.
        """
        weight = self.share * self.pull() + 1e-12 * self.share
        part = np.cumsum(weight, axis=1) / weight.sum(axis=1, keepdims=True)
        group = np.minimum(part * GROUPS, GROUPS - 1).astype(np.int64)
        edges = [(self.first + np.searchsorted(g, np.arange(1, GROUPS)) - 0.5) / GRID for g in group]
        mass = np.stack([np.bincount(g, c, GROUPS) for g, c in zip(group, self.share, strict=True)])
        bend = np.zeros((GROUPS, GROUPS))
        for k in np.flatnonzero(mass[0]):
            one = np.where(group[0] == k, self.share[0], 0)
            felt = np.maximum(self._against(one, lambda d: 0.25 / np.cosh(np.clip(d / 2, -300, 300)) ** 2), 0)
            bend[:, k] = np.bincount(group[1], felt * self.share[1], GROUPS) / np.maximum(mass[1], 1e-300) / mass[0][k]
        return edges, [mass[0], mass[1]], bend


def _slope(model: Ranking, field: Field, count: np.ndarray) -> Sums:
    """Sums for a Newton step: the gradient; vectors by kind and group; own part of the curvature, its upper triangle."""
    pull, (edges, mass, bend) = field.pull(), field.groups()
    own = [mass[1] @ bend / count[0], bend @ mass[0] / count[1]]  # of a bad, of a good document by its group
    upper = np.triu_indices(len(model.weights))

    def f(x: np.ndarray, good: np.ndarray) -> list[np.ndarray]:
        z = model.expanded(x.astype(float))
        s = z @ model.weights
        gradient, single = np.zeros(z.shape[1]), z.astype(np.float32)
        sums, h = np.zeros((2, GROUPS, z.shape[1]), np.float32), np.zeros(len(z), np.float32)
        for k in (0, 1):
            of = good == k
            gradient += (2 * k - 1) / count[k] * (np.interp(s[of] * GRID - field.first, np.arange(pull.shape[1]), pull[k]) @ z[of])
            group = np.searchsorted(edges[k], s[of], side="right")
            h[of] = own[k][group]
            member = np.zeros((GROUPS, len(group)), np.float32)
            member[group, np.arange(len(group))] = 1 / count[k]
            sums[k] = member @ single[of]
        return [gradient, sums.ravel(), ((single * h[:, None]).T @ single)[upper]]

    return f


def _step(model: Ranking, field: Field, sums: list[np.ndarray], ridge: float) -> np.ndarray:
    gradient, (bad, good), bend = sums[0], sums[1].reshape(2, GROUPS, -1).astype(float), field.groups()[-1]
    n = len(gradient)
    curvature = np.zeros((n, n))
    curvature[np.triu_indices(n)] = sums[2]
    curvature += np.triu(curvature, 1).T
    cross = good.T @ bend @ bad
    curvature += ridge * np.eye(n) - cross - cross.T
    return np.linalg.solve(curvature, gradient - ridge * model.weights)


def _quantile(data: Held | Stored, model: Ranking, tally: Tally, count: np.ndarray) -> float:
    """The quantile of all strengths at the share of bad labels: cells tell where it lies, finer ones if many strengths are left to look at."""
    at = (count.sum() - 1) * (count[0] / count.sum())

    def ranked(values: np.ndarray, n: np.ndarray) -> list:
        until = np.cumsum(n)
        return [values[min(np.searchsorted(until, k, side="right"), len(until) - 1)] for k in (int(at), int(at) + 1)]

    def within(cell: np.ndarray, n: np.ndarray) -> tuple[int, int, int]:
        low, high = ranked(cell, n)
        low, high = int(low) - 1, int(high) + 1  # a strength may come out otherwise by a rounding
        return low, high + 1, int(n[(cell >= low) & (cell <= high)].sum())

    low, high, left = within(tally[0] >> 1, tally[1])
    lower, upper = low / GRID, high / GRID
    for _ in range(3):  # then copies are what is left, or strengths at the brink of a gap
        if left <= FEW:
            break
        width = (upper - lower) / CELLS

        def lay(x: np.ndarray, good: np.ndarray, lower: float = lower, width: float = width) -> Tally:
            cell = np.clip(np.floor((model.strength(x.astype(float)) - lower) / width), -1, CELLS).astype(np.int64)
            return cell, np.ones(len(cell), np.int64), np.zeros(len(cell), np.int64)

        low, high, left = within(*data.tallied(lay)[:2])
        lower, upper = lower + low * width, lower + high * width

    def near(x: np.ndarray, good: np.ndarray) -> Tally:
        s = model.strength(x.astype(float)) + 0.0  # no negative zero
        s = np.where(s < lower, -np.inf, s)[s < upper]
        return s.view(np.int64), np.ones(len(s), np.int64), np.zeros(len(s), np.int64)

    key, n, _ = data.tallied(near)
    value = key.view(float)
    order = np.argsort(value)
    a, b = ranked(value[order], n[order])
    return float(a + (b - a) * (at - int(at)))


def _fit(data: Held | Stored, steps: int, ridge: float, enough: float = 1e-4) -> Ranking | None:
    sums = data.added(_moments)
    if not sums or not sums[0].all():
        return None
    count, mean = sums[0], sums[1] / sums[0].sum()
    spread = np.sqrt(np.maximum(sums[2] / count.sum() - mean**2, 0))
    scale = np.maximum(spread, np.where(np.arange(len(mean)) < PLAIN, 1e-6, 1e-3))

    def look(weights: np.ndarray) -> tuple[Ranking, Tally, Field, float]:
        m = Ranking(mean, scale, weights, 0.0)
        tally = data.tallied(lambda x, good: _lay(m.strength(x.astype(float)), good))
        field = Field.of(tally)
        return m, tally, field, field.loss() + ridge / 2 * float(weights @ weights)

    model, tally, field, loss = look(np.zeros(len(mean) + 2 * PLAIN))
    for _ in range(steps):
        step = _step(model, field, data.added(_slope(model, field, count)), ridge)
        then = look(model.weights + step)
        while then[-1] > loss + 1e-9 and np.abs(step).max() >= enough:
            step = step / 2
            then = look(model.weights + step)
        model, tally, field, loss = then
        if np.abs(step).max() < enough:
            break
    model.cut = _quantile(data, model, tally, count)
    return model


def fit(x: np.ndarray, good: np.ndarray, steps: int = 40, ridge: float = 1e-3) -> Ranking | None:
    """The model of all pairs of a good and a bad one among these vectors, by ``steps`` Newton steps at most; None without both kinds."""
    return _fit(Held(x, np.asarray(good).astype(np.int64)), steps, ridge)


def held_out(doc_id: Column, mod: int = 5, remainder: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == remainder, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, steps: int = 40, ridge: float = 1e-3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs(doc_id, text)``; ``labels(doc_id, quality)``."""
    prepare(docs.sparkSession)
    plain = docs.select("doc_id", "text")
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    kind = pa.schema([("doc_id", pa.int64()), ("x", pa.binary())])
    vectors = bloom.semi(plain, usable.select("doc_id"), "doc_id").mapInArrow(lambda it: X.rows(_measure(it), kind), "doc_id long, x binary")
    known = materialize(vectors.join(usable, "doc_id").select("quality", "x"))
    model = _fit(Stored(known), steps, ridge)
    discard(known)
    base = float(np.log(threshold / (1 - threshold)))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            s = 1 / (1 + np.exp(-np.clip(base + model.strength(features(chunk.column("text")).astype(float)), -30, 30))) if model else np.full(len(chunk), 0.5)
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id").cast(pa.int64()), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = plain.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
