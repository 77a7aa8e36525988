"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word is the sum, over all ways to cut its bytes into
pieces, of the product of their probabilities; a forward recursion sums all
segmentations in one pass over the word. A text's score for a language is the
product over its words, and its prediction the language of highest posterior.

Piece probabilities are fitted by EM: expected piece counts come from forward
and backward sums. Fitting uses whole texts of about ``per_lang`` documents a
language, chosen by a hash of the id; every language is learned that has a word
in a text to learn from. Languages are fitted one after another, and beyond
``WIDE`` of them texts are scored in smaller blocks. Scoring covers every word
of every text over all pieces of the vocabulary; words longer than LONGEST bytes,
and such that are too unlikely for plain numbers, are summed in logarithms.

Null texts and texts without a letter are ``und`` with score 0. Rows without
doc_id or lang are not learned from. If no language can be learned, all is
``und``. Repeated rows are scored each time, ties go to the language that sorts
first, and an empty table gives no rows. Columns besides those three are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import vocabulary
from tessera.llm.exchange import release
from tessera.llm.session import prepare
from tessera.llm.tokens import U, chunks, hash_spans, mix, powers, raw, spans

#: Bytes of the longest word summed in plain numbers, and the least such sum.
LONGEST, LEAST = 64, 1e-250
#: Words held with their scores by a task; bytes of words summed over at once, and of texts.
CACHE, STEP, BLOCK_BYTES = 300_000, 1 << 16, 2 << 20
#: Languages up to which these hold; with more they fall in proportion.
WIDE = 64
UND = "und"
#: Probability of a piece where no language is spoken, by an equal share; in a language an unknown piece has ``floor`` by it.
NONE = 0.1
_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
_LETTERS = regex.compile(r"\p{L}+")


class Pieces:
    """The vocabulary as a hash table over the bytes of pieces."""

    BITS = 20

    def __init__(self, path: str) -> None:
        words = sorted(vocabulary(path))
        self.size = len(words)
        buf = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        self.keys = self._hash(buf, np.concatenate([[0], ends[:-1]]), ends)
        self.slot = np.full(1 << self.BITS, -1, dtype=np.int32)
        self.next = np.full(self.size, -1, dtype=np.int32)
        for i, s in enumerate((self.keys >> U(64 - self.BITS)).astype(np.int64)):
            self.next[i], self.slot[s] = self.slot[s], i
        self.lengths = np.array([len(w) for w in words])
        self.longest = int(self.lengths.max())

    @staticmethod
    def _hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = powers(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, dtype=U)
        np.cumsum(_VALUES[buf] * up[: len(buf)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))

    def find(self, h: np.ndarray) -> np.ndarray:
        at = self.slot[(h >> U(64 - self.BITS)).astype(np.int64)]
        out = np.full(len(h), -1, dtype=np.int32)
        todo = np.flatnonzero(at >= 0)
        at = at[todo]
        while len(todo):
            same = self.keys[at] == h[todo]
            out[todo[same]] = at[same]
            at, todo = self.next[at[~same]], todo[~same]
            go = at >= 0
            at, todo = at[go], todo[go]
        return out

    def lattice(self, words: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
        """Words of one matrix: for each length of piece, the (word, end, piece) that occur."""
        sizes = np.array([len(w) for w in words])
        buf = np.frombuffer(b"".join(words), np.uint8)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        up, down = powers(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, dtype=U)
        np.cumsum(_VALUES[buf] * up[: len(buf)], out=sums[1:])
        owner = np.repeat(np.arange(len(words)), sizes)
        offset = np.arange(len(buf)) - begin[owner]
        out = []
        left = sizes[owner] - offset
        at = np.arange(len(buf))
        for n in range(1, min(self.longest, int(sizes.max())) + 1):
            at = at[left[at] >= n]
            h = mix((sums[at + n] - sums[at]) * down[at] + U((n * 0x9E3779B97F4A7C15) % (1 << 64)))
            piece = self.find(h)
            hit = piece >= 0
            out.append((owner[at[hit]], offset[at[hit]] + n, piece[hit]))
        return sizes, out, begin


_VALUES = mix(np.arange(1001, 1257, dtype=U) * U(0x9E3779B97F4A7C15))


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _edges(table: Pieces, words: list[bytes]) -> tuple[np.ndarray, list[list[tuple]]]:
    """Sizes, and for each end position the edges (length, words, pieces) into it."""
    sizes, lattice, _ = table.lattice(words)
    at: list[list[tuple]] = [[] for _ in range(int(sizes.max()) + 1)]
    for n, (owner, end, piece) in enumerate(lattice, 1):
        order = np.argsort(end, kind="stable")
        owner, end, piece = owner[order], end[order], piece[order]
        cut = np.searchsorted(end, np.arange(len(at) + 1))
        for e in range(n, len(at)):
            if cut[e + 1] > cut[e]:
                at[e].append((n, owner[cut[e] : cut[e + 1]], piece[cut[e] : cut[e + 1]]))
    return sizes, at


def forward(table: Pieces, words: list[bytes], p: np.ndarray, growth: float = 24.0) -> tuple[np.ndarray, np.ndarray, list[list[tuple]]]:
    """alpha[e, word, lang]: the sum over all segmentations of the first e bytes, times growth ** e."""
    sizes, at = _edges(table, words)
    alpha = np.zeros((len(at), len(words), p.shape[1]))
    alpha[0] = 1
    scaled = p * growth ** table.lengths[:, None]
    for e in range(1, len(at)):
        for n, owner, piece in at[e]:
            alpha[e, owner] += alpha[e - n, owner] * scaled[piece]  # one piece of a length ends at e in a word
    return sizes, alpha, at


def log_sums(table: Pieces, word: bytes, logs: np.ndarray, back: bool = False) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """ln of the sums over all segmentations up to each byte, or from it on, by language; and the edges (end, length, piece)."""
    lattice = table.lattice([word])[1]
    end, size, piece = (np.concatenate(x) for x in zip(*((e, np.full(len(e), n), p) for n, (_, e, p) in enumerate(lattice, 1)), strict=True))
    to = end - size if back else end
    order = np.argsort(to, kind="stable")
    cut = np.searchsorted(to[order], np.arange(len(word) + 2))
    out = np.full((len(word) + 1, logs.shape[1]), -np.inf)
    out[len(word) if back else 0] = 0
    for e in range(len(word) - 1, -1, -1) if back else range(1, len(word) + 1):
        k = order[cut[e] : cut[e + 1]]
        if len(k):
            x = out[end[k] if back else (end - size)[k]] + logs[piece[k]]
            most = np.maximum(x.max(axis=0), -1e300)
            out[e] = most + np.log(np.exp(x - most).sum(axis=0))
    return out, (end, size, piece)


def _narrow(most: int, langs: int) -> int:
    return max(1, most * WIDE // max(WIDE, langs))


def _steps(words: list[bytes], order: np.ndarray, langs: int = 1) -> Iterator[np.ndarray]:
    """``order`` in stretches of about STEP bytes of words."""
    ends = np.cumsum([len(words[i]) for i in order]) // _narrow(STEP, langs)
    yield from np.split(order, np.flatnonzero(np.diff(ends)) + 1) if len(order) else ()


def word_scores(table: Pieces, words: list[bytes], p: np.ndarray, growth: float = 24.0) -> np.ndarray:
    """ln probability of each word in each language."""
    out = np.empty((len(words), p.shape[1]))
    length = np.array([len(w) for w in words])
    order = np.argsort(length, kind="stable")
    order, rest = order[: np.searchsorted(length[order], LONGEST, side="right")], list(np.flatnonzero(length > LONGEST))
    for part in _steps(words, order, p.shape[1]):  # words of like length together
        sizes, alpha, _ = forward(table, [words[i] for i in part], p, growth)
        sums = alpha[sizes, np.arange(len(part))]
        out[part] = np.log(np.maximum(sums, LEAST)) - sizes[:, None] * np.log(growth)
        rest += part[(sums < LEAST).any(axis=1)].tolist()
    logs = np.log(p) if rest else None
    for i in rest:
        out[i] = log_sums(table, words[i], logs)[0][-1]
    return out


def expected_counts(table: Pieces, words: list[bytes], weights: np.ndarray, p: np.ndarray, growth: float = 24.0) -> np.ndarray:
    """Expected number of each piece in the words of one language."""
    out = np.zeros(table.size)
    scaled = p * growth ** table.lengths[:, None]
    length = np.array([len(w) for w in words])
    order = np.argsort(length, kind="stable")
    order, rest = order[: np.searchsorted(length[order], LONGEST, side="right")], list(np.flatnonzero(length > LONGEST))
    for part in _steps(words, order):
        sizes, alpha, at = forward(table, [words[i] for i in part], p, growth)
        low = alpha[sizes, np.arange(len(part)), 0] < LEAST
        rest += part[low].tolist()
        beta = np.zeros_like(alpha)
        beta[sizes, np.arange(len(part))] = 1
        whole = alpha[sizes, np.arange(len(part)), 0]
        share = np.where(low, 0, weights[part] / np.maximum(whole, LEAST))
        for e in range(len(at) - 1, 0, -1):
            for n, owner, piece in at[e]:
                step = scaled[piece] * beta[e, owner]
                beta[e - n, owner] += step
                np.add.at(out, piece, (alpha[e - n, owner] * step)[:, 0] * share[owner])
    logs = np.log(p) if rest else None
    for i in rest:
        ahead, (end, size, piece) = log_sums(table, words[i], logs)
        behind, _ = log_sums(table, words[i], logs, back=True)
        np.add.at(out, piece, weights[i] * np.exp(ahead[end - size, 0] + logs[piece, 0] + behind[end, 0] - ahead[-1, 0]))
    return out


def words_of(text: str) -> list[bytes]:
    """Lower-case letter runs, each with a space before it."""
    return [(" " + w).encode() for w in _LETTERS.findall(text.lower())]


def fit(table: Pieces, texts: Iterable[tuple[str, list[str]]], rounds: int = 3, floor: float = 0.02) -> tuple[list[str], np.ndarray] | None:
    """Languages and piece probabilities, one column each; languages without a word have none."""
    langs, columns = [], []
    for lang, own in texts:
        counts = Counter(w for t in own for w in words_of(t))
        if not counts:
            continue
        words, weights = list(counts), np.array(list(counts.values()), dtype=float)
        q = np.full((table.size, 1), 1.0 / table.size)
        for _ in range(rounds):
            got = expected_counts(table, words, weights, q)
            q = ((1 - floor) * got / max(got.sum(), 1e-9) + floor / table.size)[:, None]
        langs.append(lang)
        columns.append(q[:, 0])
    return (langs, np.stack(columns, axis=1)) if langs else None


def _score(batches: Iterable[pa.RecordBatch], path: str, langs: list[str], p: np.ndarray, least: float | None = None) -> Iterator[pa.RecordBatch]:
    """Predictions; or, with ``least``, the rows themselves whose language is known with that score.

    The last column of ``p`` may be one of no language, for which ``langs`` has no name.
    """
    table = pieces(path)
    wide = p.shape[1]
    known, values, has = np.zeros(0, U), np.zeros((0, wide)), np.zeros(0, bool)
    for chunk in chunks(batches, "text", _narrow(BLOCK_BYTES, wide)):
        column = chunk.column("text")
        buf, begins = raw(column)
        starts, ends = spans(buf)
        h = hash_spans(buf, starts, ends)
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(known, distinct), max(len(known) - 1, 0))
        new = np.flatnonzero(known[at] != distinct) if len(known) else np.arange(len(distinct))
        # a word of the text may hold several letter runs, or none
        runs, owner = [], []
        data = buf.tobytes()
        for i, w in zip(new, first[new], strict=True):
            got = words_of(data[starts[w] : ends[w]].decode("utf-8", "replace"))
            runs += got
            owner += [i] * len(got)
        score, letters = np.zeros((len(distinct), wide)), np.zeros(len(distinct), bool)
        if len(known):
            old = known[at] == distinct
            score[old], letters[old] = values[at[old]], has[at[old]]
        if runs:
            kinds = {w: k for k, w in enumerate(dict.fromkeys(runs))}
            np.add.at(score, owner, word_scores(table, list(kinds), p)[[kinds[w] for w in runs]])
            letters[owner] = True
        if len(known) + len(new) > _narrow(CACHE, wide):
            known, values, has = distinct, score, letters
        elif len(new):
            merged = np.concatenate([known, distinct[new]])
            order = np.argsort(merged)
            known, values, has = merged[order], np.concatenate([values, score[new]])[order], np.concatenate([has, letters[new]])[order]
        cut = np.searchsorted(starts, begins)
        seen = np.concatenate([[0], np.cumsum(letters[back])])
        total, n = np.zeros((len(chunk), wide)), seen[cut[1:]] - seen[cut[:-1]]
        some = cut[1:] > cut[:-1]
        if some.any():  # text by text, so that a score does not depend on the block
            total[some] = np.add.reduceat(score[back], cut[:-1][some], axis=0)
        top = total - total.max(axis=1, keepdims=True)
        posterior = np.exp(top)
        posterior /= posterior.sum(axis=1, keepdims=True)
        best = posterior.argmax(axis=1)
        if least is not None:
            yield chunk.filter(pa.array((n > 0) & (best < len(langs)) & (posterior.max(axis=1) >= least)))
            continue
        names = [langs[b] if m else UND for b, m in zip(best, n, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [chunk.column("doc_id").cast(pa.int64()), pa.array(names, pa.string()), pa.array(np.where(n > 0, posterior.max(axis=1), 0.0))], schema=_OUT
        )
    del known, values, has
    release()


def held_out(doc_id: Column, mod: int = 4, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == remainder, F.lit(True))


def learn(docs: DataFrame, path: str, per_lang: int = 400) -> tuple[list[str], np.ndarray] | None:
    """Fit on ``docs(doc_id, text, lang)`` of the learning part, whatever the number of languages and of their rows."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    counts = usable.groupBy("lang").agg(F.count("*").alias("rows_of_lang"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = usable.join(F.broadcast(counts), "lang").where(part * F.col("rows_of_lang") < per_lang).select("lang", "text").orderBy("lang")
    by_lang = groupby(chosen.toLocalIterator(), key=lambda r: r["lang"])
    return fit(pieces(path), ((lang, sorted(r["text"] for r in rows)) for lang, rows in by_lang))


def identify(docs: DataFrame, path: str, **options: int) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs(doc_id, text, lang)``."""
    prepare(docs.sparkSession)
    model = learn(docs, path, **options)
    plain = docs.select("doc_id", "text")
    if model is None:
        scored = plain.select("doc_id", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        langs, p = model
        scored = plain.mapInArrow(lambda it: _score(it, path, langs, p), "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")



def accept(docs: DataFrame, path: str, least: float = 0.5, **options: int) -> DataFrame:
    """The rows of ``docs`` in a learned language with a score of ``least`` or more, columns as they were.

    Beside the learned languages stands one of no language, in which each piece has the ``NONE``-fold of an equal
    share: texts that it explains better, such as letters thrown together or scripts not learned, are in none of them.
    """
    prepare(docs.sparkSession)
    model = learn(docs, path, **options)
    if model is None:
        return docs.where(F.lit(False))
    langs, p = model
    p = np.column_stack([p, np.full(len(p), NONE / len(p))])
    return docs.mapInArrow(lambda it: _score(it, path, langs, p, least), docs.schema)
