"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND.

Every training text is cut into overlapping passages, each long enough that any
item lies whole in one of them, and every passage is a query (of distinct
words) against the items. Items are numbered by rising threshold and cut into
blocks, so that a block's items have like thresholds. For each word and block
the index keeps the largest score of the word in the block. The sum of these
maxima over a passage's words bounds every item of the block: blocks whose
bound misses their least threshold are passed over, for many passages at once.
In the other blocks WAND finds the pivot, the first item that the maxima of
the lists before it allow to reach the threshold, and only pivots are scored.

An item is retrieved when its score reaches a share of the score it has
against itself. A retrieved item is verified against the passage by word
n-grams of its question and of its answer: the last line of an item of several
lines (five words at least), or else its last third of words, is the answer.

Items are indexed in parts of about ``part`` items, so that what is sent to
the executors is bounded however large the benchmark; number of items, mean
length and document frequencies are those of all items, so that parts find
what one index would. Each part takes a scan of the texts. Null or wordless
texts and items match nothing; an item without id matches with a null id, as
does a document without one, which ``clean`` keeps; repeated items each match;
repeated documents each get rows; texts of any length are searched whole;
columns other than the ids and texts are ignored; an empty side gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bloom
from tessera.llm import exchange as X
from tessera.llm.session import materialize, prepare
from tessera.llm.tokens import U, chunks, hash_spans, mix, raw, spans

K1, B = 1.5, 0.75
#: Items of a block; words of an n-gram; words of an answer at least.
BLOCK, GRAM, SHORT = 8, 3, 5
SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("first_word", pa.int64())])
_STEPS = [U(pow(0x9E3779B97F4A7C15, j, 1 << 64)) for j in range(GRAM)]


def grams(h: np.ndarray) -> np.ndarray:
    """Distinct hashes of the n-grams of words; the words themselves if there are fewer than n."""
    if len(h) < GRAM:
        return np.unique(h)
    return np.unique(mix(sum(h[j : len(h) - GRAM + 1 + j] * _STEPS[j] for j in range(GRAM))))


@dataclass
class Statistics:
    """Number and mean length of all items, and in how many of them each of some words occurs (words in rising order)."""

    items: int
    mean: float
    words: np.ndarray
    df: np.ndarray


class Index:
    """BM25 over items, with the maxima of blocks of items."""

    def __init__(self, items: list[tuple[int | None, str]], share: float, every: Statistics | None = None) -> None:
        buf, begins = raw(pa.array([t or "" for _, t in items], pa.string()))
        starts, ends = spans(buf)
        h = hash_spans(buf, starts, ends)
        at = np.searchsorted(starts, begins)
        lengths = np.diff(at)
        n = len(items)
        mean = max(1.0, every.mean if every else float(lengths.mean()))
        self.longest = int(lengths.max())
        self.words, term = np.unique(h, return_inverse=True)
        item = np.repeat(np.arange(n), lengths)
        pair, tf = np.unique(term * n + item, return_counts=True)
        term, item = pair // n, pair % n
        df = every.df[np.searchsorted(every.words, self.words)] if every else np.bincount(term, minlength=len(self.words))
        idf = np.log(1 + ((every.items if every else n) - df + 0.5) / (df + 0.5))
        score = idf[term] * tf / (tf + K1 * (1 - B + B * lengths[item] / mean))
        need = share * np.bincount(item, score, minlength=n)
        need[lengths == 0] = np.inf
        # items by rising threshold
        order = np.argsort(need, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.need, item = need[order] - 1e-9, place[item]
        self.ids = [items[i][0] for i in order]
        self.question, self.answer = [], []
        for i in order:
            own, text = h[at[i] : at[i + 1]], items[i][1] or ""
            line = text.rstrip("\n").rfind("\n")
            cut = int(np.searchsorted(starts[at[i] : at[i + 1]], begins[i] + len(text[:line].encode()))) if line > 0 else ceil(len(own) * 2 / 3)
            cut = max(0, min(cut, len(own) - SHORT))
            self.question.append(grams(own[:cut] if cut >= SHORT else own))
            self.answer.append(grams(own[cut:]))
        by = np.lexsort((item, term))
        self.item, self.score = item[by], score[by]
        self.begin = np.searchsorted(term[by], np.arange(len(self.words) + 1))
        self.blocks = ceil(n / BLOCK)
        self.most = np.zeros((len(self.words), self.blocks), dtype=np.float32)
        np.maximum.at(self.most, (term, item // BLOCK), score.astype(np.float32))
        self.least = self.need[::BLOCK].astype(np.float32) - 1e-4

    def terms(self, h: np.ndarray) -> np.ndarray:
        """The number of each word's list, or -1."""
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, -1)

    def open_blocks(self, terms: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) for which the block's maxima reach its least threshold; passages are runs of distinct terms."""
        bound = np.add.reduceat(self.most[terms], begin, axis=0)
        return np.nonzero(bound >= self.least)

    def search(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        """WAND within a block: the items that reach their threshold."""
        lists = []
        for t in terms:
            if (most := self.most[t, block]) > 0:
                a = bisect_left(self.item, block * BLOCK, self.begin[t], self.begin[t + 1])
                b = bisect_left(self.item, (block + 1) * BLOCK, a, self.begin[t + 1])
                lists.append([self.item[a:b].tolist(), self.score[a:b].tolist(), 0, float(most)])
        out = []
        while lists:
            lists.sort(key=lambda c: c[0][c[2]])
            total, pivot = 1e-4, -1
            for k, c in enumerate(lists):
                total += c[3]
                if total >= self.need[c[0][c[2]]]:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = lists[pivot][0][lists[pivot][2]]
            if lists[0][0][lists[0][2]] == doc:
                score = 0.0
                for c in lists:
                    if c[0][c[2]] != doc:
                        break
                    score += c[1][c[2]]
                    c[2] += 1
                if score >= self.need[doc]:
                    out.append((doc, score))
            else:
                for c in lists[:pivot]:
                    c[2] = bisect_left(c[0], doc, c[2])
            lists = [c for c in lists if c[2] < len(c[0])]
        return out


def _overlap(part: np.ndarray, seen: np.ndarray) -> float:
    return float(np.isin(part, seen, assume_unique=True).mean()) if len(part) else 1.0


def _find(batches: Iterable[pa.RecordBatch], index: Index, question: float, answer: float) -> Iterator[tuple]:
    window = max(64, 2 * index.longest)
    stride = window // 2
    width = len(index.words)
    for chunk in chunks(batches, "text"):
        buf, begins = raw(chunk.column("text"))
        starts, ends = spans(buf)
        h = hash_spans(buf, starts, ends)
        del buf
        cut = np.searchsorted(starts, begins)
        terms = index.terms(h)
        sizes = np.diff(cut)
        per = np.where(sizes > 0, np.maximum(1, -(-(sizes - stride) // stride)), 0)  # passages of each text
        doc = np.repeat(np.arange(len(sizes)), per)
        first = cut[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * stride
        last = np.minimum(first + window, cut[doc + 1])
        best: dict[tuple[int, int], tuple] = {}
        step = max(1, 4_000_000 // (window * index.blocks))
        for a in range(0, len(doc), step):
            s, e = first[a : a + step], last[a : a + step]
            n = e - s
            at = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            t = terms[at]
            pair = np.unique((np.repeat(np.arange(len(s)), n) * width + t)[t >= 0])
            if not len(pair):
                continue
            owner, distinct = pair // width, pair % width
            run = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            edge = np.append(run, len(owner))
            for k, block in zip(*(x.tolist() for x in index.open_blocks(distinct, run)), strict=True):
                passage = a + int(owner[run[k]])
                for item, score in index.search(distinct[edge[k] : edge[k + 1]].tolist(), block):
                    seen = np.union1d(grams(h[first[passage] : last[passage]]), h[first[passage] : last[passage]])
                    q, r = _overlap(index.question[item], seen), _overlap(index.answer[item], seen)
                    key = (int(doc[passage]), item)
                    if q >= question and r >= answer and (key not in best or score > best[key][0]):
                        best[key] = (score, q, r, int(first[passage] - cut[key[0]]))
        ids = chunk.column("doc_id").to_pylist()
        for (i, item), (score, q, r, word) in sorted(best.items()):
            yield ids[i], index.ids[item], score, q, r, word


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, question: float = 0.6, answer: float = 0.4, part: int = 2_000) -> DataFrame:
    """One row for each document and item of which it holds question and answer, with its best passage.

    ``docs(doc_id, text)``, ``benchmark(item_id, text)``: doc_id, item_id, score, question_overlap,
    answer_overlap, first_word (of the passage).
    """
    spark: SparkSession = prepare(docs.sparkSession)
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", F.lower("text").alias("text"))
    parts = max(1, ceil(items.count() / part))
    dealt, words, whole = items.withColumn("part", F.lit(0)), None, None
    if parts > 1:
        dealt = materialize(items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))))
        words = materialize(dealt.mapInArrow(_item_words, "part long, h long, n long"))
        whole = (dealt.count(), float(words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
        words = materialize(words.join(words.groupBy("h").agg(F.count(F.lit(1)).alias("df")), "h").select("part", "h", "df").distinct())
    out = None
    for k in range(parts):
        rows = dealt.where(F.col("part") == k).select("item_id", "text").collect()  # one part
        held = sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        if not held:
            continue
        every = None
        if whole:
            df = sorted((r["h"] & 0xFFFFFFFFFFFFFFFF, r["df"]) for r in words.where(F.col("part") == k).collect())  # the words of one part
            every = Statistics(whole[0], whole[1] / whole[0], np.array([h for h, _ in df], U), np.array([n for _, n in df], np.int64))
        index = spark.sparkContext.broadcast(Index(held, share, every))
        found = docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(lambda it, x=index: X.rows(_find(it, x.value, question, answer), _OUT), SCHEMA)
        out = found if out is None else out.unionAll(found)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def _item_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's distinct words with their number of occurrences."""
    for batch in batches:
        buf, begins = raw(batch.column("text"))
        starts, ends = spans(buf)
        h, at = hash_spans(buf, starts, ends), np.searchsorted(starts, begins)
        for i, k in enumerate(batch.column("part").to_pylist()):
            distinct, n = np.unique(h[at[i] : at[i + 1]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([int(k)] * len(n), pa.int64()), pa.array(distinct.view(np.int64)), pa.array(n.astype(np.int64))], names=["part", "h", "n"])


def clean(docs: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """The documents that hold no item, columns as they were."""
    return bloom.without(docs, materialize(leaks(docs, benchmark, **options).select("doc_id").distinct()))
