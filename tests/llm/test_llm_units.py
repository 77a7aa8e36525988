"""Parts of the operators that need no Spark."""

from __future__ import annotations

import random
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import bloom, bpe, decontaminate, exchange, hmm, langid, line_dedup, ngram_jaccard, quality, topk
from tessera.llm import exchange as X
from tessera.llm.tokens import words

public = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}
TEXT = st.text(alphabet=list(" \t\n\r\x0b\x0caAbBéÉñ'1.,! 　\x1c\x85日😀"), max_size=40)


def column(texts):
    return pa.array(texts, pa.string())


@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
@settings(max_examples=60, deadline=None)
def test_equal_words_have_equal_hashes(texts):
    h, at = words(column(texts))
    want = [WORD.findall((t or "").translate(FOLD)) for t in texts]
    assert [int(n) for n in np.diff(at)] == [len(w) for w in want]
    flat = [w for x in want for w in x]
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))


def test_words_longer_than_a_window():
    h, at = words(column(["x" * 400_000 + " y", "X" * 400_000]))
    assert at.tolist() == [0, 2, 3] and h[0] == h[2] != h[1]


@given(st.lists(TEXT, max_size=6))
@settings(max_examples=100, deadline=None)
def test_words_hold_whole_pretokens(texts):
    buf, begins = bpe.raw(column(texts))
    if not len(buf):
        return
    starts, ends = bpe.word_starts(buf, begins, public.PATTERN)
    cut, data, find = np.searchsorted(starts, begins), buf.tobytes(), regex.compile(public.PATTERN).findall
    for i, text in enumerate(texts):
        own = [data[a:b].decode() for a, b in zip(starts[cut[i] : cut[i + 1]], ends[cut[i] : cut[i + 1]], strict=True)]
        assert "".join(own) == text
        assert [p for w in own for p in find(w)] == find(text)


def test_pack_round_trip():
    for level in (None, 1):
        a, b = X.unpack(X.pack(np.arange(5, dtype=np.uint32), np.zeros(0), level=level))
        assert a.tolist() == [0, 1, 2, 3, 4] and a.dtype == np.uint32 and len(b) == 0


def test_shingle_sets():
    a, b, c, d, e = ngram_jaccard.shingle_sets(column(["a b c d e f", "A  b\tc d e f a b c d e f", "a b", "b a", None]), 5)
    assert len(a) == 2 and len(b) == 6 and set(a) <= set(b)
    assert len(c) == 1 and len(d) == 1 and c[0] != d[0] and len(e) == 0


@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=14), min_size=2, max_size=14))
@settings(max_examples=80, deadline=None)
def test_divide_skip_connects_what_brute_force_does(sets):
    df = Counter(x for s in sets for x in s)
    items = [(i, i, len(s), np.array(sorted(s, key=lambda x: (df[x], x)), dtype=np.uint64)) for i, s in enumerate(sets)]
    links = list(ngram_jaccard.divide_skip(items, items, 75, 100))
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        assert 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
        up[max(root(a), root(b))] = min(root(a), root(b))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                assert root(a) == root(b)


@given(st.lists(st.lists(st.integers(0, 12), min_size=1, max_size=9), min_size=1, max_size=30), st.lists(st.integers(0, 14), min_size=1, max_size=20))
@settings(max_examples=80, deadline=None)
def test_block_max_wand_finds_all_above_threshold(items, query):
    texts = [(i, " ".join(f"w{x}" for x in item)) for i, item in enumerate(items)]
    index = decontaminate.Index(texts, 0.5)
    h, _ = words(column([" ".join(f"w{x}" for x in query)]))
    terms = np.unique(index.terms(h))
    terms = terms[terms >= 0]
    got = {}
    if len(terms):
        for _, block in zip(*index.open_blocks(terms, np.array([0])), strict=True):
            got |= {index.ids[i]: s for i, s in index.search(terms.tolist(), int(block))}
    n, mean = len(items), sum(map(len, items)) / len(items)
    df = Counter(x for item in items for x in set(item))

    def score(item, words_):
        tf = Counter(item)
        return sum(np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] / (tf[w] + 1.5 * (0.25 + 0.75 * len(item) / mean)) for w in words_ if w in tf)

    want = {i: s for i, item in enumerate(items) if (s := score(item, set(query))) >= 0.5 * score(item, set(item)) + 1e-6}
    assert set(want) <= set(got)
    assert all(abs(got[i] - s) < 1e-9 for i, s in want.items())


def test_forward_sums_all_segmentations():
    table = langid.pieces(public.path("byte_bpe_multi_50k.tiktoken"))
    p = np.random.default_rng(1).random((table.size, 2)) / table.size
    vocab = {w: i for i, w in enumerate(sorted(bpe.vocabulary(public.path("byte_bpe_multi_50k.tiktoken"))))}

    @cache
    def brute(word, k):
        if not word:
            return 1.0
        return sum(p[vocab[word[:n]], k] * brute(word[n:], k) for n in range(1, min(len(word), table.longest) + 1) if word[:n] in vocab)

    # the longest pieces, and words on both sides of the border to sums in logarithms
    names = [b" the", b" nation", "é".encode(), b"x", max(vocab, key=len), b" internationalization" * 3, b" internationalization" * 4]
    got = np.exp(langid.word_scores(table, names, p))
    for i, w in enumerate(names):
        assert got[i] == pytest.approx([brute(w, 0), brute(w, 1)], rel=1e-9)


def test_expected_piece_counts_cover_each_word():
    table = langid.pieces(public.path("byte_bpe_multi_50k.tiktoken"))
    q = np.full((table.size, 1), 1 / table.size)
    long = b" abc" * 20
    got = langid.expected_counts(table, [b" the", b" cat", long], np.array([2.0, 3.0, 1.0]), q)
    assert (got * table.lengths).sum() == pytest.approx(4 * 2 + 4 * 3 + 80)
    # a word counts alike by plain sums and by logarithms
    assert np.allclose(2 * langid.expected_counts(table, [long[:64]], np.array([1.0]), q), _by_logs(table, long[:64], q))


@pytest.mark.parametrize("lengths", [[3], [1, 4, 2, 4], [1, 1]])
def test_forward_backward_against_all_paths(lengths):
    from itertools import product

    rng = np.random.default_rng(3)
    k, v = 3, 4
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(v), k).T)
    symbols = rng.integers(0, v, sum(lengths)).astype(np.int32)
    at = np.concatenate([[0], np.cumsum(lengths)])
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((v, k))
    want = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        own = symbols[a:b]
        weights = {}
        for path in product(range(k), repeat=len(own)):
            w = model.start[path[0]] * model.emit[own[0], path[0]]
            for x, y, s in zip(path, path[1:], own[1:], strict=False):
                w *= model.move[x, y] * model.emit[s, y]
            weights[path] = w
        whole = sum(weights.values())
        want.append(np.log10(whole))
        for path, w in weights.items():
            start[path[0]] += w / whole
            for x, y in zip(path, path[1:], strict=False):
                move[x, y] += w / whole
            for s, y in zip(own, path, strict=True):
                emit[s, y] += w / whole
    assert hmm.forward(model, symbols, at)[0] == pytest.approx(want)
    got = hmm.expected(model, symbols, at)
    for x, y in zip(got, (start, move, emit), strict=True):
        assert x == pytest.approx(y)


def test_quality_learns_from_pairs():
    texts = ["Plain words make a sentence here, and another one follows it."] * 20 + ["buy buy buy buy buy buy"] * 20
    x = quality.features(column(texts)).astype(float)
    model = quality.fit(x, np.array([1] * 20 + [0] * 20), 500)
    s = model.strength(x)
    assert s[:20].min() > s[20:].max()
    assert quality.fit(x, np.ones(40), 10) is None
    assert np.isfinite(quality.features(column([None, "", "x" * 300_000]))).all()


def test_quality_fits_all_pairs(monkeypatch):
    rng = random.Random(4)
    kinds = ("plain words make sentences here and there".split(), "buy now win cash $$$ here and there".split())
    good = np.array([int(i % 5 > 0) for i in range(300)])
    x = quality.features(column([" ".join(rng.choice(kinds[rng.random() < (0.4, 0.6)[1 - k]]) for _ in range(9)) for k in good])).astype(float)
    model = quality.fit(x, good, 500)
    # at the optimum the gradient over all 240 x 60 pairs is that of the ridge
    z = model.expanded(x)
    s = z @ model.weights
    wrong = 1 / (1 + np.exp(s[good == 1][:, None] - s[good == 0][None, :]))
    gradient = wrong.mean(axis=1) @ z[good == 1] / 240 - wrong.mean(axis=0) @ z[good == 0] / 60
    assert gradient == pytest.approx(1e-3 * model.weights, abs=1e-6)
    assert np.abs(model.weights).max() > 1e-2
    assert model.cut == pytest.approx(np.quantile(s, 0.2), abs=1e-9)
    # through finer cells, too
    monkeypatch.setattr(quality, "FEW", 1, raising=False)
    monkeypatch.setattr(quality, "CELLS", 5, raising=False)
    assert quality.fit(x, good, 500).cut == model.cut


def test_best_keeps_ties_in_order():
    scores, ids = np.array([1, 5, 5, 2, 5, 5.0]), np.arange(10, 16)
    assert ids[topk._best(scores, ids, 3)].tolist() == [11, 12, 14]
    assert ids[topk._best(scores, ids, 9)].tolist() == [11, 12, 14, 15, 13, 10]


def test_prefix_and_overlap_bounds():
    n = np.arange(1, 200)
    assert (line_dedup.prefix(n, 75, 100) >= 1).all()
    a, b = np.meshgrid(n, n)
    over = line_dedup.need(a, b, 75, 100)
    assert (100 * over >= 75 * (a + b - over)).all() and (100 * (over - 1) < 75 * (a + b - over + 1)).all()


def _by_logs(table, word, q):
    ahead, (end, size, piece) = langid.log_sums(table, word, np.log(q))
    behind, _ = langid.log_sums(table, word, np.log(q), back=True)
    out = np.zeros(table.size)
    np.add.at(out, piece, 2 * np.exp(ahead[end - size, 0] + np.log(q)[piece, 0] + behind[end, 0] - ahead[-1, 0]))
    return out


def test_hash_of_equal_words_alike():
    texts = ["a" * 1000 + "b", "Z" * 300 + " z", "", None, "A" * 1000 + "B", "é" * 700, "a" * 1000 + "c", "short words of all sizes, eightsix and nineteens"]
    h, at = words(pa.array(texts))
    plain = [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))]
    assert len(h) == len(plain) == at[-1] and len(set(h.tolist())) == len(set(plain))
    assert all((h[i] == h[j]) == (plain[i] == plain[j]) for i in range(len(h)) for j in range(i))


def test_pack_keeps_arrays():
    arrays = [np.arange(5), np.array([], np.uint16), np.array([1.5, -2.0]), np.array([True, False]), np.array([2**63], np.uint64), np.arange(7, dtype=np.uint32)]
    for level in (None, 1):
        back = exchange.unpack(exchange.pack(*arrays, level=level))
        assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(arrays, back, strict=True))


def test_bloom_filter_by_size(spark):
    assert bloom.contains(None, np.arange(3)).all()
    for n in (3, 50_000):
        bits = bloom.build(spark.range(n).select((F.col("id") * 7).alias("id")))
        assert len(bits) * 8 >= min(n * bloom.PER_ROW, bloom.LEAST) and bloom.contains(bits, np.arange(n) * 7).all()
        assert bloom.contains(bits, np.arange(n) * 7 + 3).mean() < 0.05


def test_line_dedup_looks_each_word_up_once():
    """A block's words are looked up among the frequent ones once each, however often they occur; sets are those of brute force."""
    rng = np.random.default_rng(3)
    vocabulary = np.sort(rng.integers(1, 1 << 63, 50).astype(np.uint64) << np.uint64(1))
    h = vocabulary[rng.integers(0, 50, 5000)]
    line = np.sort(rng.integers(0, 300, 5000))
    asked = []

    class Head(line_dedup.Head):
        def ranks(self, x):
            asked.extend(x.tolist())
            return super().ranks(x)

    head = Head(vocabulary[::5], np.arange(10)[::-1].copy())
    key, at = line_dedup.token_sets(h, line, head)
    assert sorted(asked) == sorted(set(h.tolist()))
    rank = dict(zip(vocabulary[::5].tolist(), range(9, -1, -1), strict=True))
    of = {x: int(line_dedup.FREQUENT) | rank[x] << 40 if x in rank else x >> 1 for x in h.tolist()}
    assert list(zip(at.tolist(), key.tolist(), strict=True)) == sorted({(i, of[x]) for i, x in zip(line.tolist(), h.tolist(), strict=True)})


def test_line_dedup_postings_of_all_widths_go_together():
    """A bucket's postings are six arrays whatever the widths of their bitmaps, and hold each set's prefix with its own bitmap."""
    rng = np.random.default_rng(4)
    n = np.array([3, 100, 7, 1, 500, 49, 48, 2000, 5], np.int64)
    key = np.concatenate([np.sort(rng.choice(1 << 40, k, replace=False)) for k in n]).astype(np.uint64)
    sets = line_dedup.Sets(np.arange(len(n)), np.arange(len(n)) + 7, n, key)
    batch = pa.RecordBatch.from_pydict({"payload": [exchange.pack(*sets.arrays(), level=1)]})
    got = []
    for _, _, _, payload in line_dedup._postings([batch], 75, 100, 5):
        arrays = exchange.unpack(payload)
        assert len(arrays) == 6
        token, bits, size, pos, doc, line = arrays
        bits, a = bits.view(np.uint64), 0
        for row in zip(token.tolist(), size.tolist(), pos.tolist(), doc.tolist(), line.tolist(), strict=True):
            wide = int(line_dedup.words_wide(np.array([row[1]]))[0])
            got.append((*row, bits[a : a + wide].tolist()))
            a += wide
        assert a == len(bits)
    want = []
    for i, k in enumerate(n.tolist()):
        own = key[sets.begin[i] : sets.begin[i] + k]
        (bits,) = line_dedup.bitmaps(own, n[i : i + 1], int(line_dedup.words_wide(n[i : i + 1])[0])).tolist()
        want += [(int(own[j]), k, j, i, i + 7, bits) for j in range(int(line_dedup.prefix(n[i : i + 1], 75, 100)[0]))]
    assert sorted(got) == sorted(want)
