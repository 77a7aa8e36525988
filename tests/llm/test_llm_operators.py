"""Operators on small tables against brute force, with odd rows throughout."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import numpy as np
import pyarrow as pa
from tessera.llm import bpe, components, decontaminate, exchange, hmm, langid, line_dedup, ngram_jaccard, quality, registry, sharding, topk, url_filter

public = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}
#: Names that operators use inside.
CLASH = ("route", "batch", "kind", "payload", "n", "h", "component", "shared", "removed", "n_lines", "rep", "x", "score", "size", "shard", "slice", "held_out", "verdict", "tokens")
SCHEMA = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASH)


def made(seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re") for b in ("", "ta", "so", "vi", "du")]
    texts = []
    for _ in range(n):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(1, 5))]
        texts.append("\n".join(lines))
    for i in range(n // 3):  # near copies, and copies
        w = texts[i].split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
        texts.append(texts[i].upper() if i % 2 else texts[i])
    texts += [None, "", "  \n\t", "one two", "ONE\ttwo", "x " * 5_000, "z" * 50_000, "\n\n", " a é 日本"]
    return list(enumerate(texts, 5))


@pytest.fixture(scope="module")
def odd(spark):
    rows = made()
    rows += [rows[3], (None, "no id here at all today")]  # a repeated row and one without id
    df = spark.createDataFrame([(i, t, "en" if i is None or i % 3 else None, *("c",) * len(CLASH)) for i, t in rows], SCHEMA)
    return rows, df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text):
    return WORD.findall((text or "").translate(FOLD))


def shingles(text):
    w = tokens(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def roots(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(200, x) for x in range(201, 240)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots(300, edges)
    assert got == {i: want[i] for i in {x for e in edges if e[0] != e[1] for x in e}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("tile", [3, 1024])
def test_ngram_jaccard(odd, spark, monkeypatch, tile):
    """Rows without id and ids with several texts included."""
    monkeypatch.setattr(ngram_jaccard.link_components, "__defaults__", (tile,))
    monkeypatch.setattr(ngram_jaccard, "LIGHT", tile)
    rows, df = odd
    rng = random.Random(9)
    more = [(rng.choice([2, 7, 300, 301, None]), rng.choice(rows)[1]) for _ in range(25)] + [(400, None), (400, "")]
    rows = rows + more
    df = df.select("doc_id", "text", "component", "rep").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    sets = [shingles(t) for _, t in rows]
    place = {i: k for k, i in enumerate(sorted({i for i, _ in rows if i is not None}))}
    usable = [k for k in range(len(rows)) if rows[k][0] is not None and sets[k]]
    links = [(place[rows[a][0]], place[rows[b][0]]) for a in usable for b in usable if b < a and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want, ids = roots(len(place), links), sorted(place)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(df).collect()), key=str)
    assert got == sorted(((i, len(sets[k]), None if i is None else ids[want[place[i]]]) for k, (i, _) in enumerate(rows)), key=str)


def test_ngram_jaccard_of_an_id_with_two_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    out = ngram_jaccard.jaccard_components(spark.createDataFrame([(1, a), (1, b), (2, b + " x"), (3, a + " y")], "doc_id long, text string"))
    assert {(r["doc_id"], r["component_id"]) for r in out.collect()} == {(1, 1), (2, 1), (3, 1)}


def test_ngram_jaccard_copies_stay_linear(spark, monkeypatch):
    """Texts that share a passage without linking: no sets are sent for the lists of its shingles."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"{rng.randrange(40)}" for _ in range(60))) for i in range(120)]
    sent = []
    search = ngram_jaccard._search
    monkeypatch.setattr(ngram_jaccard, "_search", lambda rows, *a: sent.append(rows.count()) or search(rows, *a))
    out = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.where("component_id <> doc_id").count() == 0 and sum(sent) <= 3 * len(rows)


def test_one_of_each_keeps_columns(odd, empty):
    _, df = odd
    kept = ngram_jaccard.one_of_each(df)
    assert kept.columns == df.columns and 0 < kept.count() < df.count() and kept.where("doc_id IS NULL").count() == 1
    assert ngram_jaccard.jaccard_components(empty).count() == 0


def test_line_dedup(odd, empty):
    rows, df = odd
    seen, want = {}, {}
    for i, t in sorted({r for r in rows if r[0] is not None}):
        for k, line in enumerate((t or "").split("\n")):
            z = frozenset(tokens(line))
            if len(z) >= 5:
                if any(100 * len(z & y) >= 75 * len(z | y) for y in seen.values()):
                    want.setdefault(i, []).append(k)
                seen[i, k] = z
    out = line_dedup.dedup_lines(df).collect()
    assert len(out) == len(rows)
    assert {r["doc_id"]: r["removed"] for r in out if r["removed"]} == want
    texts = dict(rows)
    for r in out:
        t = texts[r["doc_id"]]
        kept = t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(want.get(r["doc_id"], ())))
        assert r["text"] == kept and r["x"] == "c"
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("first, tile", [(1, 4096), (64, 8), (2, 16)])
def test_line_dedup_candidates_and_pieces(spark, first, tile):
    """However few candidates a line proposes and however long lists are cut, all matches are found and no others."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(20)]
    lines = [" ".join(base[:14] + [f"u{k}a{j}" for j in range(6)]) for k in range(12)]
    lines.append(" ".join(base[:14] + ["v1", "v2", "v3", "u3a0", "u3a1", "u3a2"]))
    common = [f"c{i}" for i in range(12)]
    for _ in range(150):
        lines.append(" ".join(rng.sample(common, rng.randrange(1, 9))))
    for _ in range(60):
        w = [f"b{i}" for i in range(60)]
        for _ in range(rng.randrange(9)):
            w[rng.randrange(60)] = f"y{rng.randrange(30)}"
        lines.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    sets = [set(x.split()) for x in lines]
    want = {i for i in range(len(lines)) if any(100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in range(i))}
    assert {r["doc_id"] for r in line_dedup.later_matches(df, least=1, first=first, tile=tile).collect()} == want


def test_line_dedup_compares_sets(spark):
    """Lines that agree in part of a hash alone stay."""
    rows = [(0, "s62 beta gamma delta v657813"), (1, "s62 beta gamma delta v1549852")]
    assert line_dedup.later_matches(spark.createDataFrame(rows, "doc_id long, text string"), least=1).count() == 0
    sets = line_dedup.Sets(np.arange(3), np.zeros(3, np.int64), np.full(3, 2), np.array([5, 9, 5, 9, 5, 8], np.uint64))
    same = np.ones(3, np.uint64)
    assert line_dedup.earliest(sets, same, same).tolist()[:2] == [0, 0] and line_dedup.earliest(sets, same, same)[2] == 2


def test_block_numbers_spread_over_routes():
    for partitions in (8, 200, 1024):
        count = 4 * partitions
        routes = {exchange.route_of(p << 32, count) for p in range(partitions)}
        assert len(routes) >= 0.6 * min(partitions, count)


def test_bpe_round_trip(odd, empty):
    rows, df = odd
    path = public.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.decode(bpe.encode(df, path, public.PATTERN), path).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        t = texts[r["doc_id"]] or ""
        assert r["ids"] == enc.encode_ordinary(t) and bytes(r["decoded"]) == t.encode() and r["n_tokens"] == len(r["ids"])
    assert bpe.decode(bpe.encode(empty, path, public.PATTERN), path).count() == 0


def test_sharding(odd, empty, spark):
    rows, df = odd
    out = sharding.shard(df, 8).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in rows)
    texts = dict(rows)
    for r in out:
        b = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(b) + 16, zlib.crc32(b), "bytes", None)
    for s in range(8):
        own = sorted(r["slot"] for r in out if r["shard"] == s)
        assert own == list(range(len(own)))
    assert sharding.shard(empty, 8).count() == 0
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.repeat(F.lit("ab "), (F.col("id") % 40).cast("int"))).alias("text"))
    sizes = [r["s"] for r in sharding.shard(many, 8).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    # groups of a quarter of a share stay whole
    assert len(sizes) == 8 and max(sizes) < 1.05 * sum(sizes) / 8


def test_sharding_keeps_groups_whole(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 500).cast("string")).alias("text"))
    split = lambda out: out.groupBy("text_crc32").agg(F.countDistinct("shard").alias("n")).where("n > 1").count()
    assert split(sharding.shard(df, 4)) == 0
    # groups of most of a share, too; only one that no shard could hold is cut
    few = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.least(F.floor(F.col("id") / 50), F.lit(9)).cast("string")).alias("text"))
    assert split(sharding.shard(few, 10)) == 1


def test_quality(spark, odd, empty):
    rows, df = odd
    good = [(i, "Here is a plain sentence, number %d, about the weather." % i, None) for i in range(1000, 1200)]
    bad = [(i, "win win win!!! $$$ " * (i % 7 + 3), None) for i in range(1200, 1400)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string").unionByName(df.select("doc_id", "text", "lang"))
    labels = spark.createDataFrame([(i, int(i < 1200)) for i, *_ in good + bad] + [(1000, 1), (None, 1), (7, None)], "doc_id long, quality int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(rows) + 400
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["doc_id"] is not None and r["doc_id"] >= 1000:
            assert r["predicted"] == int(r["doc_id"] < 1200)
    assert {r["score"] for r in quality.classify(df, labels.where("doc_id < 0")).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0


def test_quality_learns_from_all_labelled_rows(spark):
    # more than 20,000 labelled rows; one kind of bad text is only among the last by a hash of their ids
    n = 28_000
    learned = spark.range(n).where(~quality.held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").toArrow()["id"].to_pylist()
    assert len(learned) > 22_000
    late = set(learned[20_000:])
    text = lambda i: "A plain sentence %d about the casino." % (i % 97) if i in late else "win win win!!! $$$ %d" % (i % 97) if i % 9 == 0 else "A plain sentence %d about the weather." % (i % 97)
    rows = [(i, text(i), int(i not in late and i % 9 > 0)) for i in range(n)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    out = {r["doc_id"]: r for r in quality.classify(table.select("doc_id", "text"), table.select("doc_id", "quality")).collect()}
    assert [i for i, _, q in rows if out[i]["predicted"] != q] == []
    # the same model as from all those rows in memory
    at = set(learned)
    own = [r for r in rows if r[0] in at]
    model = quality.fit(quality.features(pa.array([t for _, t, _ in own])), np.array([q for *_, q in own]))
    few = own[::500] + own[-5:]
    strength = model.strength(quality.features(pa.array([t for _, t, _ in few])).astype(float))
    assert [out[i]["score"] for i, *_ in few] == pytest.approx(1 / (1 + np.exp(-strength - math.log(0.3 / 0.7))), abs=1e-4)


def test_langid(spark, odd, empty):
    words = {"aa": "wolken himmel regen straße über".split(), "bb": "ciel nuage pluie été très".split()}
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(12)), k) for i in range(240) for k in [("aa", "bb")[i % 2]]]
    extra = [(1001, None, "aa"), (1002, "", "bb"), (1003, "12 !! 34", "aa"), (1004, "Regen", None), (1005, "été " * 9000, None), (None, "pluie", "bb")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    path = public.path("byte_bpe_multi_50k.tiktoken")
    out = {r["doc_id"]: r for r in langid.identify(df, path).collect()}
    assert len(out) == len(rows) + len(extra)
    assert all(out[i]["lang_pred"] == k for i, _, k in rows)
    assert [out[i]["lang_pred"] for i in (1001, 1002, 1003, 1004, 1005, None)] == ["und", "und", "und", "aa", "bb", "bb"]
    assert all(0 <= r["score"] <= 1 for r in out.values())
    kept = langid.accept(df, path)
    assert kept.columns == df.columns and kept.count() == len(rows) + 3
    none = [(2001, "слово о полку и быстрая лиса", None), (2002, "快速的棕色狐狸跳过懒狗", None), (2003, "qzx wvkj xqpt zzkw jqxv bnqk", None), (2004, "Himmel über Wolken", None)]
    assert [r["doc_id"] for r in langid.accept(df.unionByName(spark.createDataFrame(none, df.schema)), path).where("doc_id > 2000").collect()] == [2004]
    assert langid.identify(empty, path).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd[1].withColumn("lang", F.lit(None).cast("string")), path).collect()} == {"und"}


def test_hmm_counts_and_base(odd, empty):
    rows, df = odd
    out = hmm.score(df, sample=20, rounds=2).collect()
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in tokens(t))
    counts[None] = len(train)
    n, v = sum(counts.values()), len(counts)
    texts = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        own = [*tokens(texts[r["doc_id"]]), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        assert math.isfinite(r["score"]) and r["score"] <= 0
    assert hmm.score(empty).count() == 0


def test_hmm_against_one_block(spark):
    """Counts and base scores by hand; scores by the same passes over all texts at once."""
    from tessera.llm.tokens import words

    rng = random.Random(12)
    texts = [" ".join(f"{t}{rng.randrange(30)}" for _ in range(rng.randrange(1, 30))) for _ in range(40) for t in "xyz"] + [None, "", "never seen"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learns = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for i in learns for w in tokens(texts[i]))
    whole, kinds = sum(counts.values()) + len(learns), len(counts) + 1
    chain = hmm.first_guess(df, hmm.STATES, 10, 4)
    names = list(counts)
    hashes = words(pa.array([" ".join(names)]))[0]
    number = {w: k for k, w in enumerate(names)}
    base = np.array([(counts[w] + 1) / (whole + kinds + 1) for w in names])
    guess = dict(zip(chain.guess[0].tolist(), chain.guess[1], strict=True))
    wanted = np.array([guess.get(h, np.zeros(hmm.STATES)) for h in hashes.tolist()])

    def model(unseen=False):
        rest = [(len(learns) + 1) / (whole + kinds + 1), 1 / (whole + kinds + 1)]
        emit = np.vstack([chain.emissions(wanted, base), chain.emissions(chain.end[None], np.array(rest[:1])), chain.emissions(np.zeros((1, hmm.STATES)), np.array(rest[1:]))])
        return hmm.Model(chain.start, chain.move, emit)

    def sequences(ids):
        at = np.cumsum([0, *(len(tokens(texts[i])) for i in ids)])
        return hmm.with_ends(np.array([number.get(w, len(names) + 1) for i in ids for w in tokens(texts[i])], np.int32), at, len(names))

    for _ in range(2):
        start, move, emit = hmm.expected(model(), *sequences(learns))
        start, move = start + 1, move + 1
        chain = hmm.Chain(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit.sum(axis=0), emit[-2])
        wanted = emit[:-2]
    scores = hmm.forward(model(), *sequences(range(len(texts))))[0]
    out = {r["doc_id"]: r for r in hmm.score(df, sample=10, rounds=4, passes=2).collect()}
    for i, t in rows:
        r, w = out[i], tokens(t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) + 1, 1 + sum(x in counts for x in w), whole)
        assert r["base_score"] == pytest.approx(sum(math.log10((c + 1) / (whole + kinds + 1)) for c in [counts[x] for x in w] + [len(learns)]))
        assert r["score"] == pytest.approx(scores[i], rel=1e-4)


def test_decontaminate(spark, odd, empty):
    rows, df = odd
    rng = random.Random(6)
    make = lambda n, s: " ".join(f"{s}{rng.randrange(10**6)}" for _ in range(n))
    items = [(k, make(30, "q")) for k in range(20)] + [(20, make(20, "r") + "\nYes."), (21, None), (22, ""), (23, "two words")]
    leaky = [(2000 + k, make(200, "d") + " " + items[k][1].upper() + " " + make(90, "d"), "en") for k in range(21)]
    clean = [(3000 + k, make(300, "d") + " " + " ".join(items[k][1].split()[:4]), "en") for k in range(20)]
    docs = df.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(leaky + clean, "doc_id long, text string, lang string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in decontaminate.leaks(docs, bench).collect()}
    assert set(whole) == {(2000 + k, k) for k in range(21)}
    for part in (7, 1):  # parts find what one index finds, with the same scores
        assert {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in decontaminate.leaks(docs, bench, part=part).collect()} == whole
    named = spark.createDataFrame([(None, items[0][1]), (-1, items[1][1])], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, named).collect()} == {(2000, None), (2001, -1)}
    kept = {r["doc_id"] for r in decontaminate.clean(docs, bench).select("doc_id").collect()}
    assert not kept & {i for i, *_ in leaky} and {i for i, *_ in clean} <= kept and None in kept
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_top_k(spark):
    rng = random.Random(7)
    vectors = [(i, [rng.choice([0.1, -0.2, 0.3, 1.0]) for _ in range(4)]) for i in range(300)]
    odd_rows = [(1000, None), (1050, [0.1, None, 0.2, 0.3]), (1100, [0.1, float("nan"), 0.2, 0.3]), (1150, [float("inf"), 0.0, 0.0, 0.0]), (1200, []), (1250, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0]), (7, vectors[7][1])]
    df = spark.createDataFrame(vectors + odd_rows, "vec_id long, embedding array<float>")
    import numpy as np

    full = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)) for i, v in vectors}
    every = [*full.items(), (7, full[7])]
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = {q: [(k + 1, i, s) for k, (s, i) in enumerate(sorted(((int(full[q] @ v), i) for i, v in every if i != q), key=lambda x: (-x[0], x[1]))[:5])] for q in range(0, 300, 50)}
    assert {q: sorted(v) for q, v in got.items()} == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_url_filter(spark):
    urls = ["https://WWW.Example.com/en/1", "http://example.com/en/2?x", "https://a.b.com/fr/", "https://x.net/es/9", "https://x.net/fr", "https://y.org/zz#q", None, "no scheme", "://", "http://com", "http://notcom/en/", "https://x.net/fr/1", "HTTP://Ä.COM/é"]
    out = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    want = {0: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 1: ("example.com", "/en/2", "example.com/en/", "block"), 2: ("a.b.com", "/fr/", "com/", "allow"), 3: ("x.net", "/es/9", "net/es/", "block"), 6: ("", "", None, "allow"), 8: ("", "", None, None), 11: ("x.net", "/fr/1", "net/fr/", "block"), 12: ("Ä.com", "/é", "com/", "allow")}
    for i, (host, path, rule, verdict) in want.items():
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule)
        assert verdict is None or out[i]["verdict"] == verdict
    assert out[9]["rule"] is None and out[10]["rule"] is None and out[4]["rule"] is None
    assert len(out) == len(urls)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def brute_rules(rows, min_support, min_confidence):
    """All token sets that imply a verdict, by counting; none that a part of it implies as surely."""
    found = {}
    every = sorted({t for own, _ in rows for t in own})
    for mask in range(1, 1 << len(every)):
        z = {t for k, t in enumerate(every) if mask >> k & 1}
        held = [v for own, v in rows if z <= set(own)]
        for v in set(held):
            n = held.count(v)
            if n >= min_support * len(rows) and n / len(held) >= min_confidence:
                found[frozenset(z), v] = (n / len(held), n / len(rows))
    return {k: x for k, x in found.items() if not any(z < k[0] and v == k[1] and y[0] >= x[0] for (z, v), y in found.items())}


def test_mined_rules_against_counting(spark):
    rng = random.Random(10)
    rows = []
    for _ in range(300):
        own = [t for t in "abcdefg" if rng.random() < 0.4] or ["a"]
        rows.append((own + (["g1", "g2", "g3"] if "g" in own else []), "block" if "b" in own and rng.random() < 0.95 else "allow"))
    labelled = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row long, tokens array<string>, verdict string")
    same = url_filter.classes(labelled, 0.02 * len(rows))
    assert {(r["token"], r["rep"]) for r in same.collect()} == {("g1", "g"), ("g2", "g"), ("g3", "g")}
    rules = url_filter.mine(labelled, same, 0.02, 0.9)
    want = brute_rules([([t for t in own if len(t) == 1], v) for own, v in rows], 0.02, 0.9)
    got = {(frozenset(r["tokens"]), r["verdict"]): (r["confidence"], r["support"]) for r in rules.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    asked = [(k, [t for t in ("a", "b", "c", "d", "e", "f", "g2", "z") if rng.random() < 0.4]) for k in range(60)]
    best = {}
    for k, own in asked:
        z = {t[0] for t in own}
        fits = [(c, s, len(t), " ".join(sorted(t)), v) for (t, v), (c, s) in want.items() if t <= z]
        if fits:
            best[k] = max(fits)[3:]
    sets = spark.createDataFrame([(str(k), own) for k, own in asked], "key string, tokens array<string>")
    assert {int(r["key"]): (r["mined"], r["mined_verdict"]) for r in url_filter.match(sets, same, rules).collect()} == best


def test_url_filter_with_clashing_columns_and_long_urls(spark):
    rows = [(i, f"https://x{i % 3}.com/p{i % 4}/" + "q" * (100_000 if i == 5 else 3), "c") for i in range(40)] + [(1, "https://y.org/p1", "c")] * 5
    df = spark.createDataFrame(rows, "page_id long, url string, key string").withColumns({c: F.lit("c") for c in ("rule", "verdict", "host", "tokens", "hit", "row", "mined")})
    out = url_filter.judge(df).collect()
    assert len(out) == len(rows) and {r["verdict"] for r in out} == {"allow"}


def test_registry_query_for_each_operator(spark, data):
    names = list(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    out = registry.op8_bpe(spark, data)
    row = out.orderBy("doc_id").first()
    text = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").first()["text"]
    assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
