"""Cases that operators once left out."""

from __future__ import annotations

import random
import re
import zlib

import pytest

from tessera.llm import hmm, langid, registry

public = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_line_dedup_short_lines(spark, tmp_path):
    """op9 removes lines of one to four words too, equal ones and similar ones."""
    texts = ["Share\nred green blue\nShare", "share\nblue  red GREEN\n\n", "red green\none two three four five", "two one four three\nred green blue gray\n-", "-\ngreen red\nthree\nblue", None]
    rows = list(enumerate(texts)) + [(1, texts[1]), (None, "Share")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/one/documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(f"{tmp_path}/many/documents.parquet")
    seen, want = [], {}
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            z = set(WORD.findall(line.lower()))
            if z and any(100 * len(z & y) >= 75 * len(z | y) for y in seen):
                want.setdefault(i, []).append(k)
            seen += [z] if z else []
    assert want[0] == [2] and want[1] == [0, 1] and want[3] == [0, 1]
    for folder in ("one", "many"):
        out = registry.op9_line_dedup(spark, f"{tmp_path}/{folder}").collect()
        assert len(out) == len(rows)
        assert {r["doc_id"]: [int(x) for x in r["removed"].split(",")] for r in out if r["removed"]} == want


def test_hmm_rare_words_depend_on_state(spark):
    """Beyond the 2,000 most frequent words too, a rare word of the topic at hand is likelier than one of another topic."""
    rng = random.Random(2)
    train, out = ([i for i in range(3000) if (zlib.crc32(str(i).encode()) % 7 == 2) == held] for held in (False, True))
    texts = [" ".join(f"f{j}" for j in range(a, a + 100)) for a in range(0, 2000, 100)] * 5
    for t in "xy":
        for k in range(100):
            w = [f"{t}{rng.randrange(5)}" for _ in range(20)]
            w[5], w[12] = f"rare{t}{k % 50}", f"rare{t}{(k + 7) % 50}"
            texts.append(" ".join(w))
    asked = ["x0 x1 x2 rarex3 x3 x4 x0", "x0 x1 x2 rarey3 x3 x4 x0"]
    df = spark.createDataFrame([*zip(train, texts), *zip(out, asked)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in hmm.score(df).collect()}
    assert got[out[0]]["base_score"] == pytest.approx(got[out[1]]["base_score"])
    assert got[out[0]]["score"] > got[out[1]]["score"] + 0.3


def test_hmm_passes_over_all_texts(spark):
    """From a poor sample, training as it is by default goes further than one pass over all texts."""
    rng = random.Random(3)
    texts = [" ".join(f"{t}{rng.randrange(9)}" for _ in range(15)) for _ in range(60) for t in "xyz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    total = {}
    for name, options in {"default": {}, "one": {"passes": 1}}.items():
        total[name] = sum(r["score"] for r in hmm.score(df, sample=1, rounds=1, **options).where("NOT held_out").collect())
    assert total["default"] > total["one"] + 1


def test_langid_learns_rare_and_many_languages(spark):
    """A language of a single text is learned, and so are all of more than 64."""
    path = public.path("byte_bpe_multi_50k.tiktoken")
    rng = random.Random(4)
    learning = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 4 != 2]
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(70)}
    langs = [k for k in words for _ in range(1 if k == "l69" else 2 if k != "l00" else 30)]
    rows = [(i, " ".join(words[k]), k) for i, k in zip(learning, langs)]
    df = spark.createDataFrame([*rows, (5000, "12 34", "digits")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, path).collect()}
    assert {i: got[i] for i, *_ in rows} == {i: k for i, _, k in rows}
    assert got[5000] == "und"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, data, tmp_path, name):
    """On the small tables, and on ones with odd rows."""
    import duckdb
    from pyspark.sql import functions as F

    rng = random.Random(21)
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").limit(60).select("doc_id", "text")
    texts = ["", None, "\n\n", "one two", "One\tTWO", "a b c d\na b c d e", "é É\u3000é", " ".join(f"w{rng.randrange(9)}" for _ in range(300))]
    odd = docs.unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts * 2)], docs.schema)).unionByName(docs.limit(5))
    odd.coalesce(1).write.parquet(f"{tmp_path}/documents")
    vectors = spark.read.parquet(f"{data}/embeddings.parquet").limit(120)
    vectors.unionByName(vectors.limit(1).withColumn("vec_id", F.lit(None).cast("long")), allowMissingColumns=True).coalesce(1).write.parquet(f"{tmp_path}/embeddings")
    for folder, files in ((data, {t: f"{data}/{t}.parquet" for t in ("documents", "embeddings")}), (tmp_path, {t: f"{tmp_path}/{t}/*.parquet" for t in ("documents", "embeddings")})):
        duck = duckdb.connect()
        for t, at in files.items():
            duck.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}')")
        if folder is tmp_path:
            for t in files:
                (tmp_path / t).rename(tmp_path / f"{t}.parquet")
                duck.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        got, want = registry.queries()[name](spark, str(folder)), duck.sql(registry.oracle_sql()[name])
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        at = [want.columns.index(c) for c in columns]
        assert sorted(tuple(str(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
