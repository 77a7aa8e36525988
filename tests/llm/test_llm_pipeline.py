"""The pipeline's stages, each held against its own input."""

from __future__ import annotations

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, data))
        n = out.count()
        assert 0 < n <= before
        if name != "bpe":
            assert sorted(out.columns) == sorted(columns)
            assert out.where("n_chars <> length(text)").count() == 0
            docs, before = out, n
        else:
            assert n == before
            back = out.join(docs.selectExpr("doc_id", "text AS was"), "doc_id")
            assert back.where("text <> was").count() == 0 and back.count() == n
    from tessera.llm import decontaminate, ngram_jaccard

    again = ngram_jaccard.jaccard_components(docs)
    assert again.where("component_id <> doc_id").count() == 0
    assert decontaminate.leaks(docs, spark.read.parquet(f"{data}/benchmark.parquet")).count() == 0


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).columns == ["doc_id", "n_tokens", "ids", "text"]


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls in every column, repeats, empty and long texts and columns of clashing names go through all stages."""
    from pyspark.sql import functions as F

    rng = random.Random(13)
    words = {"en": "the of and to in is that it was for on are with as this be at one have from".split(), "fr": "le de un et en que les des est dans pour sur avec pas plus par une qui au ce".split()}
    make = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(["", "", "s", "e"]) for _ in range(n))
    rows = [(i, "\n".join(make(lang, rng.randrange(8, 40)) for _ in range(4)), lang, "web", 0) for i, lang in enumerate(["en", "fr"] * 40)]
    leaked = make("en", 40)
    rows += [(200, None, "en", None, None), (201, "", "en", None, 0), (202, "12 34 - 5", None, "x", 9), (None, make("en", 30), "en", "x", None), (203, make("fr", 20_000), None, None, 1)]
    rows += [rows[3], rows[3], (204, rows[5][1] + " more", "fr", "x", 1), (205, make("en", 60) + " " + leaked + " " + make("en", 60), "en", "x", 1), (206, "\n\n" + rows[8][1].split("\n")[0] + "\n", "en", "x", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clash = {c: F.lit("c") for c in ("removed", "n_lines", "route", "batch", "ids", "score", "component", "held_out")}
    spark.createDataFrame(rows, schema).withColumns(clash).repartition(3).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(1, leaked), (None, "nothing of it at all here"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/a/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, f"{tmp_path}/a"))
        kept[name] = sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=str)
    assert not {200, 201, 202} & set(kept["language_id"]) and len(kept["language_id"]) == len(rows) - 3
    assert 206 not in kept["line_dedup"] and kept["line_dedup"].count(3) == 3
    assert 205 in kept["ngram_jaccard"] and 205 not in kept["decontamination"]
    assert kept["bpe"] == kept["decontamination"] and None in kept["bpe"] and 203 in kept["bpe"]
    assert set(range(80)) - set(kept["bpe"]) <= {5}
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{tmp_path}/a/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
