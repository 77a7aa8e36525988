"""The worker, stored indexes, numbering of files and small functions of the service."""

from __future__ import annotations

import logging
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import bm25, service, worker
from tessera.sources import corpus

JOBS = "id string, user_id string, prompt string, status string, created_at timestamp_ntz, completed_at timestamp_ntz, response string"


def jobs(spark, rows):
    made = spark.createDataFrame([(i, u, f"p{i}", s, at) for i, u, s, at in rows], "id string, user_id string, prompt string, status string, at string")
    none = F.lit(None)
    return made.select("id", "user_id", "prompt", "status", F.col("at").cast("timestamp_ntz").alias("created_at"), none.cast("timestamp_ntz").alias("completed_at"), none.cast("string").alias("response"))


def test_worker_takes_the_line_in_order(spark):
    table = jobs(spark, [("a", "1", "queued", "2024-01-02"), ("b", "1", "queued", "2024-01-01"), ("c", "2", "done", "2023-01-01"), ("d", "2", "queued", "2024-01-01")])
    assert [r["id"] for r in worker.peek(table).collect()] == ["b"]
    assert {r["id"] for r in worker.pop(table).collect()} == {"a", "c", "d"}
    at = F.lit("2024-03-01").cast("timestamp_ntz")
    after, responses = worker.run(table, str.upper, at, 2)
    assert {(r["id"], r["answer"]) for r in responses.collect()} == {("b", "PB"), ("d", "PD")}
    assert {r["id"]: r["status"] for r in after.collect()} == {"a": "queued", "b": "done", "c": "done", "d": "done"}
    after, responses = worker.run(table, str.upper, at, 2, model_ready=False)
    assert responses.isEmpty() and after.where("status = 'done'").count() == 1
    empty = table.limit(0)
    assert worker.peek(empty).isEmpty() and worker.pop(empty).isEmpty()


def test_responses(spark):
    raw = ['{"answer":"x"}', '"{\\"answer\\":\\"x y\\"}"', "oops", None, '{"other":1}', '"plain"']
    got = [r["x"] for r in spark.createDataFrame(list(enumerate(raw)), "i int, raw string").orderBy("i").select(worker.parse_response(F.col("raw"), "answer").alias("x")).collect()]
    assert got == ["x", "x y", None, None, None, None]
    ids = spark.range(50).select(worker.new_id("s-").alias("id")).collect()
    assert len({r["id"] for r in ids}) == 50 and all(r["id"].startswith("s-") for r in ids)


def test_file_order(spark, tmp_path):
    """Rows are numbered as they stand in files, also where a file is cut into several splits."""
    want = []
    for name in ("b", "a", "c"):
        lines = [f"{name}{i} " + "x" * random.Random(i).randrange(200) for i in range(300)]
        (tmp_path / f"{name}.txt").write_text("\n".join(lines))
        want.append((name, lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = [r["value"] for r in corpus.file_order(spark.read.text(str(tmp_path))).orderBy("doc_idx").collect()]
        places = [r["doc_idx"] for r in corpus.file_order(spark.read.text(str(tmp_path))).orderBy("doc_idx").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [x for _, lines in sorted(want) for x in lines] and places == list(range(900))


def test_numbering_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(corpus, "PART_ROWS", 7)
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(60)]), i) for i in range(200)]
    got = corpus.dense_index(spark.createDataFrame(rows, "k long, i long").repartition(5), "k", "n", "i").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(200))
    assert [(r["k"], r["i"]) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_stored_index(spark, tmp_path):
    rng = random.Random(4)
    c = spark.createDataFrame([(i, " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(rng.randrange(20)))) for i in range(60)], "doc_idx long, text string")
    q = spark.createDataFrame([(1, "alpha gamma gamma"), (2, "zeta"), (3, "nothing")], "qid long, text string")
    index = bm25.build(c, F.floor(F.col("doc_idx") / 16).cast("long"))
    bm25.store(index, f"{tmp_path}/index")
    stored = bm25.load(spark, f"{tmp_path}/index")
    rows = lambda i: [(r["qid"], r["rk"], r["doc_idx"], round(r["score"], 9)) for r in bm25.shard_top_k(i, q).orderBy("qid", "rk").collect()]
    assert rows(stored) == rows(index) and len(rows(index)) == 20
    stored.lengths.where("doc_idx > 3").write.parquet(f"{tmp_path}/cut/lengths")
    for t in ("postings", "stats"):
        spark.read.parquet(f"{tmp_path}/index/{t}").write.parquet(f"{tmp_path}/cut/{t}")
    with pytest.raises(ValueError):
        bm25.load(spark, f"{tmp_path}/cut")
    placed = c.select("doc_idx", corpus.shard_of(F.col("doc_idx"), 16).alias("shard_id"), (F.col("doc_idx") % 16).alias("local_idx"))
    assert corpus.check_shards(placed, 16).isEmpty() and corpus.check_shards(placed.withColumn("local_idx", F.lit(0)), 16).count() == 56


def test_compare_keeps_ids_with_any_sign(spark):
    c = spark.createDataFrame([(0, "apple pear")], "doc_idx long, text string").selectExpr("doc_idx", "text", "'' AS title", "'' AS source_url", "'' AS publisher", "'' AS found_on")
    q = spark.createDataFrame([("a:b", "apple"), ("a:a:", "pear")], "qid string, text string")
    out = {r["qid"]: (r["a"], r["b"]) for r in service.compare(c, bm25.build(c), q, lambda p: "x").collect()}
    assert out == {"a:b": ("x", "x"), "a:a:": ("x", "x")}


def test_log_to(tmp_path):
    out = worker.log_to(str(tmp_path / "log"))
    worker.log_to(str(tmp_path / "log")).info("told once")
    for h in out.handlers:
        h.flush()
    assert (tmp_path / "log").read_text().count("told once") == 1 and logging.getLogger("py4j").level == logging.WARNING
