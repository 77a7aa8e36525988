"""State, retrieval and context on small hand-made tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import answer, bm25, context, conversation, jobs, service, stateful
from tessera.sources import corpus

LOG = "user_id long, event_id long, ts timestamp_ntz, kind string"


def log(spark, rows):
    return spark.createDataFrame([(u, i, s, k) for i, (u, s, k) in enumerate(rows)], "user_id long, event_id long, s long, kind string").select(
        "user_id", "event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "kind"
    )


def test_rate_limit_compares_with_the_last_attempt(spark):
    rows = [(1, 0, "a"), (1, 20, "a"), (1, 49, "a"), (1, 79, "a"), (2, 5, "a")]
    got = {r["event_id"]: r["allowed"] for r in stateful.rate_limit(log(spark, rows)).collect()}
    assert got == {0: True, 1: False, 2: False, 3: True, 4: True}


def test_cooldown_keeps_state_on_refusal(spark):
    rows = [(1, 0, "a"), (1, 6, "a"), (1, 10, "a"), (1, 15, "f"), (1, 24, "a"), (1, 25, "a")]
    got = stateful.cooldown_gate(log(spark, rows), 10, forced=F.col("kind") == "f")
    assert {r["event_id"]: r["passed"] for r in got.collect()} == {0: True, 1: False, 2: True, 3: True, 4: False, 5: True}


@pytest.mark.parametrize("seed", range(3))
def test_mailbox_equals_a_simulation(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(4), t, rng.choice(["in", "out", "other"])) for t in range(200)]
    want, held = {}, {}
    for i, (u, _, k) in enumerate(rows):
        if k == "in":
            held.setdefault(u, []).append(i)
        elif k == "out":
            want[i] = held[u].pop(0) if held.get(u) else None
    got = stateful.mailbox(log(spark, rows), F.col("kind") == "in", F.col("kind") == "out")
    assert {r["event_id"]: r["response_id"] for r in got.collect()} == want


def test_inflight(spark):
    rows = [(1, 0, "+"), (2, 1, "+"), (1, 86_400, "-"), (1, 90_000, "+")]
    delta = F.when(F.col("kind") == "+", 1).otherwise(-1)
    assert [r["depth"] for r in stateful.inflight_depth(log(spark, rows), delta).orderBy("event_id").collect()] == [1, 2, 1, 2]


def test_dedup_consecutive(spark):
    rows = [(1, 0, "a"), (1, 1, "a"), (1, 2, None), (1, 3, None), (1, 4, "a")]
    assert sorted(r["event_id"] for r in stateful.changed_only(log(spark, rows), "user_id", "kind").collect()) == [0, 2, 4]


def test_dense_index(spark):
    rng = random.Random(1)
    keys = [rng.randrange(50) for _ in range(500)] + [None]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    got = corpus.dense_index(df, "k", "n", "i").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(501))
    assert [(r["k"] is not None, r["k"] or 0, r["i"]) for r in got] == sorted((k is not None, k or 0, i) for i, k in enumerate(keys))


def docs(spark, texts):
    return corpus.with_text_columns(spark.createDataFrame(list(enumerate(texts)), "doc_idx long, text string"))


def test_one_shard_equals_the_single_index(spark):
    rng = random.Random(2)
    words = ["apple", "pear", "plum", "fig", "date", "nut"]
    c = docs(spark, [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(60)])
    q = spark.createDataFrame([(1, "apple pear"), (2, "fig fig nut"), (3, " ")], "qid long, text string")
    single = bm25.top_k(bm25.build(c), q).collect()
    sharded = bm25.shard_top_k(bm25.build(c, F.lit(0).cast("long")), q).collect()
    assert sorted(map(tuple, single)) == sorted(map(tuple, sharded))
    for qid in (1, 2):
        ranks = sorted((r["rk"], r["score"]) for r in single if r["qid"] == qid)
        assert [r for r, _ in ranks] == list(range(1, len(ranks) + 1))
        assert all(round(a, 6) >= round(b, 6) for (_, a), (_, b) in zip(ranks, ranks[1:], strict=False))


def test_one_shard_returns_at_most_its_cut(spark):
    c = docs(spark, ["apple"] * 50)
    q = spark.createDataFrame([(1, "apple")], "qid long, text string")
    assert bm25.shard_top_k(bm25.build(c, F.lit(0).cast("long")), q, k=200).count() == 30
    assert bm25.top_k_padded(bm25.build(docs(spark, ["apple", "pear", "fig"])), q, k=10).count() == 3


def test_context_stops_at_five_and_wants_news(spark):
    text = " ".join(f"Apple number {w} is here." for w in "one two three four five six seven".split())
    hits = spark.createDataFrame([(1, 1, "r1", "", "s", text, text, 2.345), (1, 2, "r2", "", "s", text, text, 1.0)], "qid long, rk int, row_id string, title string, source string, text string, snippet string, score_bm25 double")
    q = spark.createDataFrame([(1, "apple")], "qid long, text string")
    kept = context.kept_sentences(context.candidates(hits, q)).orderBy("rk", "pos").collect()
    assert [(r["rk"], r["pos"]) for r in kept] == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 5), (2, 6)]
    block = context.blocks(context.kept_sentences(context.candidates(hits, q))).first()["context"]
    assert block.startswith('<doc id="r1" url="s" score="2.3') and block.count("<doc") == 2
    assert context.candidates(hits, spark.createDataFrame([(1, "of a")], "qid long, text string")).isEmpty()


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ('[{"generated_text":"a"}]', "a"),
        ('{"generated_text":"b"}', "b"),
        ('{"generated_text":"","choices":[{"text":"c"}]}', "c"),
        ('{"choices":[{"text":"","message":{"content":"d"}}]}', "d"),
        ('"e"', "e"),
        ('{"x":1}', '{"x":1}'),
    ],
)
def test_parse_response(spark, body, want):
    assert spark.createDataFrame([(body,)], "b string").select(answer.parse_response(F.col("b")).alias("y")).first()["y"] == want


def test_generate_asks_again_only_while_loading(spark):
    tries = {"n": 0}

    def model(text):
        tries["n"] += 1
        if tries["n"] < 3:
            raise answer.Loading(100)
        return f" {text} "

    asked = spark.createDataFrame([("q",)], "prompt string").coalesce(1)
    assert answer.generate(asked, model, sleep=lambda s: None).first()["answer"] == "q"


def test_claim_happens_once(spark):
    table = spark.createDataFrame([("1", "u", "p", "queued", None, None, None)], "id string, user_id string, prompt string, status string, created_at timestamp_ntz, completed_at timestamp_ntz, response string")
    ids = spark.createDataFrame([("1",)], "id string")
    once = jobs.claim(table, ids)
    assert once.first()["changed"] and once.first()["status"] == "processing"
    assert not jobs.claim(once.drop("changed"), ids).first()["changed"]


def test_no_turns_asked_for_gives_none(spark):
    m = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c")], "conv_id long, turn long, role string, text string")
    turns = conversation.turns(m)
    assert [(r["user"], r["assistant"]) for r in turns.orderBy("turn").collect()] == [("a", "b"), ("c", "")]
    assert conversation.newest(turns, "conv_id", "turn", 0).count() == 0
    assert conversation.newest(turns, "conv_id", "turn", 1).first()["user"] == "c"


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"chunk_id":"a","text":"x"}\n{"text":"y","title":"t"}\n')
    rows = corpus.read_json_lines(spark, str(tmp_path / "c.jsonl"))
    assert rows.count() == 2 and rows.columns == corpus.CHUNK.fieldNames()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        corpus.read_json_lines(spark, str(tmp_path / "none")).count()
    indexed = corpus.normalize(rows).withColumn("shard_id", corpus.shard_of(F.col("doc_idx"), 1))
    corpus.write_shards(indexed, str(tmp_path / "shards"))
    kind, found = corpus.boot(spark, corpus.Settings(shards=str(tmp_path / "shards")))
    assert kind == "shards" and found.where("shard_id = 1").count() == 1
    indexed.write.parquet(str(tmp_path / "one"))
    assert corpus.boot(spark, corpus.Settings(shards=str(tmp_path / "no"), index=str(tmp_path / "one")))[0] == "single"


def test_chat_and_compare(spark):
    c = docs(spark, ["Apples are red and sweet fruit.", "Pears are green fruit here.", "Nothing else matters now."])
    index = bm25.build(c)
    q = spark.createDataFrame([(1, "apples red")], "qid long, text string")
    answers, refs = service.chat(c, index, q, lambda p: "pears maybe" if "<doc" in p else "none")
    assert answers.first()["answer"] == "pears maybe"
    assert [r["row_id"] for r in refs.orderBy("rk").collect()] == ["0", "1"]
    both = service.compare(c, index, q, lambda p: str("alternate phrasing" in p)).first()
    assert (both["a"], both["b"]) == ("False", "True")


def test_mailbox_stream_keeps_responses_between_batches(spark, tmp_path):
    import datetime as dt

    from tessera.streaming import services

    kinds = ["arrival", "arrival", "poll"], ["poll", "poll", "arrival"], ["poll"]
    event = 0
    schema = "user_id long, event_id long, ts timestamp, kind string"
    for batch in kinds:
        rows = []
        for kind in batch:
            event += 1
            rows.append((1, event, dt.datetime(2024, 1, 1, 0, 0, event), kind))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    got = services.replay_to(services.mailbox(log), str(tmp_path / "out"), str(tmp_path / "state"))
    assert {r["event_id"]: r["response_id"] for r in got.collect()} == {3: 1, 4: 2, 5: None, 7: 6}
