"""Queries of the corpus, the index, retrieval, context and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import answer, bm25, context, service
from tessera.plans import dialect as D
from tessera.plans.registry import Tables, query
from tessera.sources import corpus as C

#: Documents of a shard in these queries.
SHARD = 16


def corpus(t: Tables) -> DataFrame:
    """Documents as chunks: dense doc_idx by doc_id, source as url, language as publisher."""
    docs = t("documents").select("doc_id", "text", F.col("source").alias("source_url"), F.col("lang").alias("publisher"))
    return C.dense_index(C.with_text_columns(docs), "doc_id")


def questions(t: Tables) -> DataFrame:
    return t("benchmark").select(F.col("item_id").alias("qid"), "text")


@query(f"WITH {D.CORPUS} SELECT doc_idx, '' AS title, text, source_url, publisher, '' AS found_on FROM corpus")
def corpus_normalize(t: Tables) -> DataFrame:
    return corpus(t).select("doc_idx", *C.TEXT_COLUMNS)


@query(f"WITH {D.CORPUS} SELECT doc_idx, CAST(doc_idx // 16 AS BIGINT) AS shard_id, CAST(doc_idx % 16 AS BIGINT) AS local_idx FROM corpus")
def shard_assign(t: Tables) -> DataFrame:
    c = corpus(t)
    return c.select("doc_idx", C.shard_of(F.col("doc_idx"), SHARD).alias("shard_id"), (F.col("doc_idx") % SHARD).alias("local_idx"))


@query(f"WITH {D.bm25()} SELECT doc_idx, term, CAST(tf AS BIGINT) AS tf FROM post")
def term_frequency(t: Tables) -> DataFrame:
    return bm25.term_frequency(corpus(t)).select("doc_idx", "term", "tf")


@query(f"WITH {D.bm25()} SELECT doc_idx, dl FROM lens")
def doc_length(t: Tables) -> DataFrame:
    return bm25.build(corpus(t)).lengths.select("doc_idx", "dl")


@query(f"WITH {D.bm25()} SELECT term, CAST(df AS BIGINT) AS df, round(ln(1e0 + (n - df + 5e-1) / (df + 5e-1)), 6) AS idf FROM terms JOIN stats USING (shard)")
def term_idf(t: Tables) -> DataFrame:
    index = bm25.build(corpus(t))
    return index.terms.join(index.stats, "shard").select("term", "df", F.round(bm25.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"WITH {D.bm25()} SELECT CAST(n AS BIGINT) AS n, round(avgdl, 6) AS avgdl FROM stats")
def corpus_stats(t: Tables) -> DataFrame:
    return bm25.build(corpus(t)).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {D.bm25()} SELECT qid, rk, doc_idx, round(score, 4) AS score FROM topk")
def bm25_topk(t: Tables) -> DataFrame:
    found = bm25.top_k(bm25.build(corpus(t)), questions(t))
    return found.select("qid", "rk", "doc_idx", F.round("score", 4).alias("score"))


_RARE = "SELECT item_id AS qid, CASE WHEN item_id % 4 = 0 THEN '  ' WHEN item_id % 4 = 1 THEN 'zzqqx' ELSE text END AS text FROM benchmark"


def _odd_questions(t: Tables) -> DataFrame:
    i = F.col("item_id") % 4
    return t("benchmark").select(F.col("item_id").alias("qid"), F.when(i == 0, "  ").when(i == 1, "zzqqx").otherwise(F.col("text")).alias("text"))


@query(f"""WITH {D.bm25(queries=_RARE)}, few AS (SELECT doc_idx FROM corpus ORDER BY doc_idx LIMIT 20),
pads AS (SELECT q.qid, f.doc_idx, 0e0 AS score FROM qs q CROSS JOIN few f WHERE NOT EXISTS (SELECT 1 FROM topk k WHERE k.qid = q.qid AND k.doc_idx = f.doc_idx)),
both_ AS (SELECT qid, doc_idx, score FROM topk UNION ALL SELECT * FROM pads)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_idx) AS BIGINT) AS rk, doc_idx, round(score, 4) AS score FROM both_ QUALIFY rk <= 10""")
def bm25_topk_padded(t: Tables) -> DataFrame:
    found = bm25.top_k_padded(bm25.build(corpus(t)), _odd_questions(t))
    return found.select("qid", "rk", "doc_idx", F.round("score", 4).alias("score"))


@query(f"""WITH {D.bm25("CAST(doc_idx // 16 AS BIGINT)")},
near AS (SELECT qid, shard, doc_idx, score FROM scores QUALIFY row_number() OVER (PARTITION BY qid, shard ORDER BY round(score, 6) DESC, doc_idx) <= 10),
best AS (SELECT qid, doc_idx, max(score) AS score FROM near GROUP BY qid, doc_idx)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_idx) AS BIGINT) AS rk, doc_idx, round(score, 4) AS score FROM best QUALIFY rk <= 10""")
def bm25_shard_topk(t: Tables) -> DataFrame:
    found = bm25.shard_top_k(bm25.build(corpus(t), C.shard_of(F.col("doc_idx"), SHARD)), questions(t))
    return found.select("qid", "rk", "doc_idx", F.round("score", 4).alias("score"))


HITS = """hits AS (SELECT qid, rk, CAST(doc_idx AS VARCHAR) AS row_id, source_url AS source, '' AS title, publisher, '' AS found_on, text, score FROM topk JOIN corpus USING (doc_idx))"""


def _hits(t: Tables, asked: DataFrame | None = None) -> DataFrame:
    c = corpus(t)
    return bm25.hits(bm25.top_k(bm25.build(c), questions(t) if asked is None else asked), c)


@query(f"WITH {D.bm25()}, {HITS} SELECT qid, rk, row_id, source, title, publisher, found_on, text, substring(text, 1, 1200) AS snippet, {D.snippet_html('text')} AS snippet_html, round(score, 4) AS score_bm25 FROM hits")
def search_hits(t: Tables) -> DataFrame:
    return _hits(t).withColumn("score_bm25", F.round("score_bm25", 4))


@query(f"WITH {D.bm25()} SELECT qid, count(*) AS candidates FROM scores GROUP BY qid")
def candidate_counts(t: Tables) -> DataFrame:
    return bm25.candidate_counts(bm25.scores(bm25.build(corpus(t)), questions(t)))


@query(f"""WITH {D.bm25(queries=_RARE)}, {HITS}, l AS (SELECT qid, count(*) AS n, string_agg(row_id, ',' ORDER BY rk) AS ids FROM hits GROUP BY qid)
SELECT q.qid, CAST(coalesce(n, 0) AS BIGINT) AS num_results, CASE WHEN trim(q.text) = '' THEN 'Empty query.' ELSE 'Found ' || coalesce(n, 0) || ' result(s).' END AS message, coalesce(ids, '') AS row_ids FROM qs q LEFT JOIN l USING (qid)""")
def search_envelope(t: Tables) -> DataFrame:
    asked = _odd_questions(t)
    return bm25.envelope(asked, _hits(t, asked))


CONTEXT = f"""terms_of AS (SELECT qid, list_distinct(list_filter({D.simple_tokens("text")}, lambda w: length(w) > 2)) AS terms FROM qs),
sent0 AS (SELECT qid, rk, unnest(range(0, len(s))) AS pos, unnest(s) AS sent FROM (SELECT qid, rk, ({D.sentences(D.strip("text"))})[1:50] AS s FROM hits WHERE rk <= 5)),
sent1 AS (SELECT qid, rk, pos, sent, {D.simple_tokens("sent")} AS w FROM sent0 JOIN terms_of USING (qid) WHERE len(list_filter(terms, lambda x: contains(lower(sent), x))) > 0),
sent2 AS (SELECT qid, rk, pos, sent, list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) AS tris, row_number() OVER (PARTITION BY qid ORDER BY rk, pos) AS k FROM sent1),
fold AS (
  SELECT qid, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS rk, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS seen, false AS keep FROM qs
  UNION ALL
  SELECT qid, k, rk, CASE WHEN keep THEN n + 1 ELSE n END, CASE WHEN keep THEN list_concat(seen, tris) ELSE seen END, keep FROM (
    SELECT s.qid, s.k, s.rk, s.tris, f.seen, CASE WHEN f.rk = s.rk THEN f.n ELSE 0 END AS n,
      (CASE WHEN f.rk = s.rk THEN f.n ELSE 0 END) < 5 AND len(list_filter(s.tris, lambda x: NOT list_contains(f.seen, x))) > 0 AS keep
    FROM fold f JOIN sent2 s ON s.qid = f.qid AND s.k = f.k + 1) z
),
kept AS (SELECT s.qid, CAST(s.rk AS BIGINT) AS rk, CAST(s.pos AS BIGINT) AS pos, s.sent FROM sent2 s JOIN fold f ON f.qid = s.qid AND f.k = s.k WHERE f.keep)"""


def _kept(t: Tables) -> DataFrame:
    return context.kept_sentences(context.candidates(_hits(t), questions(t)))


@query(f"WITH RECURSIVE {D.bm25()}, {HITS}, {CONTEXT} SELECT qid, rk, pos, sent FROM kept")
def context_sentences(t: Tables) -> DataFrame:
    return _kept(t).drop("told")


BLOCKS = """docs AS (SELECT qid, rk, string_agg(sent, chr(10) || '- ' ORDER BY pos) AS snips FROM kept GROUP BY qid, rk),
blocks AS (SELECT qid, string_agg('<doc id="' || row_id || '" url="' || source || '">' || chr(10) || '<snippets>' || chr(10) || '- ' || snips || chr(10) || '</snippets>' || chr(10) || '</doc>', chr(10) ORDER BY rk) AS context
 FROM docs JOIN hits USING (qid, rk) GROUP BY qid)"""


@query(f"WITH RECURSIVE {D.bm25()}, {HITS}, {CONTEXT}, {BLOCKS} SELECT qid, context FROM blocks")
def context_blocks(t: Tables) -> DataFrame:
    """Scores are left out of the compared text: the engines round halves differently."""
    return context.blocks(_kept(t)).select("qid", F.regexp_replace("context", ' score="[0-9.]+"', "").alias("context"))


_PROMPT = D.quoted(f"{answer.SYSTEM_PROMPT}\n\n{answer.QUESTION_HEAD}\n")
_DOCS = D.quoted(f"\n\n{answer.DOCUMENTS_HEAD}\n")


@query(f"WITH RECURSIVE {D.bm25()}, {HITS}, {CONTEXT}, {BLOCKS} SELECT q.qid, {_PROMPT} || q.text || {_DOCS} || coalesce(context, '') AS prompt FROM (SELECT qid, {D.strip('text')} AS text FROM qs) q LEFT JOIN blocks USING (qid)")
def prompt_build(t: Tables) -> DataFrame:
    found = context.blocks(_kept(t)).select("qid", F.regexp_replace("context", ' score="[0-9.]+"', "").alias("context"))
    asked = questions(t).select("qid", T.truncate_question(F.col("text"))[0].alias("text"))
    return asked.join(found, "qid", "left").select("qid", answer.prompt(F.col("text"), F.col("context")).alias("prompt"))


@query(f"""SELECT doc_id, CASE WHEN len({D.words('text')}) > 400 THEN '(Question truncated)' || chr(10) || chr(10) ELSE '' END || 'words: ' || least(400, len({D.words('text')})) AS answer FROM documents""")
def answer_stub(t: Tables) -> DataFrame:
    """The model is a function; here one that counts the words of its prompt."""
    question, cut = T.truncate_question(F.col("text"))
    asked = t("documents").select("doc_id", question.alias("prompt"), cut.alias("cut"))
    return answer.generate(asked, lambda p: f" words: {len(p.split())}\n").select("doc_id", answer.finished(F.col("answer"), F.col("cut")).alias("answer"))


@query("""SELECT conv_id, turn, CASE turn % 7 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN text WHEN 3 THEN text WHEN 4 THEN text WHEN 5 THEN 'plain' ELSE '{"other":1}' END AS answer FROM conversations""")
def parse_llm_json(t: Tables) -> DataFrame:
    i, x = F.col("turn") % 7, F.col("text")
    lit = F.lit
    body = (
        F.when(i == 0, F.to_json(F.array(F.struct(x.alias("generated_text")))))
        .when(i == 1, F.to_json(F.struct(x.alias("generated_text"))))
        .when(i == 2, F.to_json(F.struct(F.array(F.struct(x.alias("text"))).alias("choices"))))
        .when(i == 3, F.to_json(F.struct(lit("").alias("generated_text"), F.array(F.struct(lit("").alias("text"), F.struct(x.alias("content")).alias("message"))).alias("choices"))))
        .when(i == 4, F.substring(F.to_json(F.struct(x.alias("x"))), 6, 1 << 30))
        .when(i == 5, lit('"plain"'))
        .otherwise(lit('{"other":1}'))
    )
    body = F.when(i == 4, F.regexp_replace(body, r"\}\z", "")).otherwise(body)
    return t("conversations").select("conv_id", "turn", answer.parse_response(body).alias("answer"))


_QA = D.strip("text || ' ' || coalesce(reply, '')")


@query(f"""WITH d AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations)
SELECT conv_id, turn, array_to_string({D.words(D.clean("text || ' ' || " + D.strip("coalesce(reply, '')")))}[1:900], ' ') AS refs FROM d""")
def chat_references(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    reply = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t("conversations").withColumn("reply", reply).select("conv_id", "turn", answer.reference_text(F.col("text"), F.col("reply")).alias("refs"))


_SECOND = D.quoted(answer.SECOND_VARIANT)


@query(f"SELECT item_id, variant, CASE variant WHEN 'a' THEN text ELSE text || {_SECOND} END AS prompt FROM benchmark, (VALUES ('a'), ('b')) v(variant)")
def ab_variants(t: Tables) -> DataFrame:
    return answer.variants(t("benchmark")).select("item_id", "variant", "prompt")


@query("SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN 3 ELSE greatest(1, least(6, CAST(floor(value / 10) AS BIGINT))) END AS BIGINT) AS wait FROM events")
def retry_wait(t: Tables) -> DataFrame:
    estimate = F.when(F.col("event_id") % 5 != 0, F.greatest(F.col("value") / 10, F.lit(1e-9)))
    return t("events").select("event_id", answer.retry_wait(estimate).alias("wait"))


@query(f"WITH RECURSIVE {D.bm25()}, {HITS}, {CONTEXT}, n AS (SELECT qid, count(DISTINCT rk) AS n FROM kept GROUP BY qid) SELECT q.qid, 'documents: ' || coalesce(n, 0) AS answer FROM qs q LEFT JOIN n USING (qid)")
def ask(t: Tables) -> DataFrame:
    """The model is a function; here one that counts the documents of its prompt."""
    c = corpus(t)
    return service.ask(c, bm25.build(c), questions(t), lambda p: f"documents: {p.count('<doc id=')}").select("qid", "answer")


@query("SELECT item_id AS qid, 'documents: 0' AS a, 'documents: 0' AS b FROM benchmark")
def ab_answers(t: Tables) -> DataFrame:
    """Both answers to each question; of a corpus that holds none of their words."""
    none = corpus(t).withColumn("text", F.lit("~"))
    return service.compare(none, bm25.build(none), questions(t), lambda p: f"documents: {p.count('<doc id=')}")


@query(f"WITH {D.bm25()} SELECT qid, count(*) AS answers FROM topk GROUP BY qid")
def chat_references_found(t: Tables) -> DataFrame:
    """The references of chat where the answer adds nothing to the question."""
    c = corpus(t)
    _, references = service.chat(c, bm25.build(c), questions(t), lambda p: "")
    return references.groupBy("qid").agg(F.count(F.lit(1)).alias("answers"))
