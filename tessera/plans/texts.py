"""Queries of the text, parameter and conversation functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import params as P
from tessera.functions import text as T
from tessera.operators import conversation as C
from tessera.operators.stateful import queue_eta as eta
from tessera.plans import dialect as D
from tessera.plans.registry import Tables, query


@query(f"SELECT page_id, {D.clean('html')} AS clean_text FROM pages")
def clean_retrieval_text(t: Tables) -> DataFrame:
    return t("pages").select("page_id", T.clean_retrieval_text(F.col("html")).alias("clean_text"))


@query(f"SELECT page_id, {D.strip_stops('html')} AS kept FROM pages")
def strip_literal_stops(t: Tables) -> DataFrame:
    return t("pages").select("page_id", T.strip_stops(F.col("html")).alias("kept"))


_PHRASED = "'Click Here ' || url || ' about us: MORE along these lines'"


@query(f"SELECT page_id, {D.strip_phrases(_PHRASED)} AS kept FROM pages")
def strip_phrases(t: Tables) -> DataFrame:
    return t("pages").select("page_id", T.strip_phrases(F.concat(F.lit("Click Here "), "url", F.lit(" about us: MORE along these lines"))).alias("kept"))


@query(f"""SELECT doc_id, CASE WHEN len({D.words('text')}) > 400 THEN array_to_string({D.words('text')}[1:400], ' ') ELSE {D.strip('text')} END AS question,
 len({D.words('text')}) > 400 AS truncated FROM documents""")
def truncate_question(t: Tables) -> DataFrame:
    question, cut = T.truncate_question(F.col("text"))
    return t("documents").select("doc_id", question.alias("question"), cut.alias("truncated"))


@query(f"SELECT doc_id, {D.truncate_words('text', 50)} AS short FROM documents")
def truncate_words(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", T.truncate_words(F.col("text"), 50).alias("short"))


_MARKED = "html || ' ' || url || chr(10) || 'it''s'"


@query(f"SELECT page_id, {D.snippet_html(_MARKED)} AS snippet FROM pages")
def snippet_html(t: Tables) -> DataFrame:
    return t("pages").select("page_id", T.snippet_html(F.concat("html", F.lit(" "), "url", F.lit("\nit's"))).alias("snippet"))


@query(f"SELECT page_id, {D.linkify(chr(39) + 'see(' + chr(39) + ' || url || ' + chr(39) + ' <b>' + chr(39))} AS linked FROM pages")
def linkify_urls(t: Tables) -> DataFrame:
    return t("pages").select("page_id", T.linkify(F.concat(F.lit("see("), "url", F.lit(" <b>"))).alias("linked"))


@query(f"SELECT page_id, {D.linkify_plain(chr(39) + 'see(' + chr(39) + ' || url || ' + chr(39) + ' >' + chr(39) + ' || url')} AS linked FROM pages")
def linkify_client(t: Tables) -> DataFrame:
    return t("pages").select("page_id", T.linkify_plain(F.concat(F.lit("see("), "url", F.lit(" >"), "url")).alias("linked"))


@query(f"SELECT doc_id, CAST(len({D.sentences('text')}) AS BIGINT) AS n, array_to_string({D.sentences('text')}, '|') AS sents FROM documents")
def sentence_split(t: Tables) -> DataFrame:
    s = T.sentences(F.col("text"))
    return t("documents").select("doc_id", F.size(s).cast("long").alias("n"), F.array_join(s, "|").alias("sents"))


@query(f"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter({D.simple_tokens('text')}, lambda w: length(w) > 2))), ' ') AS terms FROM benchmark")
def term_set(t: Tables) -> DataFrame:
    return t("benchmark").select("item_id", F.array_join(F.array_sort(T.term_set(F.col("text"))), " ").alias("terms"))


@query(f"SELECT doc_id, array_to_string({D.simple_tokens('text')}, ' ') AS tokens FROM documents")
def tokenize_simple(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.array_join(T.simple_tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, CAST(len({D.index_tokens('text')}) AS BIGINT) AS n, array_to_string({D.index_tokens('text')}, ' ') AS tokens FROM documents")
def bm25_tokenize(t: Tables) -> DataFrame:
    x = T.index_tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(x).cast("long").alias("n"), F.array_join(x, " ").alias("tokens"))


@query(f"""WITH x AS (SELECT item_id, {D.simple_tokens('text')} AS w FROM benchmark)
SELECT item_id, array_to_string(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')), '|') AS tris FROM x""")
def trigrams(t: Tables) -> DataFrame:
    return t("benchmark").select("item_id", F.array_join(T.trigrams(T.simple_tokens(F.col("text"))), "|").alias("tris"))


_BARE = "regexp_replace(url, '^https?://', '')"


@query(f"""SELECT page_id, 'https://' || regexp_replace({_BARE}, '^/+', '') AS https,
 regexp_matches({_BARE}, '(?i)^[a-z0-9.-]+\\.[a-z]{{2,}}(/|$)') AS bare_is_url,
 CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 AND regexp_matches({_BARE}, '(?i)^[a-z0-9.-]+\\.[a-z]{{2,}}(/|$)') THEN {_BARE} ELSE '' END AS link FROM pages""")
def link_normalize(t: Tables) -> DataFrame:
    bare = F.regexp_replace("url", "^https?://", "")
    kind = F.col("page_id") % 3
    return t("pages").select(
        "page_id", T.https_url(bare).alias("https"), T.looks_like_url(bare).alias("bare_is_url"),
        T.reference_link(F.when(kind == 0, F.col("url")), F.when(kind == 1, bare).otherwise("no link")).alias("link"),
    )


@query(f"SELECT event_id, {D.duration('trunc(value * 60 - 100)')} AS lasted FROM events")
def format_duration(t: Tables) -> DataFrame:
    return t("events").select("event_id", T.duration((F.col("value") * 60 - 100).cast("long")).alias("lasted"))


@query(f"SELECT event_id, {D.duration('(event_id % 9) * 45')} AS eta FROM events")
def queue_eta(t: Tables) -> DataFrame:
    return t("events").select("event_id", eta(F.col("event_id") % 9).alias("eta"))


@query(f"SELECT page_id, {D.sanitize('html')} AS safe FROM pages")
def sanitize_html(t: Tables) -> DataFrame:
    return t("pages").select("page_id", T.sanitize_html(F.col("html")).alias("safe"))


@query(f"SELECT page_id, {D.truncate_words(D.collapse(D.sub(D.sanitize('html'), '<[^>]+>', ' ')), 60)} AS shown FROM pages")
def truncate_visible(t: Tables) -> DataFrame:
    return t("pages").select("page_id", T.visible_text(F.col("html"), 60).alias("shown"))


@query("SELECT event_id, CAST(round(value, 2) AS DOUBLE) AS score FROM events")
def score_text(t: Tables) -> DataFrame:
    return t("events").select("event_id", F.round("value", 2).alias("score"))


# Parameters: requests are made of events' ids and values.

_K = "json_extract_string(props, '$.k')"
_REQUEST = f"""WITH r AS (SELECT event_id, event_type, CASE event_id % 7 WHEN 0 THEN '   ' ELSE event_type END AS query,
 CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE CAST(CAST({_K} AS BIGINT) * 3 AS VARCHAR) END AS k,
 CASE event_id % 6 WHEN 0 THEN '0' WHEN 1 THEN NULL ELSE '7' END AS s FROM events)"""


def _requests(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long") * 3
    k = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 5 == 1, '"x"').otherwise(k.cast("string"))
    s = F.when(F.col("event_id") % 6 == 0, "0").when(F.col("event_id") % 6 == 1, None).otherwise("7")
    q = F.when(F.col("event_id") % 7 == 0, "   ").otherwise(F.col("event_type"))
    parts = F.concat_ws(",", F.concat(F.lit('"query":"'), q, F.lit('"')), F.concat(F.when(F.col("event_id") % 2 == 0, '"top_k":').otherwise('"max_n":'), k), F.concat(F.lit('"shard_k":'), s))
    return t("events").select("event_id", F.concat(F.lit("{"), parts, F.lit("}")).alias("payload"))


@query(f"""{_REQUEST}, v AS (SELECT event_id, trim(query) AS query, CASE WHEN k IS NULL THEN 10 ELSE TRY_CAST(k AS BIGINT) END AS top_k, CASE WHEN s IS NULL THEN 20 ELSE CAST(s AS BIGINT) END AS shard_k FROM r)
SELECT event_id, query, CAST(top_k AS BIGINT) AS top_k, CAST(shard_k AS BIGINT) AS shard_k,
 CASE WHEN top_k IS NULL THEN 'Field ''top_k''/''max_n'' must be an integer' WHEN query = '' THEN 'Field ''query'' must be a non-empty string'
 WHEN top_k <= 0 OR top_k > 200 THEN 'Field ''top_k'' must be between 1 and 200' WHEN shard_k <= 0 OR shard_k > 200 THEN 'Field ''shard_k'' must be between 1 and 200' END AS error FROM v""")
def validate_search(t: Tables) -> DataFrame:
    return _requests(t).select("event_id", *(c.alias(k) for k, c in P.search_request(F.col("payload")).items()))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN event_type ELSE 'hello' END AS message,
 CASE event_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS user_id, event_id % 3 = 0 AS force_queue,
 CASE WHEN event_id % 4 = 0 THEN 'Field ''message'' must be a non-empty string' WHEN event_id % 5 = 1 THEN 'Field ''user_id'' must be a string'
 WHEN event_id % 5 = 0 THEN 'Field ''user_id'' cannot be none or empty' END AS error FROM events""")
def validate_chat(t: Tables) -> DataFrame:
    i = F.col("event_id")
    message = F.when(i % 4 == 0, '"message":" "').when(i % 4 == 1, F.concat(F.lit('"message":"","query":" '), "event_type", F.lit('"'))).otherwise('"message":"hello"')
    user = F.when(i % 5 == 0, F.lit(None)).when(i % 5 == 1, F.concat(F.lit('"user_id":'), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit('"user_id":" '), F.col("user_id").cast("string"), F.lit('"')))
    force = F.when(i % 3 == 0, '"force_queue":" TRUE "').otherwise('"force_queue":"yes"')
    payload = F.concat(F.lit("{"), F.concat_ws(",", message, user, force), F.lit("}"))
    return t("events").select("event_id", payload.alias("payload")).select("event_id", *(c.alias(k) for k, c in P.chat_request(F.col("payload")).items()))


@query("""WITH v AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE CAST(doc_id AS VARCHAR) END AS job_id, CAST(quality AS BIGINT) AS relevance, CAST(1 + toxic AS BIGINT) AS accuracy,
 CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(11 + quality AS BIGINT) END AS style FROM labels)
SELECT doc_id, job_id, relevance, accuracy, style, 'fine' AS comments, CASE WHEN job_id IS NULL THEN 'Field ''job_id'' must be a non-empty string' WHEN relevance = 0 THEN 'Field ''relevance'' must be integer'
 WHEN accuracy = 0 THEN 'Field ''accuracy'' must be integer' WHEN style IS NULL THEN 'Field ''style'' must be integer' END AS error FROM v""")
def validate_feedback(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    style = F.when(i % 5 == 0, F.lit("null")).otherwise((11 + F.col("quality")).cast("string"))
    job = F.when(i % 6 == 0, F.lit("7")).otherwise(F.concat(F.lit('"'), i.cast("string"), F.lit(' "')))
    payload = F.concat(
        F.lit('{"job_id":'), job, F.lit(',"relevance":'), F.col("quality").cast("string"), F.lit(',"accuracy":"'), (1 + F.col("toxic")).cast("string"), F.lit('","style":'), style, F.lit(',"comments":" fine "}')
    )
    return t("labels").select("doc_id", payload.alias("payload")).select("doc_id", *(c.alias(k) for k, c in P.feedback_request(F.col("payload")).items()))


@query(f"""SELECT event_id, CAST({_K} AS BIGINT) AS k, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS BIGINT) ELSE -1 END AS whole, CAST(value AS DOUBLE) AS number,
 CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS flag, event_type AS kind FROM events""")
def payload_coerce(t: Tables) -> DataFrame:
    i = F.col("event_id")
    flag = F.when(i % 4 == 0, '" YES "').when(i % 4 == 1, "false").when(i % 4 == 2, '"maybe"').otherwise("null")
    whole = F.when(i % 2 == 0, F.concat(F.lit('" '), i.cast("string"), F.lit('"'))).otherwise('"1.5"')
    payload = F.concat(F.lit('{"whole":'), whole, F.lit(',"number":'), F.col("value").cast("string"), F.lit(',"flag":'), flag, F.lit(',"kind":" '), "event_type", F.lit(' "}'))
    rows = t("events").select("event_id", payload.alias("p"), "props")
    none = F.lit(None)
    return rows.select(
        "event_id", P.payload_int(F.col("props"), "k", none).alias("k"), P.payload_int(F.col("p"), "whole", F.lit(-1)).alias("whole"), P.payload_float(F.col("p"), "number", none).alias("number"),
        P.payload_bool(F.col("p"), "flag", none.cast("boolean")).alias("flag"), P.payload_str(F.col("p"), "kind", none).alias("kind"),
    )


@query("SELECT event_id, event_id % 3 = 0 AS lenient, event_id % 3 = 0 AS strict FROM events")
def str_to_bool(t: Tables) -> DataFrame:
    x = F.when(F.col("event_id") % 3 == 0, " TRUE ").otherwise("False")
    return t("events").select("event_id", P.lenient_bool(x).alias("lenient"), P.strict_bool(x).alias("strict"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN 3 ELSE least(9, greatest(2, event_id % 13)) END AS BIGINT) AS clamped, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(least(10, greatest(1, event_id % 13)) AS BIGINT) END AS rating FROM events")
def clamp_int(t: Tables) -> DataFrame:
    x = F.when(F.col("event_id") % 4 == 0, "many").otherwise(F.concat((F.col("event_id") % 13).cast("string"), F.lit("px")))
    return t("events").select("event_id", P.clamp(x, 2, 9, F.lit(3)).alias("clamped"), P.rating(x).alias("rating"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN least(5, event_id % 8) ELSE 0 END AS history_turns,
 CASE WHEN event_id % 2 = 0 THEN 'chat' ELSE 'search' END AS stored, CASE WHEN event_id % 2 = 0 AND event_id % 5 <> 0 THEN 'chat' ELSE 'search' END AS mode FROM events""")
def mode_access(t: Tables) -> DataFrame:
    i = F.col("event_id")
    turns = F.when(i % 3 == 0, (i % 8).cast("string")).otherwise('"4"')
    raw = F.concat(F.lit('{"historyTurns":'), turns, F.lit(',"mode":"'), F.when(i % 2 == 0, "chat").otherwise("admin"), F.lit('"}'))
    state = P.tool_state(F.col("raw"))
    rows = t("events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", state["history_turns"].alias("history_turns"), state["mode"].alias("stored"), P.allowed_mode(state["mode"], i % 5 != 0).alias("mode"))


@query("SELECT event_id, event_type IN ('click', 'view', 'a b') AS unlocked FROM events")
def unlock(t: Tables) -> DataFrame:
    allowed = P.passwords(F.lit(" click ,view,, a b"))
    return t("events").select("event_id", F.array_contains(allowed, F.col("event_type")).alias("unlocked"))


# Conversations.

TURNS = """spoken AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant')),
paired AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM spoken WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
turns AS (SELECT conv_id, turn, text AS "user", CASE WHEN nr = 'assistant' THEN nt ELSE '' END AS assistant FROM paired WHERE role = 'user')"""


@query(f"WITH {TURNS} SELECT conv_id, turn, \"user\", assistant FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def context_turns(t: Tables) -> DataFrame:
    return C.newest(C.turns(t("conversations")), "conv_id", "turn", 2)


@query(f"WITH {TURNS} SELECT conv_id, turn FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 50")
def capped_history(t: Tables) -> DataFrame:
    return C.newest(C.turns(t("conversations")), "conv_id", "turn", C.MOST_HISTORY).select("conv_id", "turn")


@query(f"WITH {TURNS}, f AS (SELECT conv_id, arg_min(\"user\", turn) AS u FROM turns WHERE \"user\" <> '' GROUP BY conv_id), e AS (SELECT DISTINCT conv_id FROM turns) SELECT conv_id, {D.shorten(chr(99) + 'oalesce(u, ' + chr(39) + 'Conversation' + chr(39) + ')', 42)} AS title FROM e LEFT JOIN f USING (conv_id)")
def conversation_title(t: Tables) -> DataFrame:
    return C.title(C.turns(t("conversations")))


@query(f"WITH {TURNS}, l AS (SELECT conv_id, CASE WHEN assistant = '' THEN \"user\" ELSE assistant END AS x FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1) SELECT conv_id, {D.shorten('x', 60)} AS preview FROM l")
def conversation_preview(t: Tables) -> DataFrame:
    return C.preview(C.turns(t("conversations")))


@query(f"WITH {TURNS}, s AS (SELECT conv_id AS id, CASE WHEN conv_id % 4 = 0 THEN 0 ELSE max(turn) END AS saved_at FROM turns GROUP BY conv_id) SELECT id, CAST(saved_at AS BIGINT) AS saved_at FROM s ORDER BY saved_at DESC, id LIMIT 25")
def recent_conversations(t: Tables) -> DataFrame:
    saved = C.turns(t("conversations")).groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("saved_at"))
    return C.recent(saved.withColumn("saved_at", F.when(F.col("id") % 4 != 0, F.col("saved_at"))))


@query(f"WITH {TURNS} SELECT conv_id AS id, count(*) AS n, CAST(sum(length(\"user\")) AS BIGINT) AS chars FROM turns GROUP BY conv_id")
def saved_conversations(t: Tables) -> DataFrame:
    body = C.load_json(F.col("body"))
    return C.saved_json(C.turns(t("conversations"))).select("id", F.size(body).cast("long").alias("n"), F.aggregate(body, F.lit(0).cast("long"), lambda a, x: a + F.length(x["user"])).alias("chars"))


@query(f"WITH {TURNS} SELECT conv_id, turn FROM turns WHERE conv_id % 3 <> 0")
def delete_conversation(t: Tables) -> DataFrame:
    turns = C.turns(t("conversations"))
    return C.without(turns, turns.where("conv_id % 3 = 0").select("conv_id").distinct()).select("conv_id", "turn")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Reference' ELSE url END AS title, CASE WHEN page_id % 2 = 0 THEN url ELSE 'Corpus' END AS source, 'x' AS snippet, CASE WHEN page_id % 4 = 0 THEN url ELSE '' END AS url FROM pages")
def reference_projection(t: Tables) -> DataFrame:
    i = F.col("page_id")
    item = F.struct(
        F.lit("").alias("title"), F.when(i % 3 != 0, F.col("url")).alias("source_title"), F.when(i % 2 == 0, F.col("url")).alias("publication"),
        F.lit("x").alias("excerpt"), F.when(i % 4 == 0, F.col("url")).alias("link"),
    )
    refs = C.references(F.to_json(F.array(item)))
    return t("pages").select("page_id", F.explode(refs).alias("r")).select("page_id", "r.title", "r.source", "r.snippet", "r.url")


@query(f"SELECT conv_id, turn, {D.shorten('text', 120)} AS label FROM conversations")
def feedback_label(t: Tables) -> DataFrame:
    return t("conversations").select("conv_id", "turn", C.label(F.col("text")).alias("label"))


@query("SELECT m.conv_id, m.turn, CASE WHEN m.turn % 2 = 1 THEN 'late ' || m.role ELSE m.text END AS text FROM conversations m")
def update_message(t: Tables) -> DataFrame:
    rows = t("conversations").withColumn("job_id", F.concat_ws(":", "conv_id", "turn"))
    late = rows.where("turn % 2 = 1").select("job_id", F.concat(F.lit("late "), "role").alias("text"))
    return C.updated(rows, late).select("conv_id", "turn", "text")
