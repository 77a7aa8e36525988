"""DuckDB forms of the text functions, as SQL text."""

from __future__ import annotations

from tessera.functions.text import PHRASES, STOPWORDS

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(to)}, 'g')"


def strip(x: str) -> str:
    return sub(x, rf"^{WS}+|{WS}+$", "")


def collapse(x: str) -> str:
    return f"trim({sub(x, WS + '+', ' ')})"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {quoted(WS + '+')}), lambda w: w <> '')"


def strip_stops(x: str) -> str:
    cut = sub(x, rf"(?is)(?:{WS}|[\"'])*(?:</s|<\|end\|>|<\|eot_id\|>).*$", "")
    return sub(cut, rf"{WS}+$", "")


def strip_phrases(x: str) -> str:
    return sub(x, "(?i)(" + "|".join(PHRASES) + ")", " ")


def clean(x: str) -> str:
    x = sub(strip_stops(x), "<[^>]+>", " ")
    # a word border before the label: the letter before it, if any, is no word character
    x = sub(x, rf"(^|[^\p{{L}}\p{{M}}\p{{N}}_])[QA]:{WS}*", r"\1 ")
    x = f"lower({strip_phrases(x)})"
    return collapse(sub(x, r"[\x00-\x08\x0b-\x1f\x7f]", " "))


def index_tokens(x: str) -> str:
    found = rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{M}}\p{{N}}_]{{2,}}')"
    drop = ", ".join(quoted(w) for w in STOPWORDS)
    return f"list_filter({found}, lambda w: w NOT IN ({drop}))"


def truncate_words(x: str, most: int) -> str:
    return f"CASE WHEN len({words(x)}) <= {most} THEN {x} ELSE array_to_string({words(x)}[1:{most}], ' ') || '…' END"


def escape_html(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    return x


LINK = '<a href="\\1" target="_blank" rel="noopener noreferrer">\\1</a>'


def linkify(x: str) -> str:
    return sub(x, r"(https?://[^\s\p{Z}<]+)", LINK)


def linkify_plain(x: str) -> str:
    return sub(x, r"(^|[\s\p{Z}>])(https?://[^\s\p{Z}<]+)", '\\1<a href="\\2" target="_blank" rel="noopener noreferrer">\\2</a>')


def snippet_html(x: str, most: int = 500) -> str:
    return linkify(f"replace({escape_html('(' + truncate_words(x, most) + ')')}, chr(10), '<br>')")


def sentences(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({collapse(x)}, '[^.!?]+[.!?]*'), lambda s: trim(s)), lambda s: s <> '')"


def simple_tokens(x: str) -> str:
    return f"list_filter(string_split_regex({sub(f'lower({x})', '[^a-z0-9 \\t\\n\\r\\f\\v]', ' ')}, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')"


def shorten(x: str, most: int) -> str:
    s = collapse(x)
    return f"CASE WHEN length({s}) > {most} THEN substring({s}, 1, {most}) || '…' ELSE {s} END"


def duration(x: str) -> str:
    s = f"greatest(0, CAST({x} AS BIGINT))"
    return f"CASE WHEN {s} // 60 <= 0 THEN CAST({s} % 60 AS VARCHAR) || 's' ELSE CAST({s} // 60 AS VARCHAR) || 'm ' || CAST({s} % 60 AS VARCHAR) || 's' END"


def sanitize(x: str) -> str:
    x = sub(x, r"(?is)<(?:script|style|iframe|object|embed)\b.*?</(?:script|style|iframe|object|embed)\s*>", "")
    x = sub(x, r"(?is)<(?:script|style|iframe|object|embed|link|meta)\b[^>]*>", "")
    x = sub(x, r"(?is)\s+on[a-z]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "")
    x = sub(x, r"(?is)\s+(?:href|src)\s*=\s*(?:\"\s*javascript:[^\"]*\"|'\s*javascript:[^']*'|javascript:[^\s>]*)", "")
    x = sub(x, r"(?is)(<a\b[^>]*?)\s+(?:target|rel)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", r"\1")
    return sub(x, r"(?is)<a\b([^>]*)>", r'<a\1 target="_blank" rel="noopener noreferrer">')


#: The corpus that stands in for chunks: dense index, shards of 16.
CORPUS = "corpus AS (SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS doc_idx, doc_id, text, source AS source_url, lang AS publisher FROM documents)"


def bm25(shard: str = "CAST(0 AS BIGINT)", queries: str = "SELECT item_id AS qid, text FROM benchmark") -> str:
    """CTEs from corpus to scores(qid, shard, doc_idx, score)."""
    return f"""{CORPUS},
qs AS ({queries}),
toks AS (SELECT {shard} AS shard, doc_idx, {index_tokens("text")} AS t FROM corpus),
post AS (SELECT shard, doc_idx, term, count(*) AS tf FROM (SELECT shard, doc_idx, unnest(t) AS term FROM toks) GROUP BY ALL),
lens AS (SELECT shard, doc_idx, CAST(len(t) AS BIGINT) AS dl FROM toks),
stats AS (SELECT shard, CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl FROM lens GROUP BY shard),
terms AS (SELECT shard, term, CAST(count(*) AS DOUBLE) AS df FROM post GROUP BY shard, term),
qterms AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({index_tokens(clean("text"))}) AS term FROM qs) GROUP BY ALL),
scores AS (
  SELECT qid, shard, doc_idx, sum(qtf * ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * tf / (tf + 15e-1 * (25e-2 + 75e-2 * dl / avgdl))) AS score
  FROM qterms JOIN post USING (term) JOIN terms USING (shard, term) JOIN stats USING (shard) JOIN lens USING (shard, doc_idx)
  GROUP BY qid, shard, doc_idx
),
topk AS (
  SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_idx) AS BIGINT) AS rk, doc_idx, score FROM scores
  QUALIFY rk <= 10
)"""
