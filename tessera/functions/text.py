"""Text functions as Column expressions: cleaning, tokens, sentences, snippets, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits, phrases and stop marks of the service that this engine answers for.
MAX_QUESTION_WORDS = 400
MAX_REFERENCE_WORDS = 900
SNIPPET_CHARS = 1200
SNIPPET_WORDS = 500
PHRASES = ("click here", "more along these lines", "about us")
STOP_MARKS = ("</s", "<|end|>", "<|eot_id|>")
STOPWORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()
# End of fixed values.

SPACE = r"(?U)\s+"
_STOP = r"(?isU)[\s\"']*(?:</s|<\|end\|>|<\|eot_id\|>).*\z"


def strip(x: Column) -> Column:
    """Without white space at both ends, any Unicode white space counting."""
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, SPACE, " "))


def words(x: Column) -> Column:
    """White-space separated words; none for a blank text."""
    return F.filter(F.split(x, SPACE), lambda w: w != "")


def truncate_question(x: Column, most: int = MAX_QUESTION_WORDS) -> tuple[Column, Column]:
    """The question, cut to ``most`` words if it has more, and whether it was cut."""
    w = words(x)
    cut = F.size(w) > most
    return F.when(cut, F.array_join(F.slice(w, 1, most), " ")).otherwise(strip(x)), cut


def strip_stops(x: Column) -> Column:
    """Cut at the first stop mark, with the white space and quotes before it."""
    return F.regexp_replace(F.regexp_replace(x, _STOP, ""), r"(?U)\s+\z", "")


def strip_phrases(x: Column) -> Column:
    return F.regexp_replace(x, "(?i)(" + "|".join(PHRASES) + ")", " ")


def clean_retrieval_text(x: Column) -> Column:
    x = F.regexp_replace(strip_stops(x), "<[^>]+>", " ")
    x = F.lower(strip_phrases(F.regexp_replace(x, r"(?U)\b(?:Q:\s*|A:\s*)", " ")))
    return collapse(F.regexp_replace(x, r"[\x00-\x08\x0b-\x1f\x7f]", " "))


def index_tokens(x: Column, stopwords: list[str] | None = None) -> Column:
    """Lower-case words of two letters or more without stopwords."""
    found = F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\b\w\w+\b"), 0)
    drop = STOPWORDS if stopwords is None else stopwords
    return F.filter(found, lambda w: ~w.isin(drop)) if drop else found


def query_tokens(x: Column, stopwords: list[str] | None = None) -> Column:
    return index_tokens(clean_retrieval_text(x), stopwords)


def linkify(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)(https?://[^\s<]+)", r'<a href="$1" target="_blank" rel="noopener noreferrer">$1</a>')


def linkify_plain(x: Column) -> Column:
    """Only urls at the start or after white space or ``>``."""
    return F.regexp_replace(x, r"(?U)(^|[\s>])(https?://[^\s<]+)", r'$1<a href="$2" target="_blank" rel="noopener noreferrer">$2</a>')


def truncate_words(x: Column, most: int) -> Column:
    w = words(x)
    return F.when(F.size(w) <= most, x).otherwise(F.concat(F.array_join(F.slice(w, 1, most), " "), F.lit("…")))


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def snippet_html(x: Column, most: int = SNIPPET_WORDS) -> Column:
    return linkify(F.replace(escape_html(truncate_words(x, most)), F.lit("\n"), F.lit("<br>")))


def sentences(x: Column) -> Column:
    found = F.regexp_extract_all(collapse(x), F.lit(r"[^.!?]+[.!?]*"), 0)
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def simple_tokens(x: Column) -> Column:
    """ASCII words in order, repeats included."""
    return F.filter(F.split(F.regexp_replace(F.lower(x), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: w != "")


def term_set(x: Column) -> Column:
    return F.array_distinct(F.filter(simple_tokens(x), lambda w: F.length(w) > 2))


def trigrams(tokens: Column) -> Column:
    n = F.size(tokens)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.array_join(F.slice(tokens, i, 3), " "))).otherwise(F.array().cast("array<string>"))


def https_url(x: Column) -> Column:
    s = strip(F.coalesce(x, F.lit("")))
    return F.when(s == "", "").when(s.rlike("(?i)^https?://"), s).otherwise(F.concat(F.lit("https://"), F.regexp_replace(s, "^/+", "")))


def looks_like_url(x: Column) -> Column:
    s = strip(F.coalesce(x, F.lit("")))
    return s.rlike("(?i)^https?://") | s.rlike(r"(?i)^[a-z0-9.-]+\.[a-z]{2,}(/|\z)")


def reference_link(url: Column, source: Column) -> Column:
    u, s = strip(F.coalesce(url, F.lit(""))), strip(F.coalesce(source, F.lit("")))
    return F.when(u != "", u).when(looks_like_url(s), s).otherwise("")


def shorten(x: Column, most: int) -> Column:
    """White space collapsed; beyond ``most`` characters cut and marked."""
    s = collapse(strip(x))
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("…"))).otherwise(s)


def duration(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), seconds.cast("long"))
    m, r = F.floor(s / 60).cast("long"), (s % 60)
    return F.when(m <= 0, F.concat(r.cast("string"), F.lit("s"))).otherwise(F.concat(m.cast("string"), F.lit("m "), r.cast("string"), F.lit("s")))


def sanitize_html(x: Column) -> Column:
    """Without active elements, handlers and script links; anchors open safely. Works on the markup, not on a document tree."""
    x = F.regexp_replace(x, r"(?is)<(script|style|iframe|object|embed)\b.*?</(script|style|iframe|object|embed)\s*>", "")
    x = F.regexp_replace(x, r"(?is)<(script|style|iframe|object|embed|link|meta)\b[^>]*>", "")
    x = F.regexp_replace(x, r"(?is)\s+on[a-z]+\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "")
    x = F.regexp_replace(x, r"(?is)\s+(href|src)\s*=\s*(\"\s*javascript:[^\"]*\"|'\s*javascript:[^']*'|javascript:[^\s>]*)", "")
    x = F.regexp_replace(x, r"(?is)(<a\b[^>]*?)\s+(target|rel)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "$1")
    return F.regexp_replace(x, r"(?is)<a\b([^>]*)>", '<a$1 target="_blank" rel="noopener noreferrer">')


def visible_text(x: Column, most: int = SNIPPET_WORDS) -> Column:
    """The first ``most`` words of what the markup shows."""
    return truncate_words(collapse(F.regexp_replace(sanitize_html(x), "<[^>]+>", " ")), most)


def blank(x: Column) -> Column:
    """Missing or empty: what falls through to the next alternative."""
    return x.isNull() | (x.cast("string") == "") | (x.cast("string") == "NaN")


def first_filled(*options: Column) -> Column:
    """The first alternative that is neither missing nor empty, else the last."""
    out = options[-1]
    for x in reversed(options[:-1]):
        out = F.when(blank(x), out).otherwise(x)
    return out
