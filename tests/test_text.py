"""Hand-written edge cases of the text and parameter functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import params as P
from tessera.functions import text as T


def value(spark, make, text):
    return spark.createDataFrame([(text,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Hello <b>World</b>", "hello world"),
        ("kept \" ' </s>gone", "kept"),
        ("a <|end|> b", "a"),
        ("a\n<|EOT_ID|>\nb\nc", "a"),
        ("one </span> two", "one"),
        ("Q: who A: me SQ: no", "who me sq: no"),
        ("see ABOUT US and click here", "see and"),
        ("a\x00b\x07c\x7fd", "a b c d"),
        ("a  b", "a b"),
        ("", ""),
        ("   ", ""),
        (None, None),
    ],
)
def test_clean(spark, text, want):
    assert value(spark, T.clean_retrieval_text, text) == want


def test_truncate_question(spark):
    for n, cut in ((400, False), (401, True)):
        text = "  " + "\t".join(f"w{i}" for i in range(n)) + " "
        row = spark.createDataFrame([(text,)], "x string").select(*T.truncate_question(F.col("x"))).first()
        assert row[1] is cut
        assert row[0] == (" ".join(f"w{i}" for i in range(400)) if cut else text.strip())


@pytest.mark.parametrize(
    ("text", "want"),
    [("Pi is 3.14. Yes! No?", ["Pi is 3.", "14.", "Yes!", "No?"]), ("...lead. x", ["lead.", "x"]), ("no end", ["no end"]), ("", []), ("?!", [])],
)
def test_sentences(spark, text, want):
    assert value(spark, T.sentences, text) == want


@pytest.mark.parametrize(("text", "want"), [("One two three four", ["one two three", "two three four"]), ("a b", []), ("", [])])
def test_trigrams(spark, text, want):
    assert value(spark, lambda x: T.trigrams(T.simple_tokens(x)), text) == want


def test_terms(spark):
    assert value(spark, T.term_set, "The café THE a-b Roses roses") == ["the", "caf", "roses"]


def test_tokens(spark):
    assert value(spark, T.index_tokens, "The École of a x_1 d’eau") == ["école", "x_1", "eau"]


@pytest.mark.parametrize(
    ("text", "most", "want"), [("a  b", 2, "a  b"), ("a  b c", 2, "a b…"), ("", 2, "")]
)
def test_truncate_words(spark, text, most, want):
    assert value(spark, lambda x: T.truncate_words(x, most), text) == want


def test_snippet(spark):
    got = value(spark, T.snippet_html, "a & 'b'\nhttp://x.y/z?q=1&r=2")
    assert got == 'a &amp; &#x27;b&#x27;<br><a href="http://x.y/z?q=1&amp;r=2" target="_blank" rel="noopener noreferrer">http://x.y/z?q=1&amp;r=2</a>'


@pytest.mark.parametrize(("s", "want"), [(-3, "0s"), (0, "0s"), (59, "59s"), (60, "1m 0s"), (3601, "60m 1s")])
def test_duration(spark, s, want):
    assert spark.range(1).select(T.duration(F.lit(s)).alias("y")).first()["y"] == want


@pytest.mark.parametrize(("u", "want"), [(None, ""), (" ", ""), ("HTTP://a", "HTTP://a"), ("//a.b/c", "https://a.b/c"), ("a.b", "https://a.b")])
def test_https(spark, u, want):
    assert value(spark, T.https_url, u) == want


@pytest.mark.parametrize(("u", "want"), [("www.a.info/x", True), ("a.b", False), ("nothing here", False), ("", False), ("HTTPS://", True), ("a.com", True)])
def test_looks_like_url(spark, u, want):
    assert value(spark, T.looks_like_url, u) is want


def test_first_filled(spark):
    row = spark.createDataFrame([("", None, "c")], "a string, b string, c string").select(T.first_filled(F.col("a"), F.col("b"), F.col("c")).alias("y")).first()
    assert row["y"] == "c"


def test_sanitize(spark):
    got = value(spark, T.sanitize_html, '<p onclick="x()">a<script>b</script><a href="javascript:x" rel=no>c</a></p>')
    assert got == '<p>a<a target="_blank" rel="noopener noreferrer">c</a></p>'


@pytest.mark.parametrize(
    ("payload", "top_k", "error"),
    [
        ('{"query":"a"}', 10, None),
        ('{"query":"a","max_n":"7"}', 7, None),
        ('{"query":"a","top_k":0}', 0, "Field 'top_k' must be between 1 and 200"),
        ('{"query":"a","top_k":201}', 201, "Field 'top_k' must be between 1 and 200"),
        ('{"query":" "}', 10, "Field 'query' must be a non-empty string"),
        ('{"query":"a","top_k":"x"}', None, "Field 'top_k'/'max_n' must be an integer"),
        ('{"query":"a","shard_k":300}', 10, "Field 'shard_k' must be between 1 and 200"),
        ("not json", 10, "Field 'query' must be a non-empty string"),
    ],
)
def test_search_request(spark, payload, top_k, error):
    row = spark.createDataFrame([(payload,)], "p string").select(*(c.alias(k) for k, c in P.search_request(F.col("p")).items())).first()
    assert (row["top_k"], row["error"]) == (top_k, error)


@pytest.mark.parametrize(
    ("payload", "want"),
    [('{"k":3}', 3), ('{"k":"+4"}', 4), ('{"k":"4.5"}', -1), ('{"k":true}', 1), ("{}", -1), ('{"k":null}', -1), ("broken", -1)],
)
def test_payload_int(spark, payload, want):
    assert value(spark, lambda x: P.payload_int(x, "k", F.lit(-1)), payload) == want


def test_strict_bool_raises(spark):
    assert value(spark, P.strict_bool, " true ") is True
    with pytest.raises(Exception, match="neither"):
        value(spark, P.strict_bool, "perhaps")


@pytest.mark.parametrize(
    ("at", "want"),
    [("2024-01-15 13:59:59", False), ("2024-01-15 14:00:00", True), ("2024-07-15 13:00:00", True), ("2024-07-16 01:59:59", True), ("2024-07-16 02:00:00", False), ("2024-03-10 13:00:00", True)],
)
def test_hours_follow_daylight_saving(spark, at, want):
    assert value(spark, lambda x: P.in_hours(x.cast("timestamp_ntz")), at) is want


@pytest.mark.parametrize(("x", "want"), [("12px", 10), ("-3", 1), ("px", None), (" +7", 7), (None, None)])
def test_rating(spark, x, want):
    assert value(spark, P.rating, x) == want
