"""Queries of this package over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Each query imports its own operator: Python workers then load that one alone.


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import url_filter

    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import ngram_jaccard

    return ngram_jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import sharding

    return sharding.shard(_table(spark, sf_dir, "documents"), 40)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import quality

    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    from tessera.llm import langid

    return langid.identify(_table(spark, sf_dir, "documents"), public.path("byte_bpe_multi_50k.tiktoken"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import decontaminate

    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import hmm

    return hmm.score(_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    from tessera.llm import bpe

    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import line_dedup

    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), least=1)
    return out.select("doc_id", "text", "n_lines", F.array_join("removed", ",").alias("removed"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import topk

    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5, 256.0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT DISTINCT ON (vec_id) vec_id, e FROM v WHERE vec_id % 50 = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(%s, '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+')"

# Shingles as texts; a text of fewer words than five is one shingle of them all, which no shingle of five equals.
OP2_SQL = f"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS % "coalesce(text, '')"} AS w FROM documents),
s AS (
  SELECT r, doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END AS g
  FROM t
),
e AS (SELECT r, unnest(g) AS x FROM s WHERE doc_id IS NOT NULL),
c AS (SELECT a.r AS ra, b.r AS rb, count(*) AS both_ FROM e a JOIN e b ON a.x = b.x AND a.r < b.r GROUP BY ALL),
l AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM c JOIN s a ON a.r = ra JOIN s b ON b.r = rb
  WHERE 100 * both_ >= 75 * (len(a.g) + len(b.g) - both_)
),
n AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id AS id, doc_id AS other FROM documents WHERE doc_id IS NOT NULL UNION SELECT reach.id, n.b FROM reach JOIN n ON n.a = reach.other),
m AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM s LEFT JOIN m ON m.id = s.doc_id
"""

# Two similar lines share one of their first n - ceil(3 n / 4) + 1 words by rising count.
OP9_SQL = f"""
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
k AS (SELECT row_number() OVER () AS r, doc_id, line, list_distinct({_WORDS % "t"}) AS w FROM (SELECT doc_id, unnest(a) AS t, generate_subscripts(a, 1) - 1 AS line FROM p)),
f AS (SELECT x, count(*) AS df FROM (SELECT unnest(w) AS x FROM k) GROUP BY x),
o AS (SELECT r, x, row_number() OVER (PARTITION BY r ORDER BY df, x) AS pos FROM (SELECT r, unnest(w) AS x FROM k) JOIN f USING (x)),
h AS (SELECT k.*, o.x FROM o JOIN k USING (r) WHERE pos <= len(w) - (3 * len(w) + 3) // 4 + 1),
c AS (
  SELECT DISTINCT a.r AS ra, b.r AS rb FROM h a JOIN h b ON a.x = b.x AND (a.doc_id > b.doc_id OR (a.doc_id = b.doc_id AND a.line > b.line))
  WHERE 4 * len(a.w) >= 3 * len(b.w) AND 4 * len(b.w) >= 3 * len(a.w)
),
g AS (
  SELECT doc_id, list_sort(list_distinct(list(CAST(line AS BIGINT)))) AS removed FROM (
    SELECT a.doc_id, a.line, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS n FROM c JOIN k a ON a.r = ra JOIN k b ON b.r = rb)
  WHERE 100 * i >= 75 * (n - i) GROUP BY doc_id
),
d AS (SELECT doc_id, text, coalesce(string_split(text, chr(10)), CAST([] AS VARCHAR[])) AS a, coalesce(removed, CAST([] AS BIGINT[])) AS removed FROM documents LEFT JOIN g USING (doc_id))
SELECT doc_id, CASE WHEN len(removed) = 0 THEN text ELSE array_to_string([a[i] FOR i IN range(1, len(a) + 1) IF NOT list_contains(removed, i - 1)], chr(10)) END AS text,
  CAST(len(a) AS INTEGER) AS n_lines, array_to_string(removed, ',') AS removed
FROM d
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_ngram_jaccard": op2_ngram_jaccard,
        "op3_sharding": op3_sharding,
        "op4_quality": op4_quality,
        "op5_langid": op5_langid,
        "op6_decontaminate": op6_decontaminate,
        "op7_hmm": op7_hmm,
        "op8_bpe": op8_bpe,
        "op9_line_dedup": op9_line_dedup,
        "op10_top_k": op10_top_k,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": OP2_SQL, "op9_line_dedup": OP9_SQL, "op10_top_k": OP10_SQL}
