"""BM25 full-text top-k over a table of queries, on one index or by shard.

The index is tokens or stored postings (term, doc_idx, tf, dl, group), and
lengths and statistics by group, a group being the whole corpus or a shard.
Texts stay out of it; they are joined to the few rows that are left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

# The saved index's parameters.
K1, B = 1.5, 0.75
# End of fixed values.


@dataclass(frozen=True)
class Index:
    tokens: DataFrame  # shard, doc_idx, dl, term, tf: one row an occurrence (tf 1), or one a posting of a stored index
    lengths: DataFrame  # shard, doc_idx, dl
    stats: DataFrame  # shard, n, avgdl

    @property
    def postings(self) -> DataFrame:
        return _counted(self.tokens)

    @property
    def terms(self) -> DataFrame:
        return _document_frequency(self.postings)


def _counted(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("shard", "doc_idx", "dl", "term").agg(F.sum("tf").alias("tf"))


def _document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("shard", "term").agg(F.count(F.lit(1)).alias("df"))


def build(corpus: DataFrame, shard: Column | None = None) -> Index:
    """``corpus(doc_idx, text)``. Empty documents count for n and the mean length."""
    place = (shard if shard is not None else F.lit(0).cast("long")).alias("shard")
    cut = corpus.select(place, "doc_idx", T.index_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    lengths = cut.select("shard", "doc_idx", F.size("t").cast("long").alias("dl"))
    tokens = cut.select("shard", "doc_idx", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term"), F.lit(1).cast("long").alias("tf"))
    stats = lengths.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return Index(tokens, lengths, stats)


def term_frequency(corpus: DataFrame, shard: Column | None = None) -> DataFrame:
    return build(corpus, shard).postings.select("shard", "doc_idx", "term", "tf")


def store(index: Index, path: str) -> None:
    """Write an index: postings sorted by term, so that a lookup reads few row groups, lengths, and statistics."""
    index.postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    index.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")


def load(spark: SparkSession, path: str) -> Index:
    """A stored index; one that is not whole is an error."""
    tables = {}
    for name, columns in (("postings", {"shard", "doc_idx", "dl", "term", "tf"}), ("lengths", {"shard", "doc_idx", "dl"}), ("stats", {"shard", "n", "avgdl"})):
        tables[name] = spark.read.parquet(f"{path}/{name}")
        if missing := columns - set(tables[name].columns):
            raise ValueError(f"{name} of the index lacks {sorted(missing)}")
    index = Index(tables["postings"], tables["lengths"], tables["stats"])
    counted = index.lengths.groupBy("shard").agg(F.count(F.lit(1)).alias("held"))
    if not index.stats.join(counted, "shard", "full").where("n IS NULL OR held IS NULL OR n <> held").isEmpty():
        raise ValueError("the index's statistics and documents do not agree")
    return index


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def query_terms(queries: DataFrame) -> DataFrame:
    """``queries(qid, text)``: qid, term, qtf; blank queries have no terms."""
    return queries.select("qid", F.explode(T.query_tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


def scores(index: Index, queries: DataFrame) -> DataFrame:
    """qid, shard, doc_idx, score for every document that shares a term with the query.

    Tokens are cut to the queries' terms before they are counted, so only what can score is shuffled. A table of
    terms that is small enough goes to the tokens by broadcast, which Spark decides by its size.
    """
    q = query_terms(queries)
    met = _counted(index.tokens.join(q.select("term").distinct(), "term", "left_semi"))
    weight = _document_frequency(met).join(index.stats, "shard").select("shard", "term", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))
    met = met.join(weight, ["shard", "term"]).join(q, "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") / (F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.col("avgdl")))
    return met.groupBy("qid", "shard", "doc_idx").agg(F.sum(part).alias("score"))


def candidate_counts(found: DataFrame) -> DataFrame:
    """``scores``: how many documents each query can choose from, as the search log tells."""
    return found.groupBy("qid").agg(F.count(F.lit(1)).alias("candidates"))


def ranked(hits: DataFrame, k: Column | int, *keys: str) -> DataFrame:
    """The first k of each query by score to six places, then doc_idx."""
    order = Window.partitionBy("qid", *keys).orderBy(F.round("score", 6).desc(), "doc_idx")
    return hits.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)


def top_k(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    return ranked(scores(index, queries), k).select("qid", F.col("rk").cast("long").alias("rk"), "doc_idx", "score")


def shard_top_k(index: Index, queries: DataFrame, k: int = 10, per_shard_k: int = 30) -> DataFrame:
    """Top lists of each shard, united; a document's best score counts."""
    near = ranked(scores(index, queries), min(k, per_shard_k), "shard")
    best = near.groupBy("qid", "doc_idx").agg(F.max("score").alias("score"))
    return ranked(best, k).select("qid", F.col("rk").cast("long").alias("rk"), "doc_idx", "score")


def top_k_padded(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """Exactly k rows a query (all documents if fewer): after the hits, lowest doc_idx first with score 0."""
    hits = top_k(index, queries, k)
    few = index.lengths.orderBy("doc_idx").limit(2 * k).select("doc_idx")  # k hits can hide k of these at most
    every = queries.select("qid").distinct().withColumn("doc_idx", F.explode(F.lit([r["doc_idx"] for r in few.collect()]).cast("array<bigint>")))
    pad = every.join(hits, ["qid", "doc_idx"], "left_anti").withColumn("score", F.lit(0.0))
    return ranked(hits.select("qid", "doc_idx", "score").unionByName(pad), k).select("qid", F.col("rk").cast("long").alias("rk"), "doc_idx", "score")


def hits(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """Result rows: row_id, source, title, publisher, found_on, text, snippet, snippet_html, score_bm25."""
    row_id = T.first_filled(F.col("chunk_id").cast("string"), F.col("doc_idx").cast("string")) if "chunk_id" in corpus.columns else F.col("doc_idx").cast("string")
    none = lambda c: F.when(T.blank(F.col(c)), "").otherwise(F.col(c))
    return found.join(corpus, "doc_idx").select(
        "qid",
        "rk",
        row_id.alias("row_id"),
        none("source_url").alias("source"),
        none("title").alias("title"),
        none("publisher").alias("publisher"),
        none("found_on").alias("found_on"),
        none("text").alias("text"),
        F.substring(none("text"), 1, T.SNIPPET_CHARS).alias("snippet"),
        T.snippet_html(none("text")).alias("snippet_html"),
        F.col("score").cast("double").alias("score_bm25"),
    )


def envelope(queries: DataFrame, found: DataFrame) -> DataFrame:
    """One row a query: its number of results, message and result ids by rank; blank queries included."""
    lists = found.groupBy("qid").agg(F.count(F.lit(1)).alias("num"), F.transform(F.array_sort(F.collect_list(F.struct("rk", "row_id"))), lambda x: x["row_id"]).alias("ids"))
    joined = queries.join(lists, "qid", "left")
    num = F.coalesce("num", F.lit(0)).cast("long")
    empty = F.coalesce(T.strip(F.col("text")), F.lit("")) == ""
    message = F.when(empty, "Empty query.").otherwise(F.concat(F.lit("Found "), num.cast("string"), F.lit(" result(s).")))
    return joined.select("qid", num.alias("num_results"), message.alias("message"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("row_ids"))
