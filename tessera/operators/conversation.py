"""Conversation history: turns, titles, previews, capped lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

# Caps of the client's lists and lengths of its labels.
MOST_HISTORY, MOST_SAVED, MOST_FEEDBACK, MOST_REFERENCES = 50, 25, 200, 10
TITLE, PREVIEW, LABEL = 42, 60, 120
UNTITLED = "Conversation"
# End of fixed values.


def turns(messages: DataFrame) -> DataFrame:
    """conv_id, turn, user, assistant: each user message with the assistant's that follows it, else ''."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    spoken = messages.where(F.col("role").isin("user", "assistant"))
    paired = spoken.withColumns({"next_role": F.lead("role").over(order), "next_text": F.lead("text").over(order)}).where(F.col("role") == "user")
    return paired.select("conv_id", "turn", F.col("text").alias("user"), F.when(F.col("next_role") == "assistant", F.col("next_text")).otherwise("").alias("assistant"))


def newest(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The ``most`` newest rows of each key; none for 0."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_rk", rank).where(F.col("_rk") <= most).drop("_rk")


def title(conversations: DataFrame) -> DataFrame:
    """conv_id, title: the first user text that is not empty."""
    first = conversations.where(~T.blank(F.col("user"))).groupBy("conv_id").agg(F.min_by("user", "turn").alias("user"))
    every = conversations.select("conv_id").distinct().join(first, "conv_id", "left")
    return every.select("conv_id", T.shorten(F.coalesce("user", F.lit(UNTITLED)), TITLE).alias("title"))


def preview(conversations: DataFrame) -> DataFrame:
    """conv_id, preview: the last turn's answer, or else its question."""
    last = conversations.groupBy("conv_id").agg(F.max_by(F.struct("user", "assistant"), "turn").alias("t"))
    return last.select("conv_id", T.shorten(F.when(T.blank(F.col("t.assistant")), F.col("t.user")).otherwise(F.col("t.assistant")), PREVIEW).alias("preview"))


def recent(saved: DataFrame, most: int = MOST_SAVED) -> DataFrame:
    """``saved(id, saved_at)``: the most recent, a missing time counting as 0."""
    return saved.withColumn("saved_at", F.coalesce("saved_at", F.lit(0))).orderBy(F.desc("saved_at"), "id").limit(most)


def saved_json(conversations: DataFrame) -> DataFrame:
    """id, body: each conversation as the JSON that is stored."""
    listed = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "user", "assistant"))).alias("t"))
    return listed.select(F.col("conv_id").alias("id"), F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["user"].alias("user"), x["assistant"].alias("assistant"))).alias("turns"))).alias("body"))


def load_json(body: Column) -> Column:
    """The turns of a stored conversation; none where it cannot be read."""
    return F.coalesce(F.from_json(body, "turns array<struct<user:string,assistant:string>>")["turns"], F.array().cast("array<struct<user:string,assistant:string>>"))


def references(results: Column) -> Column:
    """The references of a JSON list of results: at most MOST_REFERENCES, fields by their first filled name."""
    fields = "title string, source_title string, source string, publication string, snippet string, text string, excerpt string, url string, link string"
    parsed = F.slice(F.coalesce(F.from_json(results, f"array<struct<{fields.replace(' string', ':string')}>>"), F.array().cast(f"array<struct<{fields.replace(' string', ':string')}>>")), 1, MOST_REFERENCES)
    return F.transform(parsed, lambda r: F.struct(
        T.first_filled(r["title"], r["source_title"], F.lit("Reference")).alias("title"),
        T.first_filled(r["source"], r["publication"], F.lit("Corpus")).alias("source"),
        T.first_filled(r["snippet"], r["text"], r["excerpt"], F.lit("")).alias("snippet"),
        T.first_filled(r["url"], r["link"], F.lit("")).alias("url"),
    ))


def label(snippet: Column) -> Column:
    return T.shorten(F.coalesce(snippet, F.lit("")), LABEL)


def without(conversations: DataFrame, ids: DataFrame) -> DataFrame:
    return conversations.join(ids, "conv_id", "left_anti")


def updated(messages: DataFrame, responses: DataFrame) -> DataFrame:
    """``messages(job_id, text)`` with the text of a delayed response, where one came."""
    return messages.join(responses.select("job_id", F.col("text").alias("_late")), "job_id", "left").withColumn("text", F.coalesce("_late", "text")).drop("_late")
