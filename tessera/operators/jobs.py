"""Jobs and feedback as immutable tables: each change is a new table, and lookups are filters and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.corpus import dense_index

STATUSES = ("queued", "processing", "done", "failed")
JOBS = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("user_id", T.StringType()), T.StructField("prompt", T.StringType(), False), T.StructField("status", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False), T.StructField("completed_at", T.TimestampNTZType()), T.StructField("response", T.StringType()),
])
FEEDBACK = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("job_id", T.StringType()), *(T.StructField(c, T.LongType(), False) for c in ("relevance", "accuracy", "style")),
    T.StructField("comments", T.StringType()), T.StructField("created_at", T.TimestampNTZType()),
])


def valid(jobs: DataFrame) -> DataFrame:
    """The rows that the table's constraints admit."""
    return jobs.where(F.col("status").isin(*STATUSES) & F.col("prompt").isNotNull() & F.col("id").isNotNull())


def insert(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests(id, user_id, prompt, created_at)`` as queued jobs after ``jobs``."""
    fresh = requests.select("id", "user_id", "prompt", F.lit("queued").alias("status"), "created_at", F.lit(None).cast("timestamp_ntz").alias("completed_at"), F.lit(None).cast("string").alias("response"))
    return jobs.unionByName(fresh)


def lookup(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """The jobs of ``asked(id, user_id)`` that belong to the one who asks."""
    return jobs.join(asked, ["id", "user_id"], "left_semi")


def queued(jobs: DataFrame, limit: int = 10) -> DataFrame:
    return jobs.where(F.col("status") == "queued").orderBy("created_at", "id").limit(limit)


def newest(jobs: DataFrame, limit: int = 20) -> DataFrame:
    """Each user's newest jobs."""
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "id")
    return jobs.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= limit)


def exists(asked: DataFrame, jobs: DataFrame) -> DataFrame:
    """``asked(id)`` with ``found``."""
    return asked.join(jobs.select("id", F.lit(True).alias("found")).distinct(), "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def _set(jobs: DataFrame, ids: DataFrame, when: Column, values: dict[str, Column]) -> DataFrame:
    marked = jobs.join(ids.withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & when
    return marked.withColumn("changed", hit).select(*(F.when(F.col("changed"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in jobs.columns), "changed")


def claim(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Queued jobs among ``ids(id)`` become processing; ``changed`` tells which."""
    return _set(jobs, ids, F.col("status") == "queued", {"status": F.lit("processing")})


def complete(jobs: DataFrame, answers: DataFrame) -> DataFrame:
    """Jobs of ``answers(id, answer, at)`` become done, whatever their state."""
    return _set(jobs, answers, F.lit(True), {"status": F.lit("done"), "completed_at": F.col("at"), "response": F.col("answer")})


def fail(jobs: DataFrame, errors: DataFrame) -> DataFrame:
    """Jobs of ``errors(id, error, at)`` become failed; the error is the response."""
    return _set(jobs, errors, F.lit(True), {"status": F.lit("failed"), "completed_at": F.col("at"), "response": F.col("error")})


def delete(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """Without the jobs of ``asked(id, user_id)`` that belong to the one who asks; feedback stays."""
    return jobs.join(asked, ["id", "user_id"], "left_anti")


def accepted_feedback(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests whose ratings are not zero and whose job exists."""
    fine = F.lit(True)
    for c in ("relevance", "accuracy", "style"):
        fine = fine & F.col(c).isNotNull() & (F.col(c) != 0)
    return requests.where(fine).join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")


def orphans(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    return requests.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_anti")


def insert_feedback(feedback: DataFrame, requests: DataFrame, order: str) -> DataFrame:
    """``requests`` after ``feedback`` with the next ids, in order of a numeric column."""
    last = feedback.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = dense_index(requests, order, "id").withColumn("id", F.col("id") + F.lit(last + 1))
    return feedback.unionByName(fresh.select(*feedback.columns))


def feedback_of(feedback: DataFrame, ids: DataFrame) -> DataFrame:
    """The feedback of the jobs ``ids(job_id)``; newest first where it is shown."""
    return feedback.join(ids, "job_id", "left_semi")


def newest_feedback(feedback: DataFrame) -> DataFrame:
    """Feedback with its rank within its job, newest first."""
    return feedback.withColumn("rk", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("created_at"), F.desc("id"))))


def store(jobs: DataFrame, path: str) -> None:
    """Write jobs in order of status and time: row groups' bounds then serve as the index by status."""
    jobs.repartitionByRange("status", "created_at").sortWithinPartitions("status", "created_at").write.mode("overwrite").parquet(path)


def delete_feedback(feedback: DataFrame, ids: DataFrame) -> DataFrame:
    return feedback.join(ids, "id", "left_anti")
