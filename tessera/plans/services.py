"""Queries of jobs, feedback and the services' state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import params as P
from tessera.operators import jobs as J
from tessera.operators import stateful as S
from tessera.plans.registry import Tables, query

# Orders stand in for jobs, labels for feedback requests.

JOBS = """jobs AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user_id, o_orderpriority AS prompt,
 CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'processing' ELSE 'done' END AS status, o_orderdate AS created_at,
 CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS completed_at, CASE WHEN o_orderstatus = 'F' THEN 'answer ' || o_orderkey END AS response FROM orders)"""
REQUESTS = """requests AS (SELECT doc_id, CAST(doc_id * 20 AS VARCHAR) AS job_id, CAST(quality AS BIGINT) AS relevance, CAST(1 + toxic AS BIGINT) AS accuracy, CAST(1 + quality AS BIGINT) AS style FROM labels),
feedback AS (SELECT CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS id, job_id, relevance, accuracy, style FROM requests)"""


def jobs(t: Tables) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    return t("orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderpriority").alias("prompt"),
        F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "processing").otherwise("done").alias("status"),
        F.col("o_orderdate").alias("created_at"), F.when(done, F.expr("o_orderdate + INTERVAL 1 DAY")).alias("completed_at"),
        F.when(done, F.concat(F.lit("answer "), F.col("o_orderkey").cast("string"))).alias("response"),
    )


def requests(t: Tables) -> DataFrame:
    return t("labels").select(
        "doc_id", (F.col("doc_id") * 20).cast("string").alias("job_id"), F.col("quality").cast("long").alias("relevance"), (1 + F.col("toxic")).cast("long").alias("accuracy"), (1 + F.col("quality")).cast("long").alias("style")
    )


def feedback(t: Tables) -> DataFrame:
    asked = requests(t)
    none = asked.where(F.lit(False)).select(F.lit(0).cast("long").alias("id"), "job_id", "relevance", "accuracy", "style")
    return J.insert_feedback(none, asked, "doc_id")


@query(f"WITH {JOBS} SELECT id, user_id, prompt, status FROM jobs UNION ALL SELECT 'new-' || c_custkey, CAST(c_custkey AS VARCHAR), c_name, 'queued' FROM customer")
def jobs_insert(t: Tables) -> DataFrame:
    fresh = t("customer").select(F.concat(F.lit("new-"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_custkey").cast("string").alias("user_id"), F.col("c_name").alias("prompt"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"))
    return J.valid(J.insert(jobs(t), fresh)).select("id", "user_id", "prompt", "status")


@query(f"WITH {JOBS} SELECT id, status FROM jobs WHERE CAST(id AS BIGINT) % 2 = 0")
def job_lookup(t: Tables) -> DataFrame:
    """Every job is asked for; every second one by its owner."""
    own = jobs(t).select("id", F.when(F.col("id").cast("long") % 2 == 0, F.col("user_id")).otherwise("stranger").alias("user_id"))
    return J.lookup(jobs(t), own).select("id", "status")


@query(f"WITH {JOBS} SELECT id, user_id FROM jobs WHERE status = 'queued' ORDER BY created_at, id LIMIT 10")
def jobs_queued_fifo(t: Tables) -> DataFrame:
    return J.queued(jobs(t)).select("id", "user_id")


@query(f"WITH {JOBS} SELECT user_id, id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS BIGINT) AS rk FROM jobs QUALIFY rk <= 20")
def jobs_for_user(t: Tables) -> DataFrame:
    return J.newest(jobs(t)).select("user_id", "id", F.col("rk").cast("long").alias("rk"))


@query(f"WITH {JOBS}, {REQUESTS} SELECT doc_id, job_id AS id, EXISTS (SELECT 1 FROM jobs WHERE jobs.id = requests.job_id) AS found FROM requests")
def job_exists(t: Tables) -> DataFrame:
    return J.exists(requests(t).select("doc_id", F.col("job_id").alias("id")), jobs(t)).select("doc_id", "id", "found")


@query(f"WITH {JOBS} SELECT id, CASE WHEN status = 'queued' AND CAST(id AS BIGINT) % 3 = 0 THEN 'processing' ELSE status END AS status, status = 'queued' AND CAST(id AS BIGINT) % 3 = 0 AS changed FROM jobs")
def mark_processing(t: Tables) -> DataFrame:
    return J.claim(jobs(t), jobs(t).where(F.col("id").cast("long") % 3 == 0).select("id")).select("id", "status", "changed")


@query(f"WITH {JOBS} SELECT id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'done' ELSE status END AS status, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'late ' || id ELSE response END AS response FROM jobs")
def mark_done(t: Tables) -> DataFrame:
    answers = jobs(t).where(F.col("id").cast("long") % 3 == 0).select("id", F.concat(F.lit("late "), "id").alias("answer"), F.col("created_at").alias("at"))
    return J.complete(jobs(t), answers).select("id", "status", "response")


@query(f"WITH {JOBS} SELECT id, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 'error' ELSE response END AS response FROM jobs")
def mark_failed(t: Tables) -> DataFrame:
    errors = jobs(t).where(F.col("id").cast("long") % 5 == 0).select("id", F.lit("error").alias("error"), F.col("created_at").alias("at"))
    return J.fail(jobs(t), errors).select("id", "status", "response")


@query(f"WITH {JOBS} SELECT id, user_id FROM jobs WHERE NOT CAST(id AS BIGINT) % 4 = 0")
def delete_job(t: Tables) -> DataFrame:
    asked = jobs(t).where(F.col("id").cast("long") % 2 == 0).select("id", F.when(F.col("id").cast("long") % 4 == 0, F.col("user_id")).otherwise("stranger").alias("user_id"))
    return J.delete(jobs(t), asked).select("id", "user_id")


@query(f"WITH {JOBS}, {REQUESTS}, ok AS (SELECT * FROM requests WHERE relevance <> 0 AND accuracy <> 0 AND style <> 0 AND job_id IN (SELECT id FROM jobs)) SELECT CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS id, job_id, relevance, accuracy, style FROM ok")
def feedback_insert(t: Tables) -> DataFrame:
    good = J.accepted_feedback(requests(t), jobs(t))
    none = good.where(F.lit(False)).select(F.lit(0).cast("long").alias("id"), "job_id", "relevance", "accuracy", "style")
    return J.insert_feedback(none, good, "doc_id")


@query(f"WITH {JOBS}, {REQUESTS} SELECT doc_id, job_id FROM requests WHERE job_id NOT IN (SELECT id FROM jobs)")
def feedback_rejected(t: Tables) -> DataFrame:
    return J.orphans(requests(t), jobs(t)).select("doc_id", "job_id")


@query(f"WITH {JOBS}, {REQUESTS} SELECT id FROM jobs WHERE id IN (SELECT job_id FROM feedback)")
def feedback_exists(t: Tables) -> DataFrame:
    return jobs(t).join(feedback(t).select(F.col("job_id").alias("id")), "id", "left_semi").select("id")


@query(f"WITH {JOBS}, {REQUESTS} SELECT j.id AS job_id, f.id, f.relevance, f.accuracy, f.style FROM jobs j JOIN feedback f ON f.job_id = j.id")
def feedback_for_job(t: Tables) -> DataFrame:
    return J.feedback_of(feedback(t), jobs(t).select(F.col("id").alias("job_id"))).select("job_id", "id", "relevance", "accuracy", "style")


@query(f"WITH {REQUESTS} SELECT id, job_id, relevance FROM feedback WHERE id = 7")
def feedback_by_id(t: Tables) -> DataFrame:
    return feedback(t).where("id = 7").select("id", "job_id", "relevance")


@query(f"WITH {REQUESTS} SELECT id, job_id FROM feedback WHERE id % 10 <> 0")
def delete_feedback(t: Tables) -> DataFrame:
    all_ = feedback(t)
    return J.delete_feedback(all_, all_.where("id % 10 = 0").select("id")).select("id", "job_id")


# Events stand in for the request log.

_T = "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)"


@query(f"SELECT event_id, user_id, coalesce({_T} - lag({_T}) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 30, true) AS allowed FROM events")
def rate_limit(t: Tables) -> DataFrame:
    return S.rate_limit(t("events")).select("event_id", "user_id", "allowed")


@query(f"""WITH {JOBS}, line AS (SELECT user_id, row_number() OVER (ORDER BY created_at, id) - 1 AS p FROM jobs WHERE status = 'queued'), f AS (SELECT user_id, min(p) AS p FROM line GROUP BY user_id)
SELECT u.user_id, CAST(coalesce(p, 0) AS BIGINT) AS position FROM (SELECT DISTINCT user_id FROM jobs) u LEFT JOIN f USING (user_id)""")
def queue_position(t: Tables) -> DataFrame:
    return S.queue_position(jobs(t))


@query(f"WITH {JOBS} SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'processing') AS inflight, count(*) FILTER (status IN ('queued', 'processing')) AS depth FROM jobs")
def queue_depth(t: Tables) -> DataFrame:
    return S.queue_depth(jobs(t))


@query("SELECT event_id, CAST(sum(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (ORDER BY ts, event_id) AS BIGINT) AS depth FROM events")
def inflight_depth(t: Tables) -> DataFrame:
    delta = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return S.inflight_depth(t("events"), delta).select("event_id", F.col("depth").cast("long").alias("depth"))


MAILBOX = """WITH e AS (SELECT *, sum(CASE event_type WHEN 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events),
p AS (SELECT user_id, event_id, ts, a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM e WHERE event_type = 'view'),
d AS (SELECT *, i + least(0, min(a - i) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS d FROM p),
g AS (SELECT *, d > coalesce(lag(d) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS takes FROM d)
SELECT g.user_id, g.event_id, r.event_id AS response_id FROM g LEFT JOIN (SELECT user_id, event_id, a FROM e WHERE event_type = 'purchase') r ON r.user_id = g.user_id AND g.takes AND r.a = g.d"""


@query(MAILBOX)
def mailbox_pop(t: Tables) -> DataFrame:
    return S.mailbox(t("events"), F.col("event_type") == "purchase", F.col("event_type") == "view").select("user_id", "event_id", "response_id")


@query("WITH h AS (SELECT event_id, event_type, hour((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS h FROM events) SELECT event_id, h >= 9 AND h < 22 AS open, event_type IN ('signup', 'view') OR (h >= 9 AND h < 22) AS admitted FROM h")
def service_hours(t: Tables) -> DataFrame:
    endpoint = F.when(F.col("event_type") == "signup", "/api/unlock").when(F.col("event_type") == "view", "/api/queue").otherwise("/api/chat")
    return t("events").select("event_id", P.in_hours(F.col("ts")).alias("open"), P.gate(endpoint, F.col("ts")).alias("admitted"))


@query("SELECT event_id, user_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def dedup_consecutive(t: Tables) -> DataFrame:
    return S.changed_only(t("events"), "user_id", "event_type").select("event_id", "user_id")


def _gate_sql(seconds: int, compare: str, forced: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_id, {_T} AS t, {forced} AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
g AS (SELECT user_id, event_id, k, t AS last, true AS passed FROM e WHERE k = 1 UNION ALL
 SELECT e.user_id, e.event_id, e.k, CASE WHEN e.f OR e.t - g.last {compare} {seconds} THEN e.t ELSE g.last END, e.f OR e.t - g.last {compare} {seconds} FROM g JOIN e ON e.user_id = g.user_id AND e.k = g.k + 1)
SELECT user_id, event_id, passed FROM g"""


@query(_gate_sql(36_000, ">=", "event_type = 'signup'"))
def cooldown_gate(t: Tables) -> DataFrame:
    """A long cooldown, so that these sparse logs have refusals."""
    return S.cooldown_gate(t("events"), 36_000, forced=F.col("event_type") == "signup")


@query(_gate_sql(60, ">", "event_type = 'error'"))
def health_gate(t: Tables) -> DataFrame:
    return S.cooldown_gate(t("events"), S.HEALTH_SECONDS, forced=F.col("event_type") == "error", strict=True)


@query(f"""WITH {JOBS}, line AS (SELECT user_id, row_number() OVER (ORDER BY created_at, id) - 1 AS p FROM jobs WHERE status = 'queued'), f AS (SELECT user_id, min(p) AS p FROM line GROUP BY user_id),
d AS (SELECT user_id, count(*) AS n FROM jobs WHERE status = 'done' GROUP BY user_id)
SELECT CAST(c_custkey AS VARCHAR) AS user_id, (SELECT count(*) FROM jobs WHERE status IN ('queued', 'processing')) AS queue_depth, CAST(coalesce(p, 0) AS BIGINT) AS position, CAST(coalesce(n, 0) AS BIGINT) AS pending
FROM customer LEFT JOIN f ON f.user_id = CAST(c_custkey AS VARCHAR) LEFT JOIN d ON d.user_id = CAST(c_custkey AS VARCHAR)""")
def poll_view(t: Tables) -> DataFrame:
    return S.poll_view(jobs(t), t("customer").select(F.col("c_custkey").cast("string").alias("user_id")))
