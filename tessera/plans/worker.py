"""Queries of the worker, its responses, and small functions of the service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import jobs as J
from tessera.operators import service
from tessera.operators import stateful as S
from tessera.operators import worker as W
from tessera.plans.registry import Tables, query
from tessera.plans.services import JOBS, MAILBOX, jobs

#: Jobs that a run of the worker takes here.
TURNS = 25


@query(f"WITH {JOBS} SELECT id, user_id, prompt FROM jobs WHERE status = 'queued' ORDER BY created_at, id LIMIT 1")
def queue_peek(t: Tables) -> DataFrame:
    return W.peek(jobs(t)).select("id", "user_id", "prompt")


@query(f"WITH {JOBS}, head AS (SELECT id FROM jobs WHERE status = 'queued' ORDER BY created_at, id LIMIT 1) SELECT id, status FROM jobs WHERE id NOT IN (SELECT id FROM head)")
def queue_pop(t: Tables) -> DataFrame:
    return W.pop(jobs(t)).select("id", "status")


@query(f"WITH {JOBS} SELECT id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS BIGINT) AS place FROM jobs WHERE status = 'queued'")
def queue_places(t: Tables) -> DataFrame:
    return W.places(jobs(t))


_HEAD = f"head AS (SELECT id FROM jobs WHERE status = 'queued' ORDER BY created_at, id LIMIT {TURNS})"


@query(f"""WITH {JOBS}, {_HEAD} SELECT id, CASE WHEN id IN (SELECT id FROM head) THEN 'done' ELSE status END AS status,
CASE WHEN id IN (SELECT id FROM head) THEN 'answered: ' || prompt ELSE response END AS response FROM jobs""")
def worker_jobs(t: Tables) -> DataFrame:
    """The model is a function; here one that repeats its prompt."""
    return W.run(jobs(t), lambda p: f"answered: {p}", F.lit("2024-02-01").cast("timestamp_ntz"), TURNS)[0].select("id", "status", "response")


@query(f"WITH {JOBS}, {_HEAD} SELECT id, user_id, 'answered: ' || prompt AS answer FROM jobs WHERE id IN (SELECT id FROM head)")
def worker_responses(t: Tables) -> DataFrame:
    return W.run(jobs(t), lambda p: f"answered: {p}", F.lit("2024-02-01").cast("timestamp_ntz"), TURNS)[1]


@query(f"WITH {JOBS} SELECT id, status FROM jobs")
def worker_waits(t: Tables) -> DataFrame:
    """A model that is not ready leaves all jobs as they were."""
    return W.run(jobs(t), lambda p: p, F.lit("2024-02-01").cast("timestamp_ntz"), TURNS, model_ready=False)[0].select("id", "status")


@query("SELECT event_id, event_id % 3 <> 0 AND event_id % 4 IN (0, 1) AS ready FROM events")
def model_ready(t: Tables) -> DataFrame:
    i = F.col("event_id") % 4
    body = F.when(i == 0, '{"health":"ok"}').when(i == 1, ' {"x":1,"health":"ok"}').when(i == 2, '{"health":"booting"}').otherwise("ok")
    return t("events").select("event_id", W.ready(F.when(F.col("event_id") % 3 == 0, 503).otherwise(200), body).alias("ready"))


@query(f"WITH {JOBS} SELECT id, '{{\"id\":\"' || id || '\",\"status\":\"' || status || '\"}}' AS body FROM jobs")
def response_json(t: Tables) -> DataFrame:
    return jobs(t).select("id", W.response_json(id=F.col("id"), status=F.col("status")).alias("body"))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN NULL ELSE text END AS answer FROM conversations")
def late_response(t: Tables) -> DataFrame:
    """Objects, strings that hold one, and what is neither."""
    i, body = F.col("turn") % 4, F.to_json(F.struct(F.col("text").alias("answer")))
    quoted = F.regexp_replace(F.to_json(F.struct(body.alias("x"))), r'^\{"x":|\}\z', "")
    raw = F.when(i == 1, quoted).when(i == 3, F.concat(F.lit("{oops "), F.substring("text", 1, 3))).otherwise(body)
    return t("conversations").select("conv_id", "turn", W.parse_response(raw, "answer").alias("answer"))


@query(f"""WITH {JOBS}, polls AS ({MAILBOX}), line AS (SELECT user_id, row_number() OVER (ORDER BY created_at, id) - 1 AS p FROM jobs WHERE status = 'queued'), f AS (SELECT user_id, min(p) AS p FROM line GROUP BY user_id)
SELECT CAST(polls.user_id AS VARCHAR) AS user_id, event_id, (SELECT count(*) FROM jobs WHERE status IN ('queued', 'processing')) AS queue_depth, CAST(coalesce(p, 0) AS BIGINT) AS position, response_id
FROM polls LEFT JOIN f ON f.user_id = CAST(polls.user_id AS VARCHAR)""")
def poll_with_response(t: Tables) -> DataFrame:
    return S.poll_with_response(jobs(t), t("events"), F.col("event_type") == "purchase", F.col("event_type") == "view")


@query(f"WITH {JOBS} SELECT count(*) > 0 AS has_queued FROM jobs WHERE status = 'queued'")
def has_queued(t: Tables) -> DataFrame:
    return S.has_queued(jobs(t))


@query("SELECT md5(event_id || ':' || user_id) AS session_id, user_id, CAST(epoch_us(ts) AS BIGINT) AS opened_at FROM events WHERE event_type IN ('click', 'view')")
def unlock_sessions(t: Tables) -> DataFrame:
    """Ids from the attempt, so that they can be compared; the default mints new ones."""
    own = F.md5(F.concat_ws(":", "event_id", "user_id").cast("binary"))
    opened = S.unlock_sessions(t("events"), F.col("event_type").isin("click", "view"), own)
    return opened.select("session_id", "user_id", F.unix_micros(F.col("opened_at").cast("timestamp")).alias("opened_at"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END AS at FROM events")
def iso_time(t: Tables) -> DataFrame:
    return t("events").select("event_id", W.iso_time(F.col("ts")).alias("at"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0e0 ELSE (value - 5) / (100 - 5) * 100 END AS percent FROM events")
def range_percentage(t: Tables) -> DataFrame:
    most = F.when(F.col("event_id") % 7 == 0, F.lit(5.0)).otherwise(F.lit(100.0))
    return t("events").select("event_id", W.percentage(F.col("value"), F.lit(5.0), most).alias("percent"))


@query("SELECT doc_id, substring(text, 1, 20) AS p20, substring(text, 1, 40) AS p40, substring(text, 1, 80) AS p80, substring(text, 1, 2000) AS p2000 FROM documents")
def log_previews(t: Tables) -> DataFrame:
    p = W.previews(F.col("text"))
    return t("documents").select("doc_id", *(p[k].alias(f"p{n}") for k, n in enumerate(W.PREVIEWS)))


@query("SELECT event_id, CASE WHEN event_type IN ('search', 'ab', 'ask') THEN event_type WHEN event_type = 'view' THEN 'search' WHEN event_type = 'click' THEN 'ab' ELSE 'chat' END AS call FROM events")
def mode_dispatch(t: Tables) -> DataFrame:
    mode = F.when(F.col("event_type") == "view", "search").when(F.col("event_type") == "click", "ab").otherwise(F.col("event_type"))
    return t("events").select("event_id", service.call_of(mode).alias("call"))


@query("""WITH f AS (SELECT doc_id AS id, CAST(doc_id % 50 AS VARCHAR) AS job_id, TIMESTAMP '2024-01-01' + to_hours(doc_id * 7919 % 97) AS created_at FROM labels)
SELECT id, job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id DESC) AS BIGINT) AS rk FROM f""")
def feedback_newest_first(t: Tables) -> DataFrame:
    at = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) + (F.col("doc_id") * 7919 % 97) * F.lit(3_600_000_000))
    rows = t("labels").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50).cast("string").alias("job_id"), at.alias("created_at"))
    return J.newest_feedback(rows).select("id", "job_id", F.col("rk").cast("long").alias("rk"))


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS BIGINT) AS rk FROM events QUALIFY rk <= 1")
def status_line(t: Tables) -> DataFrame:
    return S.capped(t("events"), S.STATUS_KEPT).select("user_id", "event_id", F.col("rk").cast("long").alias("rk"))


@query("SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS BIGINT) AS rk FROM events QUALIFY rk <= 200")
def local_feedback(t: Tables) -> DataFrame:
    return S.capped(t("events"), S.FEEDBACK_KEPT, "event_type").select("event_type", "event_id", F.col("rk").cast("long").alias("rk"))
