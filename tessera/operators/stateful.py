"""Keyed state over ordered logs, in batch form: limits, queues, mailboxes, gates.

Each works a key at a time and orders by (ts, event_id); windows and folds are
over one key's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import duration
from tessera.sources.corpus import PART_ROWS, numbered

# Seconds between attempts, between boots, between health checks, and of a query in line.
RATE_SECONDS, BOOT_SECONDS, HEALTH_SECONDS, QUERY_SECONDS = 30, 10, 60, 45
# Feedback entries and status lines that a client keeps.
FEEDBACK_KEPT, STATUS_KEPT = 200, 1
# End of fixed values.


def epoch(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000)).cast("long")


def _ordered(key: str) -> Window:
    return Window.partitionBy(key).orderBy("ts", "event_id")


def rate_limit(log: DataFrame, key: str = "user_id", seconds: int = RATE_SECONDS) -> DataFrame:
    """``log`` with ``allowed``: enough whole seconds since the key's last attempt, allowed or not."""
    last = F.lag(epoch(F.col("ts"))).over(_ordered(key))
    return log.withColumn("allowed", F.coalesce(epoch(F.col("ts")) - last >= seconds, F.lit(True)))


def queue_position(jobs: DataFrame) -> DataFrame:
    """Each user's place in the line of queued jobs, from 0; 0 also for none.

    The line is the whole table's: its places are counted by parts, so that no task orders all of it.
    """
    line = jobs.where(F.col("status") == "queued")
    placed = numbered(line, F.unix_micros(F.col("created_at").cast("timestamp")), "place", "id")
    first = placed.groupBy("user_id").agg(F.min("place").alias("place"))
    return jobs.select("user_id").distinct().join(first, "user_id", "left").select("user_id", F.coalesce("place", F.lit(0)).cast("long").alias("position"))


def queue_depth(jobs: DataFrame, inflight: Column | None = None) -> DataFrame:
    """One row: queued jobs, jobs in work, and the depth that is reported."""
    work = F.count_if(F.col("status") == "processing") if inflight is None else inflight
    return jobs.agg(F.count_if(F.col("status") == "queued").alias("queued"), work.alias("inflight")).withColumn("depth", F.col("queued") + F.col("inflight"))


def inflight_depth(log: DataFrame, delta: Column, key: str | None = None) -> DataFrame:
    """``log`` with the running sum of ``delta``: of each key, or of everything, by stretches so that no task orders all of it."""
    if key is not None:
        return log.withColumn("depth", F.sum(delta).over(_ordered(key).rowsBetween(Window.unboundedPreceding, 0)))
    # rows get their place in the whole log, and stretches of it are summed each on its own
    log = numbered(log.withColumn("_delta", delta), F.unix_micros(F.col("ts").cast("timestamp")), "_at", "event_id")
    log = log.withColumn("_stretch", F.floor(F.col("_at") / F.lit(PART_ROWS)))
    sums = log.groupBy("_stretch").agg(F.sum("_delta").alias("d"))
    before = sums.select("_stretch", F.coalesce(F.sum("d").over(Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum("_delta").over(Window.partitionBy("_stretch").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return log.withColumn("_within", within).join(before, "_stretch").withColumn("depth", F.col("_within") + F.col("_before")).drop("_at", "_stretch", "_delta", "_within", "_before")


def mailbox(log: DataFrame, arrival: Column, poll: Column, key: str = "user_id") -> DataFrame:
    """Polls and the arrival each takes, every arrival going to one poll, oldest first.

    Before poll i of a key A(i) responses had arrived; i + min(0, min over j <= i of A(j) - j) are
    delivered by then, and poll i gets one iff that number rises.
    """
    log = log.withColumns({"_in": arrival, "_out": poll})
    seen = log.withColumn("_a", F.sum(F.col("_in").cast("long")).over(_ordered(key).rowsBetween(Window.unboundedPreceding, 0)))
    polls = seen.where("_out").withColumn("_i", F.row_number().over(_ordered(key)))
    run = F.min(F.col("_a") - F.col("_i")).over(_ordered(key).rowsBetween(Window.unboundedPreceding, 0))
    polls = polls.withColumn("_d", F.col("_i") + F.least(F.lit(0), run))
    rises = F.col("_d") > F.coalesce(F.lag("_d").over(_ordered(key)), F.lit(0))
    polls = polls.withColumn("_take", F.when(rises, F.col("_d")))
    arrivals = seen.where("_in").select(key, F.col("_a").alias("_take"), F.col("event_id").alias("response_id"))
    return polls.join(arrivals, [key, "_take"], "left").select(key, "event_id", "ts", "response_id")


def changed_only(log: DataFrame, key: str, message: str) -> DataFrame:
    """Without rows whose message repeats the key's previous one."""
    last = F.lag(message).over(_ordered(key))
    first = F.row_number().over(_ordered(key)) == 1
    return log.withColumn("_new", first | ~F.col(message).eqNullSafe(last)).where("_new").drop("_new")


def cooldown_gate(log: DataFrame, seconds: int, key: str = "user_id", forced: Column | None = None, strict: bool = False) -> DataFrame:
    """``log`` with ``passed``: enough time since the key's last *passed* row (more than enough if ``strict``), or forced.

    A refused row leaves the state as it was, so this is a fold over rows in order. A forced row, and one that comes
    long enough after the row before it, passes whatever the state: they cut a key's rows into stretches that are
    folded each on its own, so what is held at once is one stretch of close rows.
    """
    rows = log.withColumn("_t", epoch(F.col("ts"))).withColumn("_f", F.coalesce(forced if forced is not None else F.lit(False), F.lit(False)))
    pause = F.col("_t") - F.lag("_t").over(_ordered(key))
    cut = pause.isNull() | F.col("_f") | ((pause > seconds) if strict else (pause >= seconds))
    rows = rows.withColumn("_cut", cut.cast("int"))
    rows = rows.withColumn("_part", F.sum("_cut").over(_ordered(key).rowsBetween(Window.unboundedPreceding, 0)))
    listed = rows.groupBy(key, "_part").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "_t", "_f"))).alias("rows"))
    state = "struct<last:bigint,out:array<struct<event_id:bigint,passed:boolean>>>"
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<struct<event_id:bigint,passed:boolean>>").alias("out")).cast(state)

    def step(acc, x):  # noqa: ANN001, ANN202
        gap = x["_t"] - acc["last"]
        ok = acc["last"].isNull() | x["_f"] | ((gap > seconds) if strict else (gap >= seconds))
        one = F.array(F.struct(x["event_id"].alias("event_id"), ok.alias("passed")))
        return F.struct(F.when(ok, x["_t"]).otherwise(acc["last"]).alias("last"), F.concat(acc["out"], one).alias("out")).cast(state)

    folded = listed.select(key, F.explode(F.aggregate("rows", start, step, lambda a: a["out"])).alias("o"))
    return folded.select(key, F.col("o.event_id").alias("event_id"), F.col("o.passed").alias("passed"))


def queue_eta(line: Column) -> Column:
    return duration(F.greatest(F.lit(0), F.coalesce(line, F.lit(0))) * QUERY_SECONDS)


def poll_view(jobs: DataFrame, users: DataFrame) -> DataFrame:
    """What a poll shows each of ``users(user_id)``: depth of the line, own position, own pending answers."""
    depth = queue_depth(jobs)
    done = jobs.where(F.col("status") == "done").groupBy("user_id").agg(F.count(F.lit(1)).alias("pending"))
    seen = users.join(queue_position(jobs), "user_id", "left").join(done, "user_id", "left").join(F.broadcast(depth.select("depth")), F.lit(True), "left")
    return seen.select("user_id", F.col("depth").alias("queue_depth"), F.coalesce("position", F.lit(0)).cast("long").alias("position"), F.coalesce("pending", F.lit(0)).alias("pending"))


def has_queued(jobs: DataFrame) -> DataFrame:
    """One row: whether any job is queued."""
    return jobs.agg(F.coalesce(F.bool_or(F.col("status") == "queued"), F.lit(False)).alias("has_queued"))


def poll_with_response(jobs: DataFrame, log: DataFrame, arrival: Column, poll: Column) -> DataFrame:
    """Each poll of ``log``: the depth of the line, the user's place in it, and the response that the poll takes."""
    taken = mailbox(log, arrival, poll).withColumn("user_id", F.col("user_id").cast("string"))
    seen = taken.join(queue_position(jobs), "user_id", "left").join(F.broadcast(queue_depth(jobs).select("depth")), F.lit(True), "left")
    return seen.select("user_id", "event_id", F.col("depth").alias("queue_depth"), F.coalesce("position", F.lit(0)).cast("long").alias("position"), "response_id")


def unlock_sessions(attempts: DataFrame, unlocked: Column, new_id: Column) -> DataFrame:
    """A session row ``session_id, user_id, opened_at`` for each attempt that unlocks; every attempt mints its own id."""
    return attempts.where(unlocked).select(new_id.alias("session_id"), "user_id", F.col("ts").alias("opened_at"))


def capped(log: DataFrame, cap: int, key: str = "user_id") -> DataFrame:
    """Each key's newest ``cap`` rows with their rank: histories that are prepended to and cut."""
    order = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return log.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= cap)
