"""Request parameters: coercion and validation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import strip

# Defaults, bounds and messages of the service's interface.
DEFAULT_TOP_K, DEFAULT_SHARD_K, MOST_K = 10, 20, 200
TRUE_WORDS = ("true", "1", "yes", "on")
FALSE_WORDS = ("false", "0", "no", "off")
MODES = ("search", "chat", "ab")
MOST_TURNS = 5
# End of fixed values.


def get(payload: Column, key: str) -> Column:
    """A field of a JSON object as text; null where the payload is malformed or lacks it."""
    return F.get_json_object(payload, f"$.{key}")


def is_text(payload: Column, key: str) -> Column:
    """Whether the field is a JSON string."""
    return payload.rlike(rf'"{key}"\s*:\s*"')


def whole(x: Column) -> Column:
    """A whole number from its decimal text, else null."""
    s = strip(x)
    return F.when(s.rlike(r"^[+-]?[0-9]{1,18}$"), F.regexp_replace(s, r"^\+", "").cast("long"))


def payload_str(payload: Column, key: str, default: Column) -> Column:
    return F.when(is_text(payload, key), strip(get(payload, key))).otherwise(default)


def payload_int(payload: Column, key: str, default: Column) -> Column:
    """A JSON whole number or its text; true and false count as 1 and 0."""
    v = get(payload, key)
    flag = F.when(v == "true", 1).when(v == "false", 0)
    return F.coalesce(F.when(is_text(payload, key), whole(v)).otherwise(F.coalesce(flag, whole(v))).cast("long"), default)


def payload_float(payload: Column, key: str, default: Column) -> Column:
    v = get(payload, key)
    s = strip(v)
    number = F.when(s.rlike(r"(?i)^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"), s.cast("double"))
    flag = F.when(v == "true", 1.0).when(v == "false", 0.0)
    return F.coalesce(F.when(is_text(payload, key), number).otherwise(F.coalesce(flag, number)), default)


def payload_bool(payload: Column, key: str, default: Column) -> Column:
    v = F.lower(strip(get(payload, key)))
    text = is_text(payload, key)
    return F.when(text & v.isin(*TRUE_WORDS), True).when(text & v.isin(*FALSE_WORDS), False).when(~text & (v == "true"), True).when(~text & (v == "false"), False).otherwise(default)


def lenient_bool(x: Column) -> Column:
    return F.coalesce(F.lower(strip(x)) == "true", F.lit(False))


def strict_bool(x: Column) -> Column:
    """True, false, or an error."""
    s = F.lower(strip(x))
    return F.when(s == "true", True).when(s == "false", False).otherwise(F.raise_error(F.lit("neither 'true' nor 'false'")).cast("boolean"))


def leading_int(x: Column) -> Column:
    """The whole number that a text begins with, else null."""
    s = F.regexp_extract(x, r"^\s*([+-]?[0-9]{1,18})", 1)
    return F.when(s != "", F.regexp_replace(s, r"^\+", "").cast("long"))


def clamp(x: Column, low: int, high: int, fallback: Column) -> Column:
    n = leading_int(x)
    return F.when(n.isNull(), fallback).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), n)).cast("long"))


def rating(x: Column) -> Column:
    return clamp(x, 1, 10, F.lit(None).cast("long"))


def search_request(payload: Column) -> dict[str, Column]:
    """query, top_k, shard_k and error of a search request."""
    query = strip(F.coalesce(get(payload, "query"), F.lit("")))
    asked = F.when(get(payload, "top_k").isNull(), get(payload, "max_n")).otherwise(get(payload, "top_k"))
    top_k, shard_k = F.when(asked.isNull(), DEFAULT_TOP_K).otherwise(whole(asked)), F.when(get(payload, "shard_k").isNull(), DEFAULT_SHARD_K).otherwise(whole(get(payload, "shard_k")))
    error = (
        F.when(top_k.isNull(), "Field 'top_k'/'max_n' must be an integer")
        .when(shard_k.isNull(), "Field 'shard_k' must be an integer")
        .when(query == "", "Field 'query' must be a non-empty string")
        .when((top_k <= 0) | (top_k > MOST_K), "Field 'top_k' must be between 1 and 200")
        .when((shard_k <= 0) | (shard_k > MOST_K), "Field 'shard_k' must be between 1 and 200")
    )
    return {"query": query, "top_k": top_k.cast("long"), "shard_k": shard_k.cast("long"), "error": error}


def chat_request(payload: Column) -> dict[str, Column]:
    """message (or its alias query), user_id and error of a chat request."""
    message = strip(F.coalesce(F.nullif(get(payload, "message"), F.lit("")), get(payload, "query"), F.lit("")))
    given = get(payload, "user_id")
    user = F.when(given.isNull(), "none").when(is_text(payload, "user_id"), strip(given))
    error = (
        F.when(message == "", "Field 'message' must be a non-empty string")
        .when(user.isNull(), "Field 'user_id' must be a string")
        .when(user == "none", "Field 'user_id' cannot be none or empty")
    )
    return {"message": message, "user_id": user, "force_queue": lenient_bool(get(payload, "force_queue")), "error": error}


def feedback_request(payload: Column) -> dict[str, Column]:
    """Fields and error of a feedback request; a rating of zero is refused."""
    none = F.lit(None).cast("long")
    job = payload_str(payload, "job_id", F.lit(None).cast("string"))
    ratings = {k: payload_int(payload, k, none) for k in ("relevance", "accuracy", "style")}
    error = F.when(job.isNull() | (job == ""), "Field 'job_id' must be a non-empty string")
    for k, v in ratings.items():
        error = error.when(v.isNull() | (v == 0), f"Field '{k}' must be integer")
    return {"job_id": job, **ratings, "comments": payload_str(payload, "comments", F.lit("")), "error": error}


def tool_state(raw: Column) -> dict[str, Column]:
    """Turns of history (only a JSON number counts) and mode of a stored tool state."""
    turns = get(raw, "historyTurns")
    number = ~is_text(raw, "historyTurns") & turns.rlike(r"^-?[0-9]")
    return {
        "history_turns": F.when(number, clamp(turns, 0, MOST_TURNS, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")),
        "mode": F.when(get(raw, "mode").isin(*MODES), get(raw, "mode")).otherwise(MODES[0]),
    }


def allowed_mode(mode: Column, unlocked: Column) -> Column:
    return F.when(unlocked, mode).otherwise(MODES[0])


def passwords(value: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), strip), lambda p: p != "")


# The service's hours in its time zone, and the endpoints that they do not bind.
ZONE, OPENS, CLOSES = "America/New_York", 9, 22
ALWAYS_OPEN = ("/api/unlock", "/api/access", "/api/ping", "/api/status", "/api/queue")
# End of fixed values.


def in_hours(utc: Column) -> Column:
    hour = F.hour(F.from_utc_timestamp(utc.cast("timestamp"), ZONE))
    return (hour >= OPENS) & (hour < CLOSES)


def gate(endpoint: Column, utc: Column) -> Column:
    return endpoint.isin(*ALWAYS_OPEN) | in_hours(utc)
