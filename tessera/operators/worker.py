"""The worker that answers queued jobs, and what passes between it and those who wait."""

from __future__ import annotations

import logging
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import answer, jobs

# Characters of a text that the log's lines show.
PREVIEWS = (20, 40, 80, 2000)
# End of fixed values.


def peek(table: DataFrame) -> DataFrame:
    """The job at the head of the line, or no row."""
    return jobs.queued(table, 1)


def pop(table: DataFrame) -> DataFrame:
    """``table`` without the job at the head of the line."""
    return table.join(peek(table).select("id"), "id", "left_anti")


def ready(status: Column, body: Column) -> Column:
    """Whether a model that answered so is ready: status 200, and a JSON body whose health is ok."""
    health = F.get_json_object(body, "$.health")
    return F.coalesce((status == 200) & (health == "ok"), F.lit(False))


def run(table: DataFrame, model: Callable[[str], str], at: Column, limit: int, model_ready: bool = True) -> tuple[DataFrame, DataFrame]:
    """The worker's turns over the first ``limit`` jobs in line: the jobs after it, and the responses ``id, user_id, answer``.

    Each is answered, marked done and taken from the line, in order; a model that is not ready leaves all as it was.
    """
    head = jobs.queued(table, limit) if model_ready else table.where(F.lit(False))
    done = answer.generate(head.select("id", "user_id", "prompt"), model).withColumn("at", at)
    return jobs.complete(table, done.select("id", "answer", "at")).drop("changed"), done.select("id", "user_id", "answer")


def response_json(**fields: Column) -> Column:
    """A response as one JSON object."""
    return F.to_json(F.struct(*(c.alias(name) for name, c in fields.items())))


def parse_response(raw: Column, field: str) -> Column:
    """A field of a queued response: an object, or a string that holds one; null where it is neither."""
    text = F.when(F.ltrim(raw).startswith('"'), F.from_json(F.concat(F.lit('{"x":'), raw, F.lit("}")), "x string")["x"]).otherwise(raw)
    return F.get_json_object(text, f"$.{field}")


def iso_time(ts: Column) -> Column:
    """A UTC time as text, microseconds only where there are some."""
    ts = ts.cast("timestamp_ntz")
    seconds = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", seconds).otherwise(F.concat(seconds, F.lit("."), micros))


def new_id(prefix: str = "") -> Column:
    """A new id for each row; another one each time."""
    return F.concat(F.lit(prefix), F.uuid())


def percentage(value: Column, least: Column, most: Column) -> Column:
    """How far a value lies between two others, of a hundred; 0 where they do not differ."""
    return F.when(most > least, (value - least) / (most - least) * 100).otherwise(F.lit(0.0))


def previews(text: Column) -> Column:
    """The stretches of a text that log lines show, shortest first."""
    return F.array(*(F.substring(F.coalesce(text, F.lit("")), 1, n) for n in PREVIEWS))


def log_to(path: str, level: int = logging.INFO) -> logging.Logger:
    """The library's log, to a file and to the standard output; other libraries tell warnings only."""
    out = logging.getLogger("tessera")
    for old in list(out.handlers):
        out.removeHandler(old)
        old.close()
    for handler in (logging.FileHandler(path, encoding="utf-8"), logging.StreamHandler(sys.stdout)):
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        out.addHandler(handler)
    out.setLevel(level)
    out.propagate = False
    for name in ("py4j", "pyspark"):
        logging.getLogger(name).setLevel(logging.WARNING)
    return out


def places(table: DataFrame) -> DataFrame:
    """``id, place`` of queued jobs in the order in which the worker takes them, by user."""
    order = Window.partitionBy("user_id").orderBy("created_at", "id")
    return table.where(F.col("status") == "queued").select("id", "user_id", F.row_number().over(order).cast("long").alias("place"))
