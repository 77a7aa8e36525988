"""Queries that replay events as a stream of what is there now."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import QUERIES, SQL
from tessera.plans.services import MAILBOX
from tessera.streaming import services


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern, since a stream's plain path has to be a folder
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")


def _replayed(spark: SparkSession, stream: DataFrame) -> DataFrame:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="tessera-stream-")
    at = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    return services.replay_to(stream, f"{at}/out", f"{at}/state")


def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, services.rate_limit(_events(spark, sf_dir)))


def mailbox_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "arrival").when(F.col("event_type") == "view", "poll")
    return _replayed(spark, services.mailbox(_events(spark, sf_dir).withColumn("kind", kind).where("kind IS NOT NULL")))


QUERIES |= {"rate_limit_stream": rate_limit_stream, "mailbox_stream": mailbox_stream}
SQL |= {"rate_limit_stream": SQL["rate_limit"], "mailbox_stream": MAILBOX}
