"""Rate limiter and mailbox as keyed state of a stream.

Rows of a key are put in order within a micro-batch; between micro-batches the
log must arrive in order of time, as a log does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.stateful import RATE_SECONDS, epoch

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Limiter(StatefulProcessor):
    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        log = pd.concat(list(rows)).sort_values(["at", "event_id"])
        before = self.last.get()[0] if self.last.exists() else None
        previous = log["at"].shift()
        if before is not None:
            previous.iloc[0] = before
        self.last.update((int(log["at"].iloc[-1]),))
        yield pd.DataFrame({"user_id": key[0], "event_id": log["event_id"], "allowed": (log["at"] - previous >= self.seconds) | previous.isna()})

    def close(self) -> None:
        pass


class _Mailbox(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "place long", "response_id long")
        self.ends = handle.getValueState("ends", "head long, tail long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        """Only what comes and goes is touched, however many responses wait."""
        log = pd.concat(list(rows)).sort_values(["at", "event_id"])
        head, tail = self.ends.get() if self.ends.exists() else (0, 0)
        taken = []
        for event, kind in zip(log["event_id"], log["kind"], strict=True):
            if kind == "arrival":
                self.waiting.updateValue((tail,), (int(event),))
                tail += 1
                continue
            response = None
            if head < tail:
                response = self.waiting.getValue((head,))[0]
                self.waiting.removeKey((head,))
                head += 1
            taken.append((key[0], int(event), response))
        self.ends.update((head, tail))
        yield pd.DataFrame(taken, columns=["user_id", "event_id", "response_id"]).astype({"response_id": "Int64"})

    def close(self) -> None:
        pass


def _prepared(log: DataFrame) -> DataFrame:
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return log


def rate_limit(log: DataFrame, seconds: int = RATE_SECONDS) -> DataFrame:
    """A stream of ``log(user_id, event_id, ts)``: user_id, event_id, allowed."""
    rows = _prepared(log).select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), epoch(F.col("ts")).alias("at"))
    return rows.select("user_id", "event_id", "at").groupBy("user_id").transformWithStateInPandas(_Limiter(seconds), "user_id long, event_id long, allowed boolean", "Append", "None")


def mailbox(log: DataFrame) -> DataFrame:
    """A stream of ``log(user_id, event_id, ts, kind)``, kind 'arrival' or 'poll': polls and the response each takes."""
    rows = _prepared(log).select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "kind")
    return rows.groupBy("user_id").transformWithStateInPandas(_Mailbox(), "user_id long, event_id long, response_id long", "Append", "None")


def polled(source: DataFrame, path: str, checkpoint: str, seconds: int = 15) -> StreamingQuery:
    """Run a stream every ``seconds`` seconds into a folder."""
    return source.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=f"{seconds} seconds").start()


def replay_to(source: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that a stream makes of what is there now, written to a folder and read back."""
    run = source.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    return source.sparkSession.read.parquet(path)
