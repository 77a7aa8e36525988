"""Session settings and shared storage that the operators of this package use."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch handed to Python, where the session does not say otherwise.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that stay with the session, since plans run later than they are made.

    Arrow batches are kept small: rows hold whole texts or packed blocks. The parallelism by which scans pack
    files is kept as it is now, so that executors which come or go do not change a scan's partitions.
    """
    if spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) is None:
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(spark.sparkContext.defaultParallelism))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only for a master that runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    kept = getattr(spark, "_tessera_shared", None)
    if kept is None:
        kept = tempfile.mkdtemp(prefix="tessera-")
        spark._tessera_shared = kept
    return kept


def stable(df: DataFrame) -> DataFrame:
    """``df`` as it is if it reads its rows in the same order each time, else written and read back.

    Operators that number rows by partition and block, and read their input twice, need that order.
    """
    steps = {re.sub(r"^[ :+|-]*", "", x).split(" ", 1)[0].split("[", 1)[0] for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if x.strip()}
    return df if steps <= {"Project", "Filter", "Relation", "LogicalRDD", "LocalRelation"} else materialize(df)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_discard_all)
    _written[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


_written: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` from which nothing more will be read."""
    for t in tables:
        path = getattr(t, "_tessera_path", None)
        if path in _written:
            _delete(_written.pop(path), path)


def reclaim(spark: SparkSession) -> None:
    """Have the cluster drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _discard_all() -> None:
    """At the end of the driver its tables go, if the cluster still answers."""
    for path, spark in _written.items():
        try:
            if spark._jsc.sc().isStopped():
                return
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session is gone
            return
