"""Corpus scans and sinks: chunks with a dense index, shards, index tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_COLUMNS = ("title", "text", "source_url", "publisher", "found_on")
CHUNK = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("doc_idx", T.LongType()), *(T.StructField(c, T.StringType()) for c in TEXT_COLUMNS)])
#: Rows of a part of a dense numbering, and its most parts.
PART_ROWS, MOST_PARTS = 250_000, 4096


@dataclass(frozen=True)
class Settings:
    """Where a corpus and its index lie, and how it is searched."""

    chunks: str = ""
    index: str = ""
    shards: str = ""
    top_k: int = 10
    per_shard_k: int = 30
    stopwords: str | None = "en"


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a JSON-lines file; a missing file is an error, a missing column null."""
    return spark.read.schema(CHUNK).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).csv(path, header=True, multiLine=True, escape='"')


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document, as index parameters or shard metadata are kept."""
    return spark.read.json(path, multiLine=True)


def with_text_columns(df: DataFrame, columns: Sequence[str] = TEXT_COLUMNS) -> DataFrame:
    """Missing text columns become empty texts."""
    return df.withColumns({c: F.lit("") for c in columns if c not in df.columns})


def numbered(df: DataFrame, key: Column, name: str, *ties: str | Column) -> DataFrame:
    """``df`` with the place of each row, from 0, by a numeric ``key`` (then ``ties``), nulls first.

    Quantiles cut the key into parts of some PART_ROWS rows, as many as the table needs, that are numbered each
    on its own; a part's offset is the sum of the sizes before it. No task sees all rows. Rows of one key stay in
    one part, so a key should be near unique.
    """
    parts = min(MOST_PARTS, max(1, -(-df.count() // PART_ROWS)))
    cuts = (df.select(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []) if parts > 1 else []
    # the part of a row by binary steps through the borders, not by comparison with each
    borders = sorted(set(cuts))

    def part_of(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key <= F.lit(borders[middle]), part_of(low, middle)).otherwise(part_of(middle + 1, high))

    df = df.withColumn("_part", F.when(key.isNull(), -1).otherwise(part_of(0, len(borders))))
    sizes = df.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    order = Window.partitionBy("_part").orderBy(key.asc_nulls_first(), *ties)
    placed = df.withColumn("_place", F.row_number().over(order) - 1)
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_offset") + F.col("_place")).cast("long")).drop("_part", "_place", "_offset")


def dense_index(df: DataFrame, key: str, name: str = "doc_idx", *ties: str | Column) -> DataFrame:
    """Number rows 0..N-1 by a numeric ``key`` (then ``ties``), nulls first."""
    return numbered(df, F.col(key), name, *ties)


def file_order(df: DataFrame, name: str = "doc_idx") -> DataFrame:
    """Rows of a scan of files numbered as they stand: by path, then place in the file.

    Each split of a file is numbered on its own; what stands before a split is the sum of a small table.
    """
    split = ["_path", "_begin"]
    df = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_begin"), F.monotonically_increasing_id().alias("_row"))
    sizes = df.groupBy(*split).count()
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    offsets = sizes.select(*split, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    placed = df.withColumn("_place", F.row_number().over(Window.partitionBy(*split).orderBy("_row")) - 1).join(offsets, split)
    return placed.withColumn(name, F.col("_offset") + F.col("_place")).drop(*split, "_row", "_place", "_offset")


def normalize(df: DataFrame) -> DataFrame:
    """Chunks with all text columns and a dense doc_idx in order of the one they had."""
    df = with_text_columns(df)
    return dense_index(df.withColumnRenamed("doc_idx", "_old"), "_old", "doc_idx").drop("_old")


def shard_of(doc_idx: Column, size: int) -> Column:
    return F.floor(doc_idx / F.lit(size)).cast("long")


def write_shards(df: DataFrame, path: str) -> None:
    df.write.partitionBy("shard_id").mode("overwrite").parquet(path)


def check_shards(df: DataFrame, size: int) -> DataFrame:
    """``df(shard_id, local_idx, doc_idx)``: the rows whose place is not what the layout says; none in a sound one."""
    return df.where((F.col("shard_id") != shard_of(F.col("doc_idx"), size)) | (F.col("local_idx") != F.col("doc_idx") % size))


def boot(spark: SparkSession, settings: Settings) -> tuple[str, DataFrame]:
    """('shards' or 'single', postings): shards are preferred where their folder can be read."""
    if settings.shards:
        try:
            found = spark.read.parquet(settings.shards)
            if not found.isEmpty():
                return "shards", found
        except Exception as e:  # noqa: BLE001  a missing folder falls back to the single index
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    return "single", spark.read.parquet(settings.index)
