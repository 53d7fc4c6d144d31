"""Landed files in, ledgers and reports out. Reads and writes are Spark's own formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookreplay.functions.windows import BLOCK

FRAMES = "run string, frame_no long, received_time timestamp, raw string, source string, endpoint string"


def frames(spark: SparkSession, path: str) -> DataFrame:
    """Recorded text frames as JSON lines, with the hash and length of each raw text."""
    return _measured(spark.read.schema(FRAMES).json(path))


def frame_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The same landing folder as a stream, a file at a time and so in run order."""
    return _measured(spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", files_per_trigger).json(path))


def _measured(df: DataFrame) -> DataFrame:
    return df.withColumn("raw_sha256", F.sha2("raw", 256)).withColumn("byte_length", F.octet_length("raw").cast("long"))


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON documents, one per file: book polls, market pages, settlement payloads."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("retrieved_at"), F.col("value").alias("raw"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files with their bytes, for manifest audits."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def append(df: DataFrame, path: str, by: str = "run") -> None:
    df.write.mode("append").partitionBy(by).parquet(path)


def write_clustered(df: DataFrame, table: str, path: str, buckets: int, by: str = "run", order: str = "seq") -> DataFrame:
    """A ledger as a table in ``buckets`` by run and block of numbers, sorted inside, one file a bucket.

    A long run is spread over the buckets and short ones share them (a folder for each run makes many small
    files, and one huge folder). ``block`` is the column by which ``running(placed="block")`` and the
    operators built on it read the table without a shuffle."""
    held = df.withColumn("block", F.floor(F.col(order) / BLOCK))
    held.repartition(buckets, by, "block").write.bucketBy(buckets, by, "block").sortBy(by, "block", order).option("path", path).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def scan_run(spark: SparkSession, path: str, run: str) -> DataFrame:
    """One run of a ledger in order; the filter prunes partitions."""
    return spark.read.parquet(path).where(F.col("run") == run).orderBy("seq")


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    df.write.mode("errorifexists").format(kind).save(path)
