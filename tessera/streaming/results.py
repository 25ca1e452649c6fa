"""Result files followed as they arrive: each result once, whatever is delivered twice or cut short."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.requests import response_content


def follow(spark: SparkSession, path: str, late: str = "1 day", files: int | None = None) -> DataFrame:
    """A stream (job_id, custom_id, content, raw, arrived) of the lines of result files, which are named after their jobs.

    A result that comes again within ``late`` (by the file's time) is dropped, by
    job and id; lines without an id are all kept, as nothing tells them apart. ``files``: how many a batch takes.
    """
    reader = spark.readStream.schema("value string")
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    lines = reader.text(path).where(F.trim("value") != "")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1)
    found = lines.select(name.alias("job_id"), F.get_json_object("value", "$.custom_id").alias("custom_id"), response_content(F.col("value")).alias("content"), F.col("value").alias("raw"), F.col("_metadata.file_modification_time").alias("arrived"))
    keyed = found.withColumn("_key", F.coalesce("custom_id", F.concat(F.lit("?"), F.uuid())))
    return keyed.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["job_id", "_key"]).drop("_key")


def write_once(path: str, line: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A writer for ``foreachBatch``: the one-column texts that ``line`` makes of a batch, in a folder named after the batch.

    A batch that runs again, after a crash between its writing and its commit,
    writes over its own folder, so nothing is there twice. Read all of it by :func:`written`.
    """

    def write(batch: DataFrame, number: int) -> None:
        line(batch).toDF("value").write.mode("overwrite").text(f"{path}/batch={number}")

    return write


def written(spark: SparkSession, path: str) -> DataFrame:
    """(value, batch) of what :func:`write_once` has written."""
    return spark.read.text(path)


def contents(batch: DataFrame) -> DataFrame:
    """Contents as text records: two blank lines after each."""
    return batch.where("content IS NOT NULL").select(F.concat("content", F.lit("\n\n")))


def raw_lines(batch: DataFrame) -> DataFrame:
    """Result lines as they came, for one combined JSONL of many files."""
    return batch.select("raw")


def combine(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Result lines (job_id, raw) of many files as one table of JSON lines; of lines of one job and id one stays, the first in order."""
    key = F.struct(F.col("job_id"), F.coalesce(F.get_json_object("raw", "$.custom_id"), F.col("raw")))
    results.where(F.trim("raw") != "").groupBy(key.alias("key")).agg(F.min("raw").alias("value")).select("value").write.mode(mode).text(path)
