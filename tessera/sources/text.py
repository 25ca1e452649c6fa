"""Text, JSON and table sources and sinks of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ranks import ranked

BREAK = "\n\n\n"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of whole files; ``path`` may be a glob."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, line) of files read in splits: ``part`` is where a split begins, and its lines follow each other in one task.

    Line ends of all kinds; what stands after the last one is a line only if it is not empty. See :mod:`tessera.operators.segments`.
    """
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.col("value").alias("line"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): records parted by two blank lines, read in splits, so one large file is no one task."""
    return spark.read.option("lineSep", BREAK).text(path).select(F.input_file_name().alias("file"), "value")


def read_json_document(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Elements of files that hold one JSON array each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_images(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """(path, content, subject, grade): subject and grade from the file's name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    name = F.split(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1), "_")
    return files.select("path", "content", F.get(name, F.lit(0)).alias("subject"), F.get(name, F.lit(1)).alias("grade"))


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """(file, conv_id, conversations): JSON documents or lines that hold ``{conversations: [{from, value}]}``.

    An id is the file's name and the place (from 1) in it, however the file is read.
    """
    rows = spark.read.option("multiLine", not path.endswith("l")).schema("conversations array<struct<`from`:string,value:string>>").json(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_part"), F.monotonically_increasing_id().alias("_at"), "conversations")
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    return ranked(rows, ["file"], ["_part", "_at"], "_place").select("file", F.concat_ws("#", name, F.col("_place").cast("string")).alias("conv_id"), "conversations")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, raw): lines of result files that are named after their jobs."""
    return spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("job_id"), F.col("value").alias("raw"))


def write_conversations(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Conversations (messages) as JSON lines ``{messages: [...]}``; nulls are left out."""
    df.select(F.to_json(F.struct("messages"), {"ignoreNullFields": "true"}).alias("value")).write.mode(mode).text(path)


def write_pairs(df: DataFrame, path: str, kind: str = "csv", mode: str = "errorifexists") -> None:
    """Pairs (instruction, response) as csv with a heading, as json lines, or as txt records."""
    w = df.select("instruction", "response")
    if kind == "csv":
        w.select(F.col("instruction").alias("Input"), F.col("response").alias("Output")).write.mode(mode).csv(path, header=True, quoteAll=True, escape='"')
    elif kind == "json":
        w.write.mode(mode).json(path)
    elif kind == "txt":
        w.select(F.concat("instruction", F.lit("\n"), "response").alias("value")).write.mode(mode).option("lineSep", BREAK).text(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def write_splits(df: DataFrame, path: str, text: str = "text", split: str = "split", mode: str = "errorifexists") -> None:
    """Records by split, one folder each."""
    df.select(F.col(text).alias("value"), split).write.mode(mode).partitionBy(split).option("lineSep", BREAK).text(path)


def write_batches(df: DataFrame, path: str, batch: str = "batch_id", mode: str = "errorifexists") -> None:
    """Requests as JSON lines, one folder a batch; nulls are left out."""
    rows = df.select(F.to_json(F.struct(*[c for c in df.columns if c != batch])).alias("value"), batch)
    rows.repartition(batch).write.mode(mode).partitionBy(batch).text(path)


def append_text(df: DataFrame, path: str, column: str) -> None:
    """Contents added to a folder of text records."""
    df.select(F.col(column).alias("value")).write.mode("append").option("lineSep", BREAK).text(path)
