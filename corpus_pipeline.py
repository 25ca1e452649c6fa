"""The corpus pipeline: documents in, packed training sequences out.

Stages, in order: the quality classifier drops what it rejects, the toxicity
grader drops what it rejects, circulant MinHash keeps one document of each
group of near duplicates, and harmonic packing cuts the rest into sequences.
Every stage but the last returns the columns of documents.

Defined cases: a null or empty text has the score of the classifier's bias and
no toxic word, and is no near copy of any; rows without an id are kept as they
are; of rows with one id one stays; an empty table gives an empty one; without
labels the classifiers reject nothing that their bias does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import near_dedup, packing, quality, toxicity
from tessera.llm.common import drop_written, scratch, table, written, without_copies

#: Documents with a quality score below this are rejected.
LEAST_QUALITY = 0.5

#: Packing can't be said in SQL; the stages are tested against brute force and held-out labels.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1, learned from the labelled rows of the whole ``documents`` table."""
    labels = table(spark, sf_dir, "labels").where(~quality.held_out("doc_id"))
    model = quality.fit(table(spark, sf_dir, "documents"), labels, "doc_id", "text", "quality")
    return quality.keep(docs, model, "text", LEAST_QUALITY)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3, learned from the labelled rows of the whole ``documents`` table."""
    labels = table(spark, sf_dir, "labels").where(~quality.held_out("doc_id"))
    model = toxicity.fit(table(spark, sf_dir, "documents"), labels, "doc_id", "text", "toxic")
    return toxicity.keep(docs, model, "text")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4 at five words and a similarity of 0.8: one row stays of the smallest id of each group."""
    marked = near_dedup.near_duplicates(docs, "doc_id", "text", width=5, percent=80)
    return without_copies(docs, marked.select("doc_id", "kept"), "doc_id")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9."""
    pieces = packing.pack(docs, "doc_id", "text")
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    Each stage's rows are written to the shared folder and read again; they are
    deleted when the next stage is done, and those of the last one stay.
    """
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as result:
        for name, stage in STAGES:
            before, rows = docs, stage(spark, docs, sf_dir)
            if name == STAGES[-1][0]:
                return result(rows, f"pipeline-{name}")
            docs = written(spark, rows, name)
            if name != STAGES[0][0]:
                drop_written(spark, before)
