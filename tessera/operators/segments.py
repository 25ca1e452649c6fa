"""Cutting line-oriented text into records, segments, chunks and sections.

A file is read in parts (byte ranges of a large file, or rows of a table), and
each part is cut in the task that reads it. What a part can't know, how many
lines and records stand before it, comes from a table of one row a part, summed
up over parts by ranges (:mod:`tessera.operators.ranks`). Only a record's pieces
meet in a task, so a file of any size is cut by as many tasks as it has parts.

Lines are (file, ``part``, ``line``) rows: those of a part stand together, in
order, in one partition, as :func:`lines` and
:func:`tessera.sources.text.read_lines` give them, and keep so under
projections and filters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.headers import NARROW, RECORD, not_blank, parse, split_record, strip
from tessera.functions.instruct import instruction
from tessera.operators.ranks import changes, running

PART = "part"


def lines(df: DataFrame, text: str, file: str, part: str | None = None) -> DataFrame:
    """(file, part, line): line ends of all kinds; a row is a part of a file, in the order of ``part``, or all of it."""
    normal = F.replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return df.select(file, (F.col(part) if part else F.lit(0)).cast("long").alias(PART), F.explode(F.split(normal, "\n")).alias("line"))


def _counts(rows: DataFrame, file: str) -> DataFrame:
    """(file, part, lines, starts, begun) for each part: how many there are, and whether the first row is a start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for b in batches:
            if not b.num_rows:
                continue
            first = changes([b.column(0), b.column(1)])
            here = (b.column(0)[0].as_py(), b.column(1)[0].as_py())
            first[0] = key is None or here != key
            start, fresh = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            at = np.flatnonzero(first)
            if held is not None:
                end = at[0] if len(at) else b.num_rows
                held[1] += int(fresh[:end].sum())
                held[2] += int(start[:end].sum())
            if len(at):
                if held is not None:
                    yield row(held)
                sums = [np.add.reduceat(x, at) for x in (fresh, start)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[:-1])), b.column(1).take(pa.array(at[:-1])), *(pa.array(x[:-1]) for x in sums), pa.array(start[at[:-1]])], names=names)
                held = [b.slice(int(at[-1]), 1), *(int(x[-1]) for x in sums), int(start[at[-1]])]
            key = (b.column(0)[-1].as_py(), b.column(1)[-1].as_py())
        if held is not None:
            yield row(held)

    def row(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([held[0].column(0), held[0].column(1), *(pa.array([x], pa.int64()) for x in held[1:])], names=names)

    names = [file, PART, "lines", "starts", "begun"]
    return rows.select(file, PART, "start", "fresh").mapInArrow(run, f"`{file}` {rows.schema[file].dataType.simpleString()}, {PART} long, lines long, starts long, begun long")


def _pieces(rows: DataFrame, file: str) -> DataFrame:
    """(file, part, place, first, n_lines, text): what stands in a part from one start to the next; ``place`` counts starts, ``first`` is the line from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_, place, line = None, None, 0, -1
        for b in batches:
            if not b.num_rows:
                continue
            new = changes([b.column(0), b.column(1)])
            new[0] = key is None or (b.column(0)[0].as_py(), b.column(1)[0].as_py()) != key
            key = (b.column(0)[-1].as_py(), b.column(1)[-1].as_py())
            start, fresh = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
            begins = np.flatnonzero(new | start)
            bounds = np.unique(np.concatenate([[0], begins, [b.num_rows]])).astype(np.int32)
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), b.column(2)), "").to_pylist()
            done = []
            for text, lo, hi in zip(texts, bounds[:-1], bounds[1:], strict=True):
                if new[lo] or start[lo]:
                    if open_ is not None:
                        done.append(open_)
                    place, line = (int(start[lo]), -1) if new[lo] else (place + 1, line)
                    # a piece that begins within a line belongs to it, too
                    open_ = [b.slice(int(lo), 1), place, line + int(fresh[lo]), 0, [text[1:] if fresh[lo] else text]]
                else:
                    open_[4].append(text)
                line += int(fresh[lo:hi].sum())
                open_[3] = line - open_[2] + 1
            if done:
                yield rows_of(done)
        if open_ is not None:
            yield rows_of([open_])

    def rows_of(done: list[list]) -> pa.RecordBatch:
        at = pa.Table.from_batches([d[0] for d in done]).combine_chunks()
        more = [pa.array([d[k] for d in done], pa.int64()) for k in (1, 2, 3)]
        return pa.RecordBatch.from_arrays([at.column(0).combine_chunks(), at.column(1).combine_chunks(), *more, pa.array(["".join(d[4]) for d in done], pa.string())], names=[file, PART, "place", "first", "n_lines", "text"])

    marked = rows.select(file, PART, F.when(F.col("fresh"), F.concat(F.lit("\n"), F.col("text"))).otherwise(F.col("text")).alias("text"), "start", "fresh")
    return marked.mapInArrow(run, f"`{file}` {rows.schema[file].dataType.simpleString()}, {PART} long, place long, first long, n_lines long, text string")


def _cut(rows: DataFrame, file: str, first_starts: bool = True) -> DataFrame:
    """(file, number, text, n_lines, first_line from 1): rows (file, part, text, start, fresh) cut before each start.

    What stands before the first start has number 0. Without ``first_starts`` a
    file's first row begins nothing. ``fresh`` rows begin a line; others go on with the one before.
    """
    counts = running(_counts(rows, file), [file], [PART], {"lines_to": "lines", "starts_to": "starts"})
    shift = F.lit(0)
    if not first_starts:
        begun = counts.groupBy(F.col(file).alias("_file")).agg(F.min_by("begun", PART).alias("_begun"))
        counts = counts.join(begun, F.col(file).eqNullSafe(F.col("_file")))
        shift = F.col("_begun")
    before = counts.select(F.col(file).alias("_file"), F.col(PART).alias("_part"), (F.col("starts_to") - F.col("starts") - shift).alias("_starts"), (F.col("lines_to") - F.col("lines")).alias("_lines"))
    placed = _pieces(rows, file).join(before, F.col(file).eqNullSafe(F.col("_file")) & (F.col(PART) == F.col("_part")))
    placed = placed.select(file, PART, (F.col("place") + F.col("_starts")).alias("number"), (F.col("first") + F.col("_lines") + 1).alias("first_line"), "n_lines", "text")
    listed = F.array_sort(F.collect_list(F.struct(PART, "text")))
    return placed.groupBy(file, "number").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("text"), F.sum("n_lines").alias("n_lines"), F.min("first_line").alias("first_line"))


def _whole_lines(lined: DataFrame, file: str, start: Column) -> DataFrame:
    return lined.select(file, PART, F.col("line").alias("text"), F.coalesce(start, F.lit(False)).alias("start"), F.lit(True).alias("fresh")).where("text IS NOT NULL")


def records(lined: DataFrame, file: str, narrow: bool = False) -> DataFrame:
    """(file, record from 0, text, n_lines): a line that looks like a header's start begins a record.

    ``narrow``: only lines with subject and type in brackets do; texts are stripped and blank records left out.
    """
    out = _cut(_whole_lines(lined, file, F.col("line").rlike(NARROW if narrow else RECORD)), file, first_starts=False)
    out = out.select(file, F.col("number").alias("record"), "text", "n_lines")
    return out.withColumn("text", strip(F.col("text"))).where(not_blank(F.col("text"))) if narrow else out


def raw_segments(lined: DataFrame, file: str, header: str, compat: bool = False) -> DataFrame:
    """(file, segment from 1, text, n_lines) from lines that hold ``header``; what stands before the first is dropped. ``compat``: the last one, too."""
    cut = _cut(_whole_lines(lined, file, F.col("line").contains(header)), file).where("number > 0").select(file, F.col("number").alias("segment"), "text", "n_lines")
    if compat:
        last = cut.groupBy(F.col(file).alias("_file")).agg(F.max("segment").alias("_last"))
        cut = cut.join(last, F.col(file).eqNullSafe(F.col("_file"))).where("segment < _last").drop("_file", "_last")
    return cut


def chunks(lined: DataFrame, file: str, size: int = 100, compat: bool = False) -> DataFrame:
    """(file, chunk from 0, text, n_lines) of ``size`` lines. ``compat``: without a last chunk that is not full."""
    rows = _whole_lines(lined, file, F.lit(True))  # each line is a piece
    counts = running(_counts(rows, file), [file], [PART], {"lines_to": "lines"})
    before = counts.select(F.col(file).alias("_file"), F.col(PART).alias("_part"), (F.col("lines_to") - F.col("lines")).alias("_lines"))
    placed = _pieces(rows, file).join(before, F.col(file).eqNullSafe(F.col("_file")) & (F.col(PART) == F.col("_part")))
    at = F.col("_lines") + F.col("first")
    numbered = placed.select(file, F.floor(at / size).alias("chunk"), at.alias("at"), "text")
    listed = F.array_sort(F.collect_list(F.struct("at", "text")))
    out = numbered.groupBy(file, "chunk").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("n_lines"))
    return out.where(F.col("n_lines") == size) if compat else out


def sections(lined: DataFrame, file: str, subjects: tuple[str, ...], size: int = 100) -> DataFrame:
    """(file, section from 1, subject, chunk, text, n_lines): a section begins wherever a subject stands in brackets, also within a line.

    A line is cut before each subject in it, so a piece holds one at its start at most.
    """
    pattern = r"\((" + "|".join(subjects) + r")\)"
    # a line's part before its first subject belongs to the section before
    parts = lined.select(file, PART, F.posexplode(F.split("line", f"(?={pattern})")).alias("_i", "text"))
    rows = parts.select(file, PART, "text", F.col("text").rlike("^" + pattern).alias("start"), (F.col("_i") == 0).alias("fresh"))
    cut = _cut(rows, file).where("number > 0")
    return cut.select(file, F.col("number").alias("section"), F.regexp_extract("text", "^" + pattern, 1).alias("subject"), F.floor((F.col("first_line") - 1) / size).alias("chunk"), "text", "n_lines")


def saved(sectioned: DataFrame, last: int) -> DataFrame:
    """Sections up to number ``last`` as they are written: without trailing newlines, three newlines after."""
    return sectioned.where(F.col("section") <= last).withColumn("text", F.concat(F.regexp_replace("text", r"\n+$", ""), F.lit("\n\n\n")))


def pairs(lined: DataFrame, file: str) -> tuple[DataFrame, DataFrame]:
    """Lines to records to training pairs: ((file, record, instruction, response, trailing), (file, record, header) of those that do not parse)."""
    found = records(lined, file).where(not_blank(F.col("text")))
    head, body = split_record(strip(F.col("text")))
    parsed = parse(found.select(file, "record", head.alias("header"), body.alias("response")))
    good = parsed.where("s IS NOT NULL").select(file, "record", instruction(*map(F.col, "stgm")).alias("instruction"), "response", "trailing")
    return good, parsed.where("s IS NULL").select(file, "record", "header")


def containing(df: DataFrame, text: str, subject: str) -> DataFrame:
    """Records that are not blank and hold the subject anywhere."""
    return df.where(not_blank(F.col(text)) & F.col(text).contains(subject))
