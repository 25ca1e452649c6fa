"""Parsing of question headers ``S T D G M``: subject, exercise types, grade and modifiers, each in brackets or a bare placeholder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed format of a header, anchored at its start; text may follow.
HEADER = r"^(\([^)]*\)|S)\s(\([^)]*\)|T)\sD\s(\d+|G)\s(\([^)]*\)|M)"
SEPARATOR = "\x1f"
#: A line that starts a record; the narrower form has both subject and type in brackets.
NARROW = r"^\([^\n]*?\) \([^\n]*?\)"
RECORD = r"^(\([^\n]*?\) \([^\n]*?\)|\([^\n]*?\) T D \d)"


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def not_blank(x: Column) -> Column:
    return x.rlike(r"\S")


def parse(df: DataFrame, header: str = "header") -> DataFrame:
    """``df`` with s, t, g, m, the grade as a number, and whether text follows the header; nulls if it does not parse.

    One match writes the parts of a header between separators (which a header
    itself is freed of), so its pattern is not tried once a part.
    """
    h = F.translate(F.col(header), SEPARATOR, "")
    marked = F.regexp_replace(h, f"(?s){HEADER}(.*)$", SEPARATOR.join(f"${i}" for i in range(1, 6)))
    name = "_" * (1 + max(map(len, df.columns)))  # clashes with no column
    parts = F.split(marked, SEPARATOR)
    cut = df.withColumn(name, F.when(F.size(parts) == 5, parts))
    part = lambda i: F.translate(F.get(F.col(name), F.lit(i)), "()", "")
    cut = cut.withColumns({"s": part(0), "t": part(1), "g": part(2), "m": part(3), "trailing": F.get(F.col(name), F.lit(4)) != ""})
    return cut.withColumn("grade", F.when(F.col("g") != "G", F.col("g").cast("int"))).drop(name)


def labels(x: Column) -> Column:
    """The labels of a comma list, stripped, in order."""
    return F.transform(F.split(x, ","), strip)


def split_record(record: Column) -> tuple[Column, Column]:
    """(header, body) of a record: its first line and the rest, empty where there is none."""
    at = F.instr(record, "\n")
    return F.when(at > 0, F.substring_index(record, "\n", 1)).otherwise(record), F.when(at > 0, F.substr(record, at + 1)).otherwise(F.lit(""))
