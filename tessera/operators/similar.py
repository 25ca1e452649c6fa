"""Similarity join of many short texts by common subsequences, with an index on q-grams.

Two texts score 200 times their longest common subsequence over their joint
length. A score over ``least`` allows d = deletions + insertions fewer than
(100 - least) % of the joint length, so in the text of length n at most D
deletions and I insertions stand between it and the other one. Each deletion
breaks at most q of its q-grams and each insertion at most q - 1, so
n - q + 1 - qD - (q - 1)I of them are in the other text too (the count filter),
and as many are lost at most; a text's rarest q-grams, one more than may be
lost, must hold one that the other text has among its own (the prefix filter).
Only such pairs are compared, at places no further apart than d.

Texts of up to ``SHORT`` characters use pairs of characters, longer ones four;
a pair belongs to the kind of its shorter text.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Length up to which texts use the first q, and the two q.
SHORT, Q = 11, (2, 4)


def edits(n: int, m: int, least: float) -> int:
    """The most deletions and insertions between texts of these lengths whose score is over ``least``; -1 if there is no such score."""
    most = ceil(round((n + m) * (100 - least) / 100, 9)) - 1
    most -= (most - abs(n - m)) % 2  # as odd as the difference of the lengths
    return most if most >= abs(n - m) else -1


def shared(n: int, m: int, q: int, least: float) -> int | None:
    """How many q-grams of a text of length ``n`` one of length ``m`` must have; None if no score is high enough."""
    d = edits(n, m, least)
    if d < 0:
        return None
    deleted = (d + n - m) // 2
    return n - q + 1 - q * deleted - (q - 1) * (d - deleted)


def kinds(n: int, least: float) -> dict[int, int]:
    """q -> the least of :func:`shared` over partners for which texts of length ``n`` use it."""
    out: dict[int, int] = {}
    m = 1
    while n and m <= n * (100 + (100 - least)) / least + 1:
        q = Q[min(n, m) > SHORT]
        if (s := shared(n, m, q, least)) is not None:
            out[q] = min(out.get(q, s), s)
        m += 1
    return out


def indexable(longest: int, least: float) -> bool:
    """Whether every pair of texts up to this length must share a q-gram."""
    return all(s > 0 for n in range(2, longest + 1) for s in kinds(n, least).values())


def prefixes(texts: DataFrame, least: float) -> DataFrame:
    """(q, gram, at, text, n): of each text, the rarest q-grams that may not all be lost; the k-th occurrence of a q-gram is one of its own."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, dict[int, int]] = {}
        for b in batches:
            rows: list[tuple] = []
            for text in b.column(0).to_pylist():
                n = len(text)
                if n not in known:
                    known[n] = kinds(n, least)
                for q, s in known[n].items():
                    seen: dict[str, int] = {}
                    for i in range(n - q + 1):
                        g = text[i : i + q]
                        seen[g] = seen.get(g, 0) + 1
                        rows.append((q, f"{g}{seen[g]}", i, text, n, n - q + 1 - s + 1))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds_ = (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_, strict=True)], names=["q", "gram", "at", "text", "n", "size"])

    every = texts.select("text").mapInArrow(grams, "q int, gram string, at int, text string, n int, size int")
    often = every.groupBy("q", "gram").agg(F.count("*").alias("often"))
    rare = Window.partitionBy("text", "q").orderBy("often", "gram")
    placed = every.join(often, ["q", "gram"]).withColumn("place", F.row_number().over(rare))
    return placed.where(F.col("place") <= F.col("size")).select("q", "gram", "at", "text", "n")


def candidates(texts: DataFrame, least: float = 90) -> DataFrame:
    """(x, y), x < y, of distinct ``text``\\ s that the filters let through: all pairs that score over ``least``, and few others."""
    index = prefixes(texts, least)
    a = index.select("q", "gram", F.col("text").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"))
    b = index.select("q", "gram", F.col("text").alias("y"), F.col("n").alias("ny"), F.col("at").alias("ay"))
    total = F.col("nx") + F.col("ny")
    most = F.ceil(F.round(total * (100 - least) / 100, 9)) - 1
    met = a.join(b, ["q", "gram"]).where(F.col("x") < F.col("y"))
    met = met.where((F.col("q") == F.when(F.least("nx", "ny") > SHORT, Q[1]).otherwise(Q[0])) & (F.abs(F.col("nx") - F.col("ny")) <= most) & (F.abs(F.col("ax") - F.col("ay")) <= most))
    pairs = met.groupBy("q", "x", "y").agg(F.first("nx").alias("nx"), F.first("ny").alias("ny"))
    # the count filter, on distinct q-grams: repeated ones are counted as if shared
    all_grams = lambda c, n: F.transform(F.sequence(F.lit(1), F.col(n) - F.col("q") + 1), lambda i: F.substr(F.col(c), i, F.col("q")))
    cut = pairs.withColumns({"_g": all_grams("x", "nx"), "_h": all_grams("y", "ny"), "_d": (most - F.pmod(most - F.abs(F.col("nx") - F.col("ny")), F.lit(2))).cast("int")})
    deleted = F.floor((F.col("_d") + F.col("nx") - F.col("ny")) / 2)
    needed = F.col("nx") - F.col("q") + 1 - F.col("q") * deleted - (F.col("q") - 1) * (F.col("_d") - deleted)
    repeats = F.size("_g") - F.size(F.array_distinct("_g"))
    return cut.where(F.size(F.array_intersect("_g", "_h")) >= needed - repeats).select("x", "y")
