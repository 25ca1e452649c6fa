"""Reproducible stratified splits in four levels, as relational algebra.

Drawing a record always for the split that is furthest behind its ratio is a
merge of events: the j-th draw of split i comes at j / ratio_i, ties to the
lower split. So the order of draws repeats after sum(ratios) draws, and the
number of the draw that takes a record follows from its rank in its block in
closed form; no record waits for another.

Ranks come from running sums over ranges of positions
(:mod:`tessera.operators.ranks`), so a class of any share of the records is
dealt out over many tasks.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranks import running


def draws(ratios: tuple[int, ...]) -> list[int]:
    """The splits drawn, in order, until the pattern repeats."""
    if min(ratios) <= 0:
        raise ValueError("ratios must be positive")
    return [i for _, i in sorted((Fraction(j, r), i) for i, r in enumerate(ratios) for j in range(r))]


def _place(j: Column, at: list[int], period: int) -> Column:
    """The draw (from 1) that is the j-th (from 1) of those at places ``at`` (from 1) of each period."""
    return F.floor((j - 1) / len(at)) * period + F.element_at(F.array(*map(F.lit, at)), ((j - 1) % len(at) + 1).cast("int"))


def _with_totals(df: DataFrame, keys: list[str], **totals: Column) -> DataFrame:
    """``df`` with totals of its groups: combined before they are shuffled, and joined back as one row a group."""
    names = {k: f"_of_{k}" for k in keys}
    table = df.groupBy(*keys).agg(*[v.alias(n) for n, v in totals.items()]).withColumnsRenamed(names)
    return df.join(table, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]).drop(*names.values())


def stratify(df: DataFrame, ratios: tuple[int, ...], cls: str, multi: Column, pos: str = "pos", split: str = "split") -> DataFrame:
    """``df`` (with a present split and position) split again within each present split and class.

    A class is cut into a main block, a multiple of ten, and a rest. In a block
    training draws take records with one label (``multi`` false) from the end,
    other draws those with several, and either the other kind when theirs is used up.
    New positions: class by size, then main block, then draw.
    """
    pattern = draws(ratios)
    period = len(pattern)
    train = [k + 1 for k, i in enumerate(pattern) if i == 0]
    other = [k + 1 for k, i in enumerate(pattern) if i != 0]
    several = F.coalesce(multi, F.lit(False))
    counted = df.withColumns({"_multi": several, "_one": F.lit(1), "_some": several.cast("int")})
    ordered = _with_totals(running(counted, [split, cls], [pos], {"_at": "_one", "_seen": "_some"}), [split, cls], _n=F.count("*"), _first=F.min(pos))
    ordered = ordered.withColumn("_main", F.col("_at") <= F.col("_n") - F.col("_n") % 10)
    # a block's records of a kind follow each other in its order, so the rank from the end is the last one's count less what stands before
    ordered = ordered.withColumn("_kind", F.when(F.col("_multi"), F.col("_seen")).otherwise(F.col("_at") - F.col("_seen")))
    last = lambda kind: F.max(F.when(F.col("_multi") == kind, F.col("_kind")))
    count = lambda kind: F.count_if(F.col("_multi") == kind)
    blocks = _with_totals(ordered, [split, cls, "_main"], _last1=last(True), _last0=last(False), _n1=count(True), _n0=count(False))
    ranked = blocks.withColumns({"_j": F.when(F.col("_multi"), F.col("_last1")).otherwise(F.col("_last0")) - F.col("_kind") + 1, "_others": F.when(F.col("_multi"), F.col("_n0")).otherwise(F.col("_n1"))})
    own = F.when(F.col("_multi"), _place(F.col("_j"), other, period) if other else F.col("_others") + F.col("_j")).otherwise(_place(F.col("_j"), train, period))
    drawn = ranked.withColumn("_k", F.least(own, F.col("_others") + F.col("_j")))
    new = F.element_at(F.array(*map(F.lit, pattern)), ((F.col("_k") - 1) % period + 1).cast("int"))
    order = F.struct(F.col(split).alias("a"), F.col("_n").alias("b"), F.col("_first").alias("c"), (~F.col("_main")).alias("d"), F.col("_k").alias("e"))
    return drawn.select(*[c for c in df.columns if c not in (split, pos)], new.alias(split), order.alias(pos))


def four_levels(parsed: DataFrame, ratios: tuple[int, ...] = (7, 2, 1), order: str = "doc_id") -> DataFrame:
    """(order, split) by subject, grade, type and modifier in turn. Positions are sortable structs, so no level ranks all rows."""
    several = lambda c: F.instr(F.col(c), ",") > 0
    df = parsed.select(order, "s", "t", "g", "m", F.lit(0).alias("split"), F.col(order).alias("pos"))
    for cls, multi in (("s", F.lit(False)), ("g", several("t")), ("t", several("m")), ("m", several("m"))):
        df = stratify(df, ratios, cls, multi)
    return df.select(order, "split")


def composition(split: DataFrame) -> DataFrame:
    """(split, n, percent)."""
    total = split.groupBy("split").agg(F.count("*").alias("n"))
    return total.select(F.element_at(F.array(*map(F.lit, ("Train", "Val", "Test"))), F.col("split") + 1).alias("split"), "n", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()), 2).alias("percent"))
