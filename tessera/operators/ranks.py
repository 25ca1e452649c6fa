"""Running sums and ranks over any order, without a task that holds a group.

A window function puts all rows of its partition in one task. Here rows are
dealt out by ranges of (group, order), each range is summed up on its own, and
a table of one row for each range and group gives what stands before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tessera.operators.lineage import cut_lineage

RANGE = "_range"


def changes(columns: list[pa.Array]) -> np.ndarray:
    """Whether a row begins a group: it differs from the one before in a column (nulls are equal); the first row is not judged."""
    out = np.zeros(len(columns[0]) if columns else 0, bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, max(0, len(c) - 1))
        same = pc.or_kleene(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        out[1:] |= ~np.asarray(same.to_numpy(zero_copy_only=False), bool)
    return out


def ranged(df: DataFrame, group: list[str], order: list[str | Column], sums: dict[str, str]) -> DataFrame:
    """``df`` dealt out by ranges of (group, order), sorted and kept as a table, with the number of the range and the sums of each column up to and with the row, within its range and group.

    ``sums``: name of a sum -> column of whole numbers, whose nulls are 0.
    """
    kind = StructType([*df.schema.fields, StructField(RANGE, IntegerType()), *(StructField(n, LongType()) for n in sums)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None
        carried = dict.fromkeys(sums, 0)
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(b.schema.get_field_index(g)) for g in group]
            first = changes(keys) if keys else np.zeros(b.num_rows, bool)
            here = [k[0].as_py() for k in keys]
            first[0] = last is not None and here != last
            starts = np.flatnonzero(first)
            at = np.searchsorted(starts, np.arange(b.num_rows), side="right") - 1
            more = []
            for name, column in sums.items():
                values = pc.fill_null(b.column(b.schema.get_field_index(column)).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
                total = np.cumsum(values)
                base = np.concatenate([[-carried[name]], (total - values)[starts]])
                more.append(total - base[at + 1])
                carried[name] = int(more[-1][-1])
            last = [k[-1].as_py() for k in keys]
            number = pa.array(np.full(b.num_rows, partition()), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, number, *map(pa.array, more)], names=[*b.schema.names, RANGE, *sums])

    def partition() -> int:
        from pyspark import TaskContext

        return TaskContext.get().partitionId()

    by = [*group, *order] or [F.lit(0)]
    return cut_lineage(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, kind))


def running(df: DataFrame, group: list[str], order: list[str | Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with the sum of each column of ``sums`` (name -> column of whole numbers from 0) over the rows of its group up to and with each row.

    Rows of equal order take the place they are read in; add a key to ``order``
    where that matters. A table with a row a range and group holds the offsets;
    what grows with the data is sorted by range only.
    """
    local = ranged(df, group, order, sums)
    names = {n: f"_total_{n}" for n in sums}
    ends = local.groupBy(*group, RANGE).agg(*[F.max(n).alias(names[n]) for n in sums])
    before = Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    keys = {g: f"_key_{i}" for i, g in enumerate([*group, RANGE])}
    offsets = ends.select(*[F.col(g).alias(k) for g, k in keys.items()], *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(t) for t in names.values()])
    same = [F.col(g).eqNullSafe(F.col(k)) for g, k in keys.items()]
    joined = local.join(offsets, same, "left")
    return joined.select(*df.columns, *[(F.col(n) + F.col(t)).alias(n) for n, t in names.items()])


def ranked(df: DataFrame, group: list[str], order: list[str | Column], rank: str = "rank") -> DataFrame:
    """``df`` with the place (from 1) of each row in its group."""
    name = "_" * (1 + max(map(len, df.columns)))  # clashes with no column
    return running(df.withColumn(name, F.lit(1)), group, order, {rank: name}).drop(name)
