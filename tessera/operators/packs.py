"""Packing items in order under a budget, where the running total starts anew with each batch.

No window says that, and one task a group would take a group of any size. A
range of a group's items is instead a function: given the total of the batch
that is open where the range begins, it tells how many batches close in it and
what total is open at its end. The next batch's start is found by binary search
in prefix sums, and as only the items before the first close depend on what is
open, the function has one entry for each of these, which the budget bounds.
Functions compose, so ranges are put together in a tree, the totals open at all
ranges follow from its top, and then every range numbers its items on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.operators.lineage import cut_lineage
from tessera.operators.ranks import RANGE, changes, ranged

#: Ranges that are put together in one step of the tree.
FAN = 64
_FUNCTION = "upper array<long>, closed array<long>, open array<long>, total long, fresh_closed long, fresh_open long"


class Steps:
    """What a range does. Entry ``i`` holds where the budget less the open total is at most ``upper[i]``: so many batches close, and so much is open at the end.

    Beyond the last entry nothing closes and ``total`` is added. ``fresh`` is
    what the range does if the group begins with it.
    """

    def __init__(self, upper: np.ndarray, closed: np.ndarray, left: np.ndarray, total: int, fresh: tuple[int, int]):
        self.upper, self.closed, self.left, self.total, self.fresh = upper, closed, left, total, fresh

    @classmethod
    def of(cls, tokens: np.ndarray, budget: int, compat: bool) -> Steps:
        sums = np.cumsum(tokens)
        before = sums - tokens
        upper, first = np.unique(sums, return_index=True)
        enough = np.searchsorted(upper, budget) + 1  # an open total is no less than 0
        upper, first = upper[:enough], first[:enough]
        start = np.concatenate([first, [0]])
        count = np.ones(len(start), np.int64)
        going = np.arange(len(start))
        while len(going):  # pointer jumping of all starts at once
            after = np.maximum(start[going] + 1, np.searchsorted(sums, budget + before[start[going]]))
            going, after = going[after < len(tokens)], after[after < len(tokens)]
            start[going] = after
            count[going] += 1
        left = sums[-1] - before[start]
        return cls(upper, count[:-1], left[:-1], int(sums[-1]), (int(count[-1]) - 1 + int(compat and tokens[0] >= budget), int(left[-1])))

    def apply(self, closed: np.ndarray, left: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.upper, budget - left)
        inside = at < len(self.upper)
        at = np.minimum(at, len(self.upper) - 1)
        return closed + np.where(inside, self.closed[at], 0), np.where(inside, self.left[at], left + self.total)

    def then(self, other: Steps, budget: int) -> Steps:
        closed, left = other.apply(self.closed, self.left, budget)
        later = other.upper > 0  # what passes all of this range has its total added
        fresh = other.apply(np.array([self.fresh[0]]), np.array([self.fresh[1]]), budget)
        out = Steps(np.concatenate([self.upper, other.upper[later] + self.total]), np.concatenate([closed, other.closed[later]]), np.concatenate([left, other.left[later]]), self.total + other.total, (int(fresh[0][0]), int(fresh[1][0])))
        enough = np.searchsorted(out.upper, budget) + 1
        out.upper, out.closed, out.left = out.upper[:enough], out.closed[:enough], out.left[:enough]
        return out

    def row(self) -> list:
        return [self.upper, self.closed, self.left, self.total, *self.fresh]

    @classmethod
    def from_row(cls, r) -> Steps:
        return cls(*(np.asarray(r[c], np.int64) for c in ("upper", "closed", "open")), int(r["total"]), (int(r["fresh_closed"]), int(r["fresh_open"])))


def _edges(local: DataFrame, group: str, tokens: str, budget: int, compat: bool) -> DataFrame:
    """(group, range, function) of the first and the last group of each range: only these may go on in another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key, number, firsts = None, None, True

        def emit() -> pa.RecordBatch:
            values = [[x] for x in Steps.of(np.concatenate(held), budget, compat).row()]
            return pa.RecordBatch.from_arrays([key, pa.array([number], pa.int32()), *(pa.array(v, pa.list_(pa.int64()) if k < 3 else pa.int64()) for k, v in enumerate(values))], names=["g", "r", "upper", "closed", "open", "total", "fresh_closed", "fresh_open"])

        for b in batches:
            if not b.num_rows:
                continue
            if key is None:
                key, number = b.column(0).slice(0, 1), b.column(2)[0].as_py()
            column, values = b.column(0), b.column(1).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            cut = changes([column])
            cut[0] = key[0].as_py() != column[0].as_py()
            starts = np.flatnonzero(cut)
            if len(starts):
                held.append(values[: starts[0]])
                if firsts:
                    yield emit()
                    firsts = False
                held, values, column = [], values[starts[-1] :], column.slice(int(starts[-1]))
            held.append(values)
            key, number = column.slice(0, 1), b.column(2)[0].as_py()
        if held:
            yield emit()

    kind = local.schema[group].dataType.simpleString()
    return local.select(F.col(group).alias("g"), F.col(tokens).cast("long").alias("n"), RANGE).mapInArrow(run, f"g {kind}, r int, {_FUNCTION}")


def _entries(edges: DataFrame, kind: str, budget: int) -> DataFrame:
    """(g, r, closed, open) for each of ``edges`` but a group's first: what has closed before it and what is open there."""
    place = F.row_number().over(Window.partitionBy("g").orderBy("r")) - 1
    levels = [cut_lineage(edges.withColumn("i", place.cast("long")))]

    def put_together(t: pd.DataFrame) -> pd.DataFrame:
        rows = t.sort_values("i").to_dict("records")
        out = Steps.from_row(rows[0])
        for r in rows[1:]:
            out = out.then(Steps.from_row(r), budget)
        return pd.DataFrame([[rows[0]["g"], *out.row(), rows[0]["i"] // FAN]], columns=["g", "upper", "closed", "open", "total", "fresh_closed", "fresh_open", "i"])

    def spread(key, t: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        out, state = [], None if not len(above) or above["open"].isna()[0] else (int(above["closed_before"][0]), int(above["open"][0]))
        for r in t.sort_values("i").to_dict("records"):
            out.append([r["g"], r["i"], r["r"], *(state or (None, None))])
            steps = Steps.from_row(r)
            state = steps.fresh if state is None else tuple(int(x[0]) for x in steps.apply(np.array([state[0]]), np.array([state[1]]), budget))
        return pd.DataFrame(out, columns=["g", "i", "r", "closed_before", "open"]).astype({"closed_before": "Int64", "open": "Int64"})

    while levels[-1].where(F.col("i") >= FAN).limit(1).count():
        grouped = levels[-1].groupBy("g", F.floor(F.col("i") / FAN))
        levels.append(cut_lineage(grouped.applyInPandas(put_together, f"g {kind}, {_FUNCTION}, i long")))
    state = edges.sparkSession.createDataFrame([], f"g {kind}, i long, r int, closed_before long, open long")
    for level in reversed(levels):
        rows = level if "r" in level.columns else level.withColumn("r", F.lit(None).cast("int"))
        state = cut_lineage(rows.groupBy("g", F.floor(F.col("i") / FAN)).cogroup(state.groupBy("g", "i")).applyInPandas(spread, "g " + kind + ", i long, r int, closed_before long, open long"))
    return state.where("open IS NOT NULL").select("g", "r", "closed_before", "open")


def packed(df: DataFrame, group: str, order: str, tokens: str, budget: int, compat: bool = False, batch: str = "batch_id") -> DataFrame:
    """``df`` with the number of each item's batch (from 1 in each group): a batch closes before the item that would make it reach the budget.

    A null count is 0; rows without a group are a group; items of equal order
    take the place they are read in; a column named as the batch is replaced.
    ``compat``: a first item at or over the budget leaves batch 1 empty.
    """
    rows = df.drop(batch)
    one, at, total, key, number, closed, left = ("_" * (k + max(map(len, rows.columns))) for k in range(1, 8))  # clash with no column
    local = ranged(rows.withColumn(one, F.lit(1)), [group], [order], {at: one, total: tokens})
    entries = _entries(_edges(local, group, tokens, budget, compat), rows.schema[group].dataType.simpleString(), budget)
    entries = entries.select(F.col("g").alias(key), F.col("r").alias(number), F.col("closed_before").alias(closed), F.col("open").alias(left))
    schema, kept = StructType([*rows.schema.fields, StructField(batch, LongType())]), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, now, sum_ = object(), 1, 0
        for b in batches:
            out = []
            columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in (group, RANGE, tokens, closed, left)]
            for g, r, n, before, open_ in zip(*columns, strict=True):
                n, first = n or 0, False
                if (g, r) != present:
                    present, first = (g, r), open_ is None
                    now, sum_ = (1, 0) if first else (before + 1, open_)
                if sum_ + n >= budget and (compat or not first):
                    now, sum_ = now + 1, n
                else:
                    sum_ += n
                out.append(now)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(out, pa.int64())], names=[*kept, batch])

    # two rows a range at most
    joined = local.join(F.broadcast(entries), F.col(group).eqNullSafe(F.col(key)) & (F.col(RANGE) == F.col(number)), "left")
    return joined.sortWithinPartitions(RANGE, group, at).mapInArrow(run, schema)
