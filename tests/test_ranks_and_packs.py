"""Running sums, ranks, splits and packs over ranges, against one loop over all rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import requests, split
from tessera.operators.packs import Steps
from tessera.operators.ranks import ranged, ranked, running
from tests.test_headers import simulate


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables in many ranges, as large ones would be."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None, "c"]), rng.choice([None, 0, 1]), i, rng.choice([None, 0, 1, 5])) for i in range(700)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, h int, i int, n long")
    for group in (["g"], ["g", "h"], []):
        got = {r["i"]: (r["s"], r["k"]) for r in running(df.withColumn("one", F.lit(1)), group, ["i"], {"s": "n", "k": "one"}).collect()}
        totals, want = {}, {}
        for r in sorted(rows, key=lambda r: r[2]):
            key = r[:2][: len(group)]
            s, k = totals.get(key, (0, 0))
            want[r[2]] = totals[key] = (s + (r[3] or 0), k + 1)
        assert got == want
    assert ranged(df, ["g"], ["i"], {"s": "n"}).select("_range").distinct().count() >= 8
    assert [r["rank"] for r in ranked(df, [], [F.desc("i")]).orderBy(F.desc("i")).collect()] == list(range(1, 701))
    assert running(df.where("false"), ["g"], ["i"], {"s": "n"}).count() == 0


def packed_by_loop(rows, budget, compat):
    out, state = {}, {}
    for g, i, n in sorted(rows, key=lambda r: r[1]):
        batch, total = state.get(g, (1, 0))
        if total + (n or 0) >= budget and (compat or g in state):
            batch, total = batch + 1, n or 0
        else:
            total += n or 0
        state[g] = batch, total
        out[i] = batch
    return out


@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize("sizes", [[0, 3, 7, 25, None], [1], [0], [20, 19, 21, 0, 60], [1, 1, 1, 2, 500]])
def test_pack(spark, sizes, compat):
    """One group over many ranges, small ones beside it, items at and over the budget."""
    rng = random.Random(2)
    rows = [(rng.choice(["a"] * 8 + ["b", None, "z"]), i, rng.choice(sizes)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, i int, n int").withColumn("batch_id", F.lit("old")).repartition(3)
    got = requests.pack(df, "g", "i", "n", 20, compat)
    assert got.columns == ["g", "i", "n", "batch_id"]
    assert {r["i"]: r["batch_id"] for r in got.collect()} == packed_by_loop(rows, 20, compat)


def test_pack_one_group_in_many_tasks(spark):
    rows = [("a", i, 1 + i * i % 13) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i int, n int")
    got = requests.pack(df, "g", "i", "n", 100)
    assert {r["i"]: r["batch_id"] for r in got.collect()} == packed_by_loop(rows, 100, False)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() >= 8


def test_pack_in_several_levels(spark, monkeypatch):
    from tessera.operators import packs

    monkeypatch.setattr(packs, "FAN", 2)
    rows = [("a" if i % 50 else "b", i, i * 7 % 11) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, i int, n int")
    assert {r["i"]: r["batch_id"] for r in requests.pack(df, "g", "i", "n", 30).collect()} == packed_by_loop(rows, 30, False)


def test_functions_compose():
    rng = np.random.default_rng(3)
    for _ in range(200):
        budget, compat = int(rng.integers(1, 30)), bool(rng.integers(2))
        parts = [rng.choice([0, 0, 1, 2, 9, 40], int(rng.integers(1, 12))) for _ in range(4)]
        steps = Steps.of(parts[0], budget, compat)
        for p in parts[1:]:
            steps = steps.then(Steps.of(p, budget, compat), budget)
        whole = Steps.of(np.concatenate(parts), budget, compat)
        assert steps.fresh == whole.fresh and steps.total == whole.total
        for left in range(0, 60):
            a = steps.apply(np.array([0]), np.array([left]), budget)
            batch, total = 0, left
            for n in np.concatenate(parts).tolist():
                batch, total = (batch + 1, n) if total + n >= budget else (batch, total + n)
            assert (int(a[0][0]), int(a[1][0])) == (batch, total) == tuple(int(x[0]) for x in whole.apply(np.array([0]), np.array([left]), budget))


def test_four_levels_draw_by_draw(spark):
    """All four levels against two stacks that are drawn from one by one; most records are of one class."""
    rng = random.Random(6)
    pick = lambda *xs: rng.choice(xs)
    rows = [(i, pick("A", "A", "A", "B"), pick("t", "t,u", "v"), pick("4", "4", "5"), pick("m", "m,n", "o", "o")) for i in range(433)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r["split"] for r in split.four_levels(spark.createDataFrame(rows, "doc_id long, s string, t string, g string, m string")).collect()}
    present = [(r[0], r, 0) for r in sorted(rows)]  # id, record, split in the order of positions
    for cls, several in ((1, lambda r: False), (3, lambda r: "," in r[2]), (2, lambda r: "," in r[4]), (4, lambda r: "," in r[4])):
        groups: dict = {}
        for at, (i, r, s) in enumerate(present):
            groups.setdefault((s, r[cls]), []).append((at, i, r))
        order = []
        for (s, _), members in sorted(groups.items(), key=lambda x: (x[0][0], len(x[1]), x[1][0][0])):
            main = len(members) - len(members) % 10
            for block in (members[:main], members[main:]):
                drawn = simulate([(i, several(r)) for _, i, r in block], (7, 2, 1))  # a dict keeps the order of draws
                order += [(new, s, i) for i, new in drawn.items()]
        records = {i: r for i, r, _ in present}
        # records of one new split stand as they were drawn, class by class of the old splits
        present = [(i, records[i], new) for new, _, i in order]
    assert got == {i: new for i, _, new in present}
