"""One file cut in many splits, against one pass over its text."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions.headers import RECORD
from tessera.operators import segments
from tessera.sources import text


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "0"}.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def written(tmp_path, end):
    """Records of lines of every length, longer and shorter than a split, with characters of several bytes."""
    rng = random.Random(7)
    lines = ["(Art) (Essay) first"]
    for _ in range(120):
        lines += [rng.choice(["(Science) (Essay) D 4 M", "(S) T D 4 M", "(a) (b)", "x (Science) y (Art) z"])] + ["é漢\U0001f600"[: rng.randrange(4)] * rng.randrange(12) + "w" * rng.choice([0, 3, 60, 200]) for _ in range(rng.randrange(4))]
    (tmp_path / "one.txt").write_bytes((end.join(lines) + end).encode())
    (tmp_path / "two.txt").write_bytes(f"only{end}(S) (T) x".encode())
    (tmp_path / "none.txt").write_bytes(b"")
    return lines


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_splits_of_one_file(spark, tmp_path, small_splits, end):
    lines = written(tmp_path, end)
    lined = text.read_lines(spark, str(tmp_path)).select(F.regexp_extract("file", r"([^/]+)$", 1).alias("file"), "part", "line")
    assert lined.rdd.getNumPartitions() > 12
    by_hand = [[lines[0]]]
    for line in lines[1:]:
        by_hand.append([line]) if re.search(RECORD, line) else by_hand[-1].append(line)
    got = {(r["file"], r["record"]): (r["text"], r["n_lines"]) for r in segments.records(lined, "file").collect()}
    assert got == {("one.txt", i): ("\n".join(x), len(x)) for i, x in enumerate(by_hand)} | {("two.txt", 0): ("only", 1), ("two.txt", 1): ("(S) (T) x", 1)}

    if end != "\r\n":
        return
    starts = [i for i, x in enumerate(lines) if "(Science)" in x]
    got = {r["segment"]: r["text"] for r in segments.raw_segments(lined, "file", "(Science)").where("file = 'one.txt'").collect()}
    assert got == {k: "\n".join(lines[i:j]) for k, (i, j) in enumerate(zip(starts, [*starts[1:], None], strict=True), 1)}
    assert segments.raw_segments(lined, "file", "(Science)", compat=True).count() == len(starts) - 1

    got = {r["chunk"]: r["text"] for r in segments.chunks(lined, "file", 7).where("file = 'one.txt'").collect()}
    assert got == {i // 7: "\n".join(lines[i : i + 7]) for i in range(0, len(lines), 7)}

    whole = "\n".join(lines)
    at = [m.start() for m in re.finditer(r"\((Art|Science)\)", whole)]
    want = [(whole[i:j].removesuffix("\n") if j is None or whole[j - 1] == "\n" else whole[i:j], whole.count("\n", 0, i) // 5) for i, j in zip(at, [*at[1:], None], strict=True)]
    got = segments.sections(lined, "file", ("Art", "Science"), size=5).where("file = 'one.txt'").orderBy("section").collect()
    assert [(r["text"], r["chunk"]) for r in got] == want


def test_parts_of_a_table(spark, small_splits):
    """Rows as parts of a file without a name, some of them empty, one null."""
    rows = [(f, i, t) for f in (None, "a") for i, t in enumerate(["(A) (B) x\ny", "", "z\n(C) (D)", None, "w", "(E) (F)"])]
    lined = segments.lines(spark.createDataFrame(rows, "f string, i int, t string").repartition(5), "t", "f", part="i")
    got = {(r["f"], r["record"]): (r["text"], r["n_lines"]) for r in segments.records(lined, "f").collect()}
    assert got == {(f, i): x for f in (None, "a") for i, x in enumerate([("(A) (B) x\ny\n\nz", 4), ("(C) (D)\nw", 2), ("(E) (F)", 1)])}
    assert segments.records(lined.where("false"), "f").count() == 0 == segments.chunks(lined.where("false"), "f").count()
