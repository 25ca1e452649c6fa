"""The join of similar labels against all pairs, and that its candidates stay few."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import headers
from tessera.operators import labels, similar


def common(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def changed(rng, text, letters):
    text = list(text)
    for _ in range(rng.randrange(4)):
        i = rng.randrange(len(text) + 1)
        text[i : i + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
    return "".join(text)


def test_counts_of_shared_grams():
    """What the filters take for granted, over random edits."""
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 40)))
        b = changed(rng, a, "abc")
        if not b or 200 * common(a, b) <= 90 * (len(a) + len(b)):
            continue
        q = similar.Q[min(len(a), len(b)) > similar.SHORT]
        left = [b[i : i + q] for i in range(len(b) - q + 1)]
        n = 0
        for i in range(len(a) - q + 1):
            if a[i : i + q] in left:
                left.remove(a[i : i + q])
                n += 1
        assert n >= similar.shared(len(a), len(b), q, 90) >= similar.kinds(len(a), 90)[q]
    assert similar.indexable(300, 90) and not similar.indexable(40, 55)


@pytest.mark.parametrize("least", [90, 80, 55])
def test_equal_to_all_pairs(spark, least):
    rng = random.Random(least)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(0, 34))) for _ in range(120)]
    names = list(dict.fromkeys([*base, *(changed(rng, rng.choice(base), "abcde ") for _ in range(250)), "", "a", "b", "ab", "Topic Exercise x", "Topic Activity x"]))
    found = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "label string, first_pos long")
    got = {(r["label"], r["other"]): round(r["score"], 6) for r in labels.fuzzy_pairs(found, "m", least).collect()}
    want = {}
    text = {n: " ".join(sorted(n.replace("Exercise ", "").replace("Activity ", "").split())) for n in names}
    for i, a in enumerate(names):
        for b in names[:i]:
            x, y = text[a], text[b]
            total = len(x) + len(y)
            score = 200 * common(x, y) / total if total else 100.0
            if score > least and not ("Exercise" in a and "Activity" in b or "Exercise" in b and "Activity" in a):
                want[a, b] = round(score, 6)
    assert got == want


def test_candidates_grow_with_the_labels(spark):
    """Labels of one length, each with one near copy: candidates a label stay level where all pairs would double."""
    def per_label(n):
        rng = random.Random(3)
        rows = []
        for _ in range(n // 2):
            a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20))
            rows += [(a,), (a[:7] + "-" + a[8:],)]
        return similar.candidates(spark.createDataFrame(rows, "text string"), 90).count() / n

    few, many = per_label(3000), per_label(12000)
    assert 0.5 <= few <= many < 0.6


def test_records_that_share_an_id(spark):
    rows = [(1, "(S) (Essay, Quiz) D 4 (A, B)"), (1, "(S) (Essay) D 4 (C)"), (2, "(S) (Essay) D 4 (B)")]
    parsed = headers.parse(spark.createDataFrame(rows, "rid long, header string"))
    got = labels.statistics(parsed, order="rid")
    assert {r["combo"]: r["cnt"] for r in got["combo"].collect()} == {"S|EssayQuiz|4|AB": 1, "S|Essay|4|C": 1, "S|Essay|4|B": 1}
    assert {r["kind"]: r["n"] for r in got["unique"].collect()} == {"s": 1, "t": 2, "g": 1, "m": 3, "combo": 3}
    rare = labels.rarest(parsed, labels.counts(parsed, "m", "rid"), "m", order="rid").collect()
    assert sorted((r["rid"], r["label"], r["single"]) for r in rare) == [(1, "A", False), (1, "C", True), (2, "B", True)]
    arrays = labels.combinations(parsed, "rid").where(F.size("types") == 2).first()
    assert (arrays["types"], arrays["modifiers"], arrays["cnt"]) == (["Essay", "Quiz"], ["A", "B"], 1)
