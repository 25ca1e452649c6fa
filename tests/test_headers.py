from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.functions import headers, instruct, markup
from tessera.operators import labels, layout, requests, segments, split


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_headers_parse_and_reject(spark):
    rows = [(1, "(Science) (Word Problem) D 4 (Multi-part, With Hint)"), (2, "S T D G M"), (3, "(Science) (Quiz) D 4 (With Hint) extra"), (4, "(Science) Quiz D 4 M"), (5, None), (6, "")]
    got = {r["i"]: r for r in headers.parse(spark.createDataFrame(rows, "i int, header string")).collect()}
    assert (got[1]["s"], got[1]["t"], got[1]["g"], got[1]["m"], got[1]["grade"]) == ("Science", "Word Problem", "4", "Multi-part, With Hint", 4)
    assert got[2]["grade"] is None and got[2]["s"] == "S"
    assert got[3]["trailing"] and not got[1]["trailing"]
    assert got[4]["s"] is None and got[5]["s"] is None and got[6]["s"] is None


def test_instructions(spark):
    text = lambda t: one(spark, instruct.exercise_type(F.lit(t)))
    assert text("T") == "Give me an exercise"
    assert text("Essay") == "Give me an essay"
    assert text("Quiz, Essay") == "Give me a combination of a quiz and an essay"
    assert text("Quiz, Essay, Test") == "Give me a combination of a quiz, an essay, and a test"
    assert one(spark, instruct.grade_and_subject(F.lit("11"), F.lit("French"))) == "for a 11th grade student learning French."
    assert one(spark, instruct.grade_and_subject(F.lit("G"), F.lit("S"))) == "for a student."
    said = lambda m: one(spark, instruct.modifier(F.lit(m)))
    assert said("With Prerequisites, With Context") == " It should have a subsection for prerequisites, and context."
    assert said("Question with reasoning") == " It should be a question involving reasoning."
    assert said("Short") == " It should be a short."
    assert said("M") == ""


def test_ordinals(spark):
    got = spark.range(1, 114).select("id", instruct.ordinal_suffix(F.col("id")).alias("x")).collect()
    want = {1: "st", 2: "nd", 3: "rd", 4: "th", 11: "th", 12: "th", 13: "th", 21: "st", 112: "th", 113: "th"}
    assert {r["id"]: r["x"] for r in got if r["id"] in want} == want


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_token_sort_ratio(spark):
    pairs = [("b a", "a b"), ("fractions", "fraction"), ("abc", "xyz"), ("", ""), ("", "a"), ("one two three", "three one")]
    got = [r["x"] for r in spark.createDataFrame(pairs, "a string, b string").select(labels.token_sort_ratio(F.col("a"), F.col("b")).alias("x")).collect()]
    for (a, b), x in zip(pairs, got, strict=True):
        a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
        assert abs(x - (200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100)) < 1e-9


def test_aliases_best_then_earliest(spark):
    found = spark.createDataFrame([("Word Problem", 5, 1), ("Word Problems", 2, 2), ("Problem Word", 1, 3), ("Math Exercise", 1, 4), ("Math Activity", 1, 5), ("Exercise", 3, 6)], "label string, cnt long, first_pos long")
    got = {r["alias"]: r["canonical"] for r in labels.aliases(found, "t").collect()}
    assert got == {"Word Problems": "Word Problem", "Problem Word": "Word Problem"}


def simulate(sides, ratios):
    """Two stacks, always drawing for the split that is furthest behind."""
    pattern = split.draws(ratios)
    unique, multi = [x for x, m in sides if not m], [x for x, m in sides if m]
    out = {}
    for k in range(len(sides)):
        s = pattern[k % len(pattern)]
        stack = (unique or multi) if s == 0 else (multi or unique)
        out[stack.pop()] = s
    return out


def test_split_is_the_two_stack_draw(spark):
    import random

    rng = random.Random(3)
    for ratios in ((7, 2, 1), (6, 2, 2), (8, 1, 1)):
        rows = [(i, f"c{rng.randrange(4)}", rng.random() < 0.4) for i in range(157)]
        df = spark.createDataFrame(rows, "i long, c string, m boolean").select("*", F.lit(0).alias("split"), F.col("i").alias("pos"))
        got = {r["i"]: r["split"] for r in split.stratify(df, ratios, "c", F.col("m")).collect()}
        want = {}
        for c in {r[1] for r in rows}:
            members = [(i, m) for i, k, m in rows if k == c]
            main = len(members) - len(members) % 10
            want |= simulate(members[:main], ratios) | simulate(members[main:], ratios)
        assert got == want


def test_segments(spark):
    text = "intro\n(A) (B) D 1 M\nx\n(a) (b) list\ny"
    lined = segments.lines(spark.createDataFrame([(1, text), (2, "")], "f int, t string"), "t", "f")
    got = {(r["f"], r["record"]): r["text"] for r in segments.records(lined, "f").collect()}
    assert got == {(1, 0): "intro", (1, 1): "(A) (B) D 1 M\nx", (1, 2): "(a) (b) list\ny", (2, 0): ""}
    raw = {r["segment"]: r["text"] for r in segments.raw_segments(lined, "f", "(A)").collect()}
    assert raw == {1: "(A) (B) D 1 M\nx\n(a) (b) list\ny"}
    assert segments.raw_segments(lined, "f", "(A)", compat=True).count() == 0
    assert segments.chunks(lined, "f", 2).where("f = 1").count() == 3 and segments.chunks(lined, "f", 2, compat=True).where("f = 1").count() == 2


def test_pack_by_budget(spark):
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate([12, 4, 5, 1, 9])] + [("b", 0, 3)], "g string, i int, n long")
    got = {(r["g"], r["i"]): r["batch_id"] for r in requests.pack(df, "g", "i", "n", 10).collect()}
    assert got == {("a", 0): 1, ("a", 1): 2, ("a", 2): 2, ("a", 3): 3, ("a", 4): 4, ("b", 0): 1}
    compat = {(r["g"], r["i"]): r["batch_id"] for r in requests.pack(df, "g", "i", "n", 10, compat=True).collect()}
    assert compat[("a", 0)] == 2


def test_close_blocks(spark):
    blocks = spark.createDataFrame([(1, 1, 0.0, 0.0, 50.0, 20.0), (1, 2, 0.0, 35.0, 50.0, 50.0), (1, 3, 0.0, 66.0, 50.0, 80.0), (2, 1, 0.0, 0.0, 1.0, 1.0)], "page_id int, block_no int, x0 double, y0 double, x1 double, y1 double")
    got = {(r["page_id"], r["block_no"], r["near_no"]) for r in layout.close_pairs(blocks).collect()}
    assert got == {(1, 1, 2), (1, 2, 1)}


def test_bleu(spark):
    df = spark.createDataFrame([("the cat sat on the mat", "the cat sat on the mat"), ("a b c d", "a b c d")], "h string, r string")
    assert abs(requests.corpus_bleu(df, "h", "r").first()["bleu"] - 1) < 1e-9
    assert requests.corpus_bleu(spark.createDataFrame([("x", "y")], "h string, r string"), "h", "r").first()["bleu"] == 0


def test_bleu_counts_pairs_where_they_are_read(spark):
    """Clipped counts of repeated words; nothing is dealt out by n-grams."""
    df = spark.createDataFrame([("a a a b c d", "a a b c d e f"), ("x", None), (None, "y z")], "h string, r string")
    got = requests.corpus_bleu(df, "h", "r")
    want = (5 / 7 * 4 / 5 * 3 / 4 * 2 / 3) ** 0.25 * math.exp(1 - 9 / 7)
    assert abs(got.first()["bleu"] - want) < 1e-12
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert requests.corpus_bleu(df.where("false"), "h", "r").first()["bleu"] == 0


def test_markup(spark):
    assert one(spark, markup.without_brackets(F.lit("a(b)[c]{d}"))) == "abcd"
    assert one(spark, markup.without_brackets(F.lit("a(b)"), compat=True)) == "ab)"
    assert one(spark, markup.to_latex_words(F.lit("x **a** *b* _c_ y"))) == "x \\textbf{a} \\emph{b} \\underline{c} y"
    assert one(spark, markup.lists_to_latex(F.lit("1. one\n2. two\n"))) == "\\begin{enumerate}\n\\item one\n\\item two\n\\end{enumerate}\n"
    assert one(spark, markup.first_number(F.lit("grade 12, page 3"))) == "12"
    assert one(spark, markup.reconciled(F.lit("(A) (B) D 1 (With Answer)"), F.lit("x"))) == "(A) (B) D 1 M"
    assert one(spark, markup.reconciled(F.lit("(A) (B) D 1 (With Hint)"), F.lit("\\subsection{Answers}"))) == "(A) (B) D 1 (With Hint, With Answer)"
