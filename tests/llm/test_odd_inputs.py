"""Null and repeated ids, vectors of several lengths, one URL on many pages, and columns that clash."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import nearest, packing, pieces, token_counts, url_filter
from tessera.llm.common import tokenizer_path
from tessera.llm.lexicon import Memo
from tessera.llm.word_bpe import encoder

ROWS = [(None, "one text"), (None, None), (7, "a b c"), (7, "a b c"), (7, "another one"), (8, ""), (9, "x" * 20_000)]
SCHEMA = "doc_id long, text string, n_bytes string, sequence_id string, decoded string"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, t, "x", "x", "x") for i, t in ROWS], SCHEMA).repartition(2)


def test_token_counts_of_odd_ids(rows):
    library = encoder(tokenizer_path("word_bpe_49k.json")).library
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(rows).collect()) == want


def test_packing_of_odd_ids(rows):
    """Every row is packed, whatever its id: the pieces of an id hold the ids of all its rows."""
    library = encoder(tokenizer_path("word_bpe_49k.json")).library
    got = packing.pack(rows).collect()
    want = Counter()
    for i, t in ROWS:
        want[i] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    held = Counter()
    for r in got:
        held[r["doc_id"]] += r["length"]
        assert len(r["ids"]) == 4 * r["length"]
    assert held == want
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))]


def test_decoding_replaces_a_clashing_column(spark, rows):
    coded = pieces.encode(rows, keep_text=True).withColumn("decoded", F.lit(1)).unionByName(spark.createDataFrame([(1, None, None, 1)], "doc_id long, text string, ids array<int>, decoded int"))
    got = pieces.decode(coded)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    assert all(r["decoded"] == (r["text"] or "") for r in got.collect())


def test_nearest_of_several_lengths(spark):
    """Vectors of one length meet each other and none of another; of those left out there is no row."""
    rows = [(i, [float(i), 1.0, 2.0]) for i in range(6)] + [(10 + i, [1.0, float(i)]) for i in range(3)] + [(20, None), (21, []), (22, [float("nan")] * 3)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.search(vectors, vectors, k=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    held = dict(rows)
    for q, found in got.items():
        lengths = {len(held[v]) for _, v, _ in found} | {len(held[q])}
        assert len(lengths) == 1 and all(abs(s - sum(a * b for a, b in zip(held[q], held[v], strict=True))) < 1e-12 for _, v, s in found)
    assert set(got) <= set(range(6)) | {10, 11, 12} and set(range(6)) <= set(got)


def test_one_url_on_very_many_pages(spark):
    """A page with a link, under a URL that thousands of pages share: all get the verdict of what it points to."""
    link = '<link rel="canonical" href="http://x.net/fr/a">'
    rows = [(i, "http://hot.org/page", link if i == 77 else "<p>") for i in range(5000)] + [(9000, "http://x.net/fr/a", "<p>"), (9001, None, None), (9002, "http://cold.org/", "<p>")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {(r["v"], r["n"]) for r in got.groupBy(F.col("verdict").alias("v")).agg(F.count("*").alias("n")).collect()} == {("block", 5001), ("allow", 2)}


def test_memos_are_bounded_by_bytes():
    """Large values fill a generation long before its number of words does, and nothing is given wrongly."""
    made = []
    memo = Memo(most=1000, size=20_000)
    for k in range(300):
        names = [f"w{k % 40}", f"x{k}"]
        assert memo.look_up(names, lambda xs: made.append(len(xs)) or [x.encode() * 100 for x in xs]) == [x.encode() * 100 for x in names]
        assert sum(map(len, (*memo.young.values(), *memo.old.values()))) <= 2 * 20_000 + 2_000
    assert sum(made) < 600
