"""Operators on vectors, pages and the pipeline against brute force, with the defined edge cases."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import graph_dedup, nearest, url_filter
from tessera.llm.components import components


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8))
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 7] + rng.normal(size=8) * 0.2).tolist(), int(i % 7 % 2)) for i in range(80)]
    rows += [(200 + i, base[0].tolist(), 0) for i in range(15)]
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] * 8, 0), (303, [1.0, None, *[0.0] * 6], 0), (304, base[0].tolist(), None), (305, [float("inf"), *[1.0] * 7], 1), (320, [], 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k, "x", "x") for i, v, k in rows], "vec_id long, embedding array<double>, label int, id string, v string")


def good(v):
    return bool(v) and None not in v and np.isfinite(v).all() and any(v)


def test_graph_dedup(spark, vectors):
    got = {r["vec_id"]: r for r in graph_dedup.near_duplicate_vectors(frame(spark, vectors)).collect()}
    rows = [(i, np.array(v) / np.linalg.norm(v), k) for i, v, k in vectors if good(v) and k is not None]
    links = {i: set() for i, _, _ in vectors}
    for i, u, a in rows:
        links[i] = {j for j, w, b in rows if i != j and a == b and u @ w >= 0.93}
    low = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in low:
                low[x] = i
                todo += links[x]
    assert {i: r["n_links"] for i, r in got.items()} == {i: len(x) for i, x in links.items()}
    assert {i: r["component_id"] for i, r in got.items()} == low
    assert all(r["kept"] == (low[i] == i) for i, r in got.items())
    assert graph_dedup.near_duplicate_vectors(frame(spark, vectors).where("false")).count() == 0


def spanning_group(spark):
    """One group of distinct near copies (pairwise cosine about 0.96) over many shards, among other vectors."""
    rng = np.random.default_rng(21)
    x = np.concatenate([rng.normal(size=64) + rng.normal(size=(900, 64)) * 0.2, rng.normal(size=(300, 64))])
    return x, spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")


def links_by_force(x):
    u = graph_dedup.unit(x)
    return dict(enumerate(((u @ u.T >= 0.93).sum(1) - 1).tolist()))


def counts_of(df):
    return {r["vec_id"]: r["n_links"] for r in graph_dedup.near_duplicate_vectors(df).collect()}


def test_graph_dedup_group_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(graph_dedup, "SHARD", 200)
    x, df = spanning_group(spark)
    assert counts_of(df) == links_by_force(x)


def test_graph_dedup_over_many_shards(spark, monkeypatch):
    """Small groups of near copies over many overlapping shards, whose lists are united."""
    monkeypatch.setattr(graph_dedup, "SHARD", 100)
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(300, 24)), 4, 0) + rng.normal(size=(1200, 24)) * 0.15
    df = spark.createDataFrame([(i, v.tolist(), 5) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    nodes = df.select(F.lit("5").alias("label"), F.col("vec_id").alias("id"), F.lit(1).cast("long").alias("copies"), F.col("embedding").alias("v"))
    small, _ = graph_dedup.shards(nodes, 0.93)
    sizes = [r["count"] for r in small.groupBy("path").count().collect()]
    assert len(sizes) > 12 and max(sizes) <= 100 and sum(sizes) > 1500
    assert small.where("home").count() == small.where("home").select("id").distinct().count()
    assert counts_of(df) == links_by_force(x)


def test_graph_dedup_guests_follow_links(spark, monkeypatch):
    """Vectors at random with a few near copies, cut twice: rows of shards follow nodes and links, not the cuts, and no link is lost."""
    monkeypatch.setattr(graph_dedup, "SHARD", 150)
    rng = np.random.default_rng(31)
    x = rng.normal(size=(6000, 32))
    x[3000:3300] = x[:300] + rng.normal(size=(300, 32)) * 0.1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    nodes = df.select(F.lit("1").alias("label"), F.col("vec_id").alias("id"), F.lit(1).cast("long").alias("copies"), F.col("embedding").alias("v"))
    small, dense = graph_dedup.shards(nodes, 0.93)
    assert dense is None and small.where("home").count() == 6000 and small.count() < 12000
    assert counts_of(df) == links_by_force(x.astype(np.float32).astype(float))


def test_sketches_let_links_pass():
    rng = np.random.default_rng(3)
    x = graph_dedup.unit(rng.normal(size=(2000, 48)))
    y = graph_dedup.unit(x + rng.normal(size=x.shape) * 0.35 / np.sqrt(48))
    near = (x * y).sum(1) >= 0.93
    signs = [graph_dedup.sketch(a).view(np.uint64).reshape(len(a), -1) for a in (x, y)]
    assert near.sum() > 1500 and all(graph_dedup.met(b[None], a[None], 0.93)[0] for a, b in zip(signs[0][near], signs[1][near], strict=True))
    assert graph_dedup.met(signs[0][:1000], signs[0][1000:], 0.93).mean() < 0.25  # of 1000 others at random, the nearest may pass


def test_graph_dedup_cluster_of_near_copies(spark, monkeypatch):
    """2000 near copies, all linked: rows that leave the shards follow the nodes, not the pairs."""
    monkeypatch.setattr(graph_dedup, "SHARD", 500)
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=16) + rng.normal(size=(2000, 16)) * 0.01, rng.normal(size=(50, 16))])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in graph_dedup.near_duplicate_vectors(df).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == links_by_force(x)
    assert all(got[i]["component_id"] == 0 for i in range(2000)) and sum(r["kept"] for r in got.values()) <= 51
    u = graph_dedup.unit(x[:300])
    nodes = spark.createDataFrame([("1", 0, True, i, 1, v.tolist()) for i, v in enumerate(u)], "label string, path long, home boolean, id long, copies long, v array<double>")
    for counts in (graph_dedup.graph_counts(nodes, 0.93), graph_dedup.tile_counts(nodes, 0.93)):
        assert counts.count() == 300 and {r["others"] for r in counts.collect()} == {299}


def test_graph_dedup_mends_what_the_audit_misses(spark, monkeypatch):
    """Without any overlap links between shards are lost; the audit sees it and exact tiles give them back."""
    monkeypatch.setattr(graph_dedup, "SHARD", 200)
    monkeypatch.setattr(graph_dedup, "guests", lambda near, c, least: near == near.max(1, keepdims=True))
    tiled, plain = [], graph_dedup.tile_counts
    monkeypatch.setattr(graph_dedup, "tile_counts", lambda *args: tiled.append(1) or plain(*args))
    x, df = spanning_group(spark)
    assert counts_of(df) == links_by_force(x) and tiled


def test_graph_dedup_ends_exact_whatever_the_audit_sees(spark, monkeypatch):
    """Many labels cut without overlap: a sample can't see all that is lost, and all of it is found in the end."""
    monkeypatch.setattr(graph_dedup, "SHARD", 12)
    monkeypatch.setattr(graph_dedup, "guests", lambda near, c, least: near == near.max(1, keepdims=True))
    monkeypatch.setattr(graph_dedup, "AUDITED", 20)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=16) + rng.normal(size=(30, 16)) * 0.2 for _ in range(250)])
    labels = np.repeat(np.arange(250), 30)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<double>, label int")
    u = graph_dedup.unit(x)
    near = (u @ u.T >= 0.93) & (labels[:, None] == labels[None, :])
    assert counts_of(df) == dict(enumerate((near.sum(1) - 1).tolist()))


def test_graph_dedup_with_a_failed_audit_of_small_labels(spark, vectors, monkeypatch):
    want = {r["vec_id"]: r["n_links"] for r in graph_dedup.near_duplicate_vectors(frame(spark, vectors)).collect()}
    monkeypatch.setattr(graph_dedup, "audit", lambda *args: {"0/8": (10, 9)})
    assert {r["vec_id"]: r["n_links"] for r in graph_dedup.near_duplicate_vectors(frame(spark, vectors)).collect()} == want


def test_graph_dedup_of_text_labels_and_lengths(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0, 0.0], "a"), (5, [1.0, 0.0], "a"), (5, [0.0, 1.0], "a"), (None, [1.0, 0.0], "a"), (6, [1.0, 0.0, 0.0], "a")]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in graph_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect())
    assert got == [(0, 0, 0), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 1, 4), (5, 0, 5), (5, 2, 1), (6, 1, 4)]


def test_tile_counts(spark, monkeypatch):
    monkeypatch.setattr(graph_dedup, "TILE", 100)
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(120, 8)), 5, 0) + rng.normal(size=(600, 8)) * 0.2
    nodes = spark.createDataFrame([("1", 0, True, i, 1, v.tolist()) for i, v in enumerate(x)], "label string, path long, home boolean, id long, copies long, v array<double>")
    got = {}
    for r in graph_dedup.tile_counts(nodes, 0.93).collect():
        got[r["id"]] = got.get(r["id"], 0) + r["others"]
    assert got == links_by_force(x)


def test_graph_search_finds_every_link():
    rng = np.random.default_rng(9)
    for noise in (0.02, 0.12, 0.25):
        u = graph_dedup.unit(np.concatenate([np.repeat(rng.normal(size=(100, 16)), 6, 0), np.repeat(rng.normal(size=(1, 16)), 200, 0)]) + rng.normal(size=(800, 16)) * noise)
        s = u @ u.T
        near = graph_dedup.pruned(s, 0.93)
        assert sum(map(len, near)) < 0.25 * len(u) ** 2
        for q, found in enumerate(graph_dedup.in_range(s, near, np.arange(len(u)), 0.93)):
            assert found.tolist() == [i for i in np.flatnonzero(s[q] >= 0.93) if i != q]


def test_nearest(spark, vectors):
    df = frame(spark, vectors)
    got = {}
    for r in nearest.search(df, df.where("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows = [(i, np.array(v)) for i, v, _ in vectors if good(v)]
    for i, q in rows:
        if i % 20 == 0:
            want = sorted(((-float(np.dot(q, x)), j) for j, x in rows if j != i))[:20]
            mine = sorted(got.pop(i))
            assert [m[0] for m in mine] == list(range(1, 21))
            assert np.allclose([m[2] for m in mine], [-s for s, _ in want], atol=1e-12)
            assert {m[1] for m in mine} == {j for _, j in want} or np.isclose(want[-1][0], sorted(-float(np.dot(q, x)) for j, x in rows if j != i)[20])
    assert not got
    few = df.where("vec_id < 5")
    assert nearest.search(few, few, k=20).count() == 20 and nearest.search(df.where("false"), df.where("false")).count() == 0


def test_tiles_are_exact():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 12))
    x[500:700] = x[3]  # ties
    ids = np.arange(3000)
    found = nearest.tile(ids[:40], x[:40], ids, x, 20)
    for i, f in enumerate(found):
        s = np.einsum("ij,j->i", x, x[i])
        want = [j for _, j in sorted((-round(v, 12), j) for j, v in enumerate(s) if j != i)][:20]
        assert [j for _, j in f] == want


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(400, 440)] + [(500, 500 + i) for i in range(60)] + [(7, 7)]
    got = {r["vertex"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    up = {x: x for e in edges for x in e if e[0] != e[1]}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    assert got == {x: top(x) for x in up}


def test_urls(spark):
    link = "<link rel='canonical' href=\"{}\">"
    rows = [
        (1, "https://WWW.Example.com/en/a?x#y", ""), (2, "http://a.example.com/en/a", ""), (3, "http://a.example.com/fr/", None), (4, None, None), (5, "example.com/en/", ""),
        (6, "http://b.net/es/x", ""), (7, "http://b.org/one", link.format("http://b.net/es/x")), (8, "http://c.org/two", '<meta http-equiv="refresh" content="0; url=/three">'), (9, "http://c.org/three", link.format("http://b.org/one")),
        (10, "http://d.org/", link.format("https://d.net/fr/")), (11, "http://d.org/x", link.format("/")), (12, "http://e.org/", link.format("http://ok.com/")), (13, "http://e.org/", link.format("http://b.net/fr/1")), (14, "http://com/", ""), (15, "http://notexample.com/en/", ""), (16, "http://x.com", ""),
    ]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, key string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df).collect()}
    assert got[1] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[2] == ("a.example.com", "/en/a", "example.com/en/", "block")
    assert got[3][2:] == ("com/", "allow") and got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow")
    assert got[6][2:] == ("net/es/", "block")
    assert [got[i][2:] for i in (7, 8, 9)] == [(None, "block")] * 3  # through the canonical link, the redirect and both
    assert got[10][3] == got[11][3] == "block"  # by an alias that is no page
    assert got[12][3] == got[13][3] == "allow"  # an allowed alias goes first
    assert got[14][2] == "com/" and got[15][2] == "com/" and got[16][2:] == (None, "allow")
    extra = spark.createDataFrame([("http://x.com", "http://b.net/es/x")], "source string, target string")
    more = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, redirects=extra).collect()}
    assert more[16] == "block"
    assert url_filter.judge(df.where("false")).count() == 0


def corpus(spark, folder, odd=()):
    """documents and labels of a folder; ``odd``: more rows of documents."""
    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("ba", "lo", "ti", "mu", "se") for b in ("ra", "no", "ke", "du", "pi", "sa")]
    docs, labels = [], []
    for i in range(200):
        w = [rng.choice(words) for _ in range(40)]
        bad, toxic = i % 4 == 1, i % 5 == 2
        if bad:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            for _ in range(6):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moronic", "scum"]))
        docs.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(300, docs[0][1], "en", "s", 1), (301, docs[3][1].upper().lower(), "en", "s", 1)]
    docs += [(302 + k, " ".join(["edit"] * (k % 2) + docs[8][1].split()[k % 3 :]), "en", "s", 1) for k in range(6)]
    docs += odd
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, labels


def dedup_by_force(rows, width=5):
    """The smallest id of each group of rows (id, text), by all pairs."""
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(i, []).append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[i] for y in sets[j]):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i for i in sets if top(i) == i}


def test_pipeline_by_force(spark, tmp_path):
    """Every stage on its predecessor's rows; the last one's pieces are the library's ids of what stays."""
    import zlib

    import corpus_pipeline
    from tessera.llm import quality, toxicity
    from tessera.llm.common import tokenizer_path
    from tessera.llm.word_bpe import encoder

    long = "mura seno " * 4000 + "tail"
    odd = [(400, None, "en", "s", 1), (401, "", "en", "s", 1), (402, long, "en", "s", 1), (403, long, None, None, None), (404, "bara lono", "en", "s", 1), (404, "bara lono", "en", "s", 1), (None, "seno dura", "en", "s", 1), (None, "seno dura", "en", "s", 1)]
    docs, labels = corpus(spark, tmp_path, odd)
    table, label = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet").where(~quality.held_out("doc_id"))
    good = quality.fit(table, label, "doc_id", "text", "quality")
    bad = toxicity.fit(table, label, "doc_id", "text", "toxic")
    scored = quality.score(table, good, "doc_id", "text").collect()
    graded = toxicity.severity(table, bad, "doc_id", "text").collect()
    texts = {(d[0], d[1]) for d in docs}
    by_id = {r["doc_id"]: r["score"] for r in scored}
    toxic = {r["doc_id"]: r["toxic"] for r in graded}
    passed = [(i, t) for i, t in texts if by_id[i] >= 0.5 and not toxic[i]]
    want = dedup_by_force([(i, t) for i, t in passed if i is not None])
    docs_now = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_now = stage(spark, docs_now, str(tmp_path))
        assert docs_now.columns == table.columns, name
    left = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in docs_now.collect())
    nulls = 2 if by_id[None] >= 0.5 and not toxic[None] else 0
    assert [i for n, i, _ in left if not n] == sorted(want) and sum(n for n, *_ in left) == nulls
    library = encoder(tokenizer_path("word_bpe_49k.json")).library
    pieces = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        if r["doc_id"] is not None:
            pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == want
    text = dict(passed)
    for i, rs in pieces.items():
        ids, at = np.array([*library.encode(text[i] or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(rs, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_pipeline_without_rows(spark, tmp_path):
    import corpus_pipeline

    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_row_of_each_id_stays(spark, monkeypatch):
    from tessera.llm import common

    rows = [(1, "a", 0), (1, "a", 0), (1, "b", 0), (2, "c", 1), (None, "d", 1), (None, "d", 1), (3, "e", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    marked = spark.createDataFrame([(1, True)] * 3 + [(2, False), (None, True), (None, True), (3, True)], "doc_id long, kept boolean")
    for size in (4_000_000, -1):
        monkeypatch.setattr(common, "BROADCAST_BYTES", size)
        got = common.without_copies(df, marked, "doc_id")
        assert got.columns == df.columns
        assert sorted((r["doc_id"] or 0) for r in got.collect()) == [0, 0, 1, 3]


def test_the_shared_folder(spark, tmp_path):
    """Intermediate tables go with the operator, its result stays; a cluster must name the folder."""
    import os

    from tessera.llm import common

    here = spark.sparkContext._jsc.sc().getCheckpointDir().get() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else common.checkpoint_dir(spark)
    before = set(os.listdir(here.removeprefix("file:")))
    near = graph_dedup.near_duplicate_vectors(spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1)], "vec_id long, embedding array<double>, label int"))
    new = set(os.listdir(here.removeprefix("file:"))) - before
    assert len([x for x in new if not x.startswith(".")]) == 1 and near.count() == 2


def test_entry_without_the_subpackage(tmp_path):
    """With the folders deleted, or only a cache of byte code left, the entry imports and has the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[2]
    shutil.copytree(top / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    (tmp_path / "tessera" / "llm" / "__pycache__").mkdir(parents=True)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    _, labels = corpus(spark, tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "packing"]
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    clean = {i for i, q, t in labels if q and not t}
    assert out <= clean and len(out) >= 0.9 * len(clean) and not out & set(range(300, 308))
