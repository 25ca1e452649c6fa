"""Operators on texts against brute force, with the defined edge cases."""

from __future__ import annotations

import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, license_scan, near_dedup, packing, pieces, quality, token_counts, toxicity
from tessera.llm.common import tokenizer_path
from tessera.llm.word_bpe import encoder

SCHEMA = "doc_id long, text string, n_tokens string, score string, ids string, id string, h string"
ODD = "aàÉßxY1'st 'll\t\n\x0b\x0c\x1c\x85\xa0 ́éİΣςКя漢字😀!?.,-×÷ÿŸ'd're _~"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = [f"w{rng.randrange(400)}" for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(20, 80))) for _ in range(12)]
    out = [None, "", "   \n", "one", "one two", "one two", *base, base[0], base[0].upper()]
    for b in base[:6]:
        for _ in range(3):
            w = b.split()
            w[rng.randrange(len(w))] = "edited"
            out.append(" ".join(w))
    common = " ".join(rng.choice(words) for _ in range(60))
    out += [common + " " + " ".join(rng.choice(words) for _ in range(12 + i % 5)) for i in range(10)]
    out += ["".join(rng.choice(ODD) for _ in range(rng.randrange(60))) for _ in range(20)]
    out.append(" ".join(rng.choice(words) + rng.choice(["", ".", ",", "!!"]) for _ in range(9000)))
    out.append("x" * 3000)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def library():
    return encoder(tokenizer_path("word_bpe_49k.json")).library


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(spark, docs, texts, library):
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 2048)
    assert token_counts.count_tokens(empty(spark)).count() == 0


def test_token_counts_of_huge_texts(spark, texts, library):
    """Many texts over the threshold, by the parameters; null, repeated and clashing ids; counts equal the library's whatever the threshold."""
    rng = random.Random(9)
    many = [" ".join(rng.choice(texts[6:18]) for _ in range(rng.randrange(5, 60))) + "".join(rng.choice(ODD) for _ in range(200)) for _ in range(40)]
    rows = [(i, t, "x") for i, t in enumerate(many)] + [(None, many[0], "x"), (3, many[3], "x"), (3, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string")
    want = sorted((r[0] or -1, len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    for settings in ({}, {"huge": 500, "chunk": 128, "overlap": 16}, {"huge": 10**9}):
        assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in token_counts.count_tokens(df, **settings).collect()) == want


def test_splicing_equals_the_whole(library, texts):
    rng = random.Random(8)
    for text in (texts[-2], "x" * 5000 + " y" * 40, " " * 3000 + "a b", "".join(rng.choice(ODD) for _ in range(4000)), "<|endoftext|> don't " * 200):
        for chunk, overlap in ((64, 8), (300, 20), (1000, 1)):
            got = np.concatenate(list(token_counts.spliced_ids(library, text, chunk, overlap)))
            assert got.tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing(spark, docs, texts, library):
    rows = packing.pack(docs, capacity=256).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for i, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[i])
            assert np.frombuffer(p["ids"], "<u4").tolist() == ids[i][at : at + p["length"]]
            at += p["length"]
        assert at == len(ids[i])
    padding = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding <= 0.02 * sum(map(len, ids.values()))
    assert packing.pack(empty(spark)).count() == 0


def test_pieces(spark, docs, texts):
    m = pieces.model(tokenizer_path("piece_bpe_32k.model"))
    assert m.kind == "bpe"
    rows = pieces.decode(pieces.encode(docs, keep_text=True)).collect()
    for r in rows:
        assert list(r["ids"]) == m.library.encode(texts[r["doc_id"]] or "")
        assert r["decoded"] == (texts[r["doc_id"]] or "")
    assert len(rows) == len(texts) and pieces.encode(empty(spark)).count() == 0


def test_unigram_path_is_the_best(texts):
    m = pieces.Pieces(tokenizer_path("piece_bpe_32k.model"), kind="unigram")
    worst = m.score.min() - 10
    for unit in ("▁the", "▁hello", "▁naïve漢", "▁▁▁x"):
        best = [0.0] + [-np.inf] * len(unit)
        for j in range(1, len(unit) + 1):
            for i in range(j):
                k = m.id.get(unit[i:j])
                value = m.score[k] if k is not None else worst if j - i == 1 else -np.inf
                best[j] = max(best[j], best[i] + value)
        path = m._viterbi(np.frombuffer(unit.encode("utf-32-le"), np.uint32)[None])[0]
        for ids in (path[path >= 0], m._single(unit)):
            assert np.isclose(sum(m.score[i] if i < m.size else worst for i in ids), best[-1])


def test_long_units(library):
    """Texts without spaces: cut where no piece crosses, and where pieces cross everywhere; within bounded time."""
    m = pieces.model(tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(2)
    texts = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(30_000)), "x" * 5000, "ab" * 2000, "".join(rng.choice("abcdefgh0123+/") for _ in range(5000)), "漢" * 60 + "word" * 40 + "😀" * 50, "日本語のテキスト" * 300]
    for t in texts:
        assert "".join(m.parts(t)) == t
        assert np.frombuffer(m.encode([t])[0], "<i4").tolist() == m.library.encode(t)
    began = time.process_time()
    m.units(["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(100_000)), "ab" * 25_000])
    assert time.process_time() - began < 5


def test_models_that_are_refused():
    piece = lambda text, kind: b"\x0a" + bytes([len(text) + 4]) + b"\x0a" + bytes([len(text)]) + text + b"\x18" + bytes([kind])
    plain = b"\x1a\x02\x20\x00"  # a normaliser that keeps white space
    assert pieces.checked_kind(piece(b"a", 1) + plain) == "unigram"
    assert pieces.checked_kind(piece(b"a", 1) + b"\x12\x02\x18\x02" + plain) == "bpe"
    for bad in (piece(b"a", 4) + plain, piece(b"a", 1), b"\x1a\x04\x20\x00\x18\x00", b"\x1a\x05\x12\x01x\x20\x00", b"\x12\x02\x18\x03" + plain):
        with pytest.raises(ValueError):
            pieces.checked_kind(bad)


def components_by_force(sets, percent):
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: top(i) for i in sets}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, texts, width):
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    want = components_by_force(sets, 80)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs, width=width).collect()}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def families(seed):
    """Texts that drift apart: copies of copies with edits, so links chain and buckets hold several components."""
    rng = random.Random(seed)
    out = []
    for f in range(3):
        w = [f"f{f}w{rng.randrange(60)}" for _ in range(50)]
        for _ in range(45):
            v = list(w)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                v[rng.randrange(len(v))] = f"e{rng.randrange(30)}"
            out.append(" ".join(v))
            if rng.random() < 0.5:
                w = v
    return out


@pytest.mark.parametrize("settings", [{}, {"BROADCAST_BYTES": -1, "HOT": 2, "BLOCK": 4}, {"HOT": 2, "HOT_KEYS": 0, "GROUP": 3, "BLOCK_SHINGLES": 150, "SHARED": 5}])
def test_near_duplicates_that_drift(spark, monkeypatch, settings):
    """Small bounds, so hot buckets, tiles of several blocks and the shuffle of texts are all in use."""
    for k, v in settings.items():
        monkeypatch.setattr(common if k == "BROADCAST_BYTES" else near_dedup, k, v)
    rows = families(3)
    sets = {i: (lambda w: {tuple(w[k : k + 4]) for k in range(len(w) - 3)})(t.split()) for i, t in enumerate(rows)}
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, width=4).collect()}
    want = components_by_force(sets, 80)
    assert got == want and len(set(want.values())) > 6


def test_tiles_leave_out_only_pairs_of_a_component(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    rows = [(i, 10, "big" if i < 23 else f"c{i // 2}", 1) for i in range(40)]
    more = [(i, 10, f"c{i}", 100 + i // 2) for i in range(40, 60)]  # small buckets share tiles
    got = near_dedup.tiles(spark.createDataFrame(rows + more, "id long, n long, c string, h long")).collect()
    assert all(r["side"] == 2 for r in got if r["h"] > 1) and sum(r["h"] > 1 for r in got) == 20
    by_tile = {}
    for r in got:
        by_tile.setdefault(r["tile"], []).append(r)
    pairs = set()
    for rs in by_tile.values():
        for x in rs:
            for y in rs:
                if x["h"] == y["h"] == 1 and x["side"] != 1 and y["side"] != 0 and x["id"] != y["id"]:
                    pairs.add(frozenset((x["id"], y["id"])))
    component = {i: c for i, _, c, _ in rows}
    want = {frozenset((i, j)) for i in range(40) for j in range(i) if component[i] != component[j]}
    assert want <= pairs and not any(component[i] == component[j] == "big" for i, j in map(tuple, pairs))


def test_near_duplicates_of_odd_ids(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(None, text), (None, text), (5, text), (5, text), (7, text + " eleven"), (7, "quite another text of nothing much in common at all"), (9, "quite another text of nothing much in common at all"), (11, None)]
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"])
    assert got == [(5, 5, True), (5, 5, True), (7, 5, False), (7, 5, False), (9, 5, False), (11, 11, True)]
    named = near_dedup.near_duplicates(spark.createDataFrame([(f"n{i}", t) for i, t in rows], "doc_id string, text string"))
    assert named.where("kept").count() == 2 + 1


def test_near_duplicates_of_ids_with_several_texts(spark, monkeypatch):
    """Rows with one id are one document: an empty text beside another one is no fault, and what an id's texts link is one component."""
    w = [f"w{i}" for i in range(40)]
    near = lambda k: " ".join([*w[:-1], f"x{k}"])
    other, third = " ".join(f"o{i}" for i in range(20)), " ".join(f"t{i}" for i in range(20))
    rows = [(4, near(0)), (5, near(1)), (5, ""), (6, near(2)), (6, None), (6, near(2)), (11, other), (12, third), (13, other), (13, third), (20, "alone"), (20, " "), (30, ""), (30, None)]
    want = {4: 4, 5: 4, 6: 4, 11: 11, 12: 11, 13: 11, 20: 20, 30: 30}
    for settings in ({}, {"HOT": 1, "BLOCK": 2}):
        for k, v in settings.items():
            monkeypatch.setattr(near_dedup, k, v)
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
        assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows)
        assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(i, c, i == c) for i, c in want.items()}


def test_repeated_rows_do_not_multiply_in_tiles(spark, monkeypatch):
    """Of rows that are repeated with their id, one set goes on: work does not grow with the square of the repeats."""
    looked_up = []
    full = near_dedup.full_sets
    monkeypatch.setattr(near_dedup, "full_sets", lambda df, *a: looked_up.append(df.count()) or full(df, *a))
    rows = [(i, t) for i, t in enumerate(families(3)[:40])] * 12
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4)
    assert got.count() == len(rows) and 0 < max(looked_up) <= 40


def test_signatures_agree_as_sets_do():
    """Pairs at the threshold pass, those that share boilerplate do not, and sizes decide alone where they can."""
    rng = np.random.default_rng(2)

    def pair(n, share):
        x = rng.integers(-(1 << 62), 1 << 62, 2 * n)
        both = round(share * 2 * n / (1 + share))
        return np.unique(x[:n]), np.unique(np.concatenate([x[n - both : n], x[n : 2 * n - both]]))

    for share, passes in ((0.8, True), (0.9, True), (0.5, False)):
        for n in (20, 200, 2000):
            pairs = [pair(n, share) for _ in range(12)]
            signed = np.array([near_dedup.signature(x) for p in pairs for x in p]).astype(np.uint8)
            sizes, labels = np.full(24, n), np.arange(24)
            got = sum(len(near_dedup.partners(2 * k, signed, sizes, labels, np.array([2 * k + 1]), 80)) for k in range(12))
            assert got == (12 if passes else 0)
    assert not len(near_dedup.partners(0, signed, np.array([100, 79] * 12), labels, np.array([1]), 80))
    assert not len(near_dedup.partners(0, np.repeat(signed[:1], 2, 0), np.array([5, 5]), np.array([1, 1]), np.array([1]), 80))


def test_tiles_join_components_once():
    rng = np.random.default_rng(2)
    base = rng.integers(-(1 << 62), 1 << 62, 100)
    sets = [np.unique(np.where(rng.random(100) < 0.06, rng.integers(-(1 << 62), 1 << 62, 100), base)) for _ in range(40)] + [np.unique(rng.integers(-(1 << 62), 1 << 62, 100)) for _ in range(5)]
    signed, sizes, labels = np.array([near_dedup.signature(x) for x in sets]).astype(np.uint8), np.array([len(x) for x in sets]), np.arange(45)
    every = np.arange(45)
    got = list(near_dedup.links_in_tile(sets, signed, sizes, labels, every, every, 80))
    assert all(near_dedup.same_enough(sets[i], sets[j], 80) for i, j in got)
    want = components_by_force({i: set(x.tolist()) for i, x in enumerate(sets)}, 80)
    assert len(got) == 45 - len(set(want.values())) and len(set(want.values())) >= 6


def test_boilerplate_is_not_compared_on_full_sets(spark, monkeypatch):
    """Texts that share two thirds of their words link nowhere, and none of them is looked up in full, however many they are."""
    looked_up = []
    full = near_dedup.full_sets
    monkeypatch.setattr(near_dedup, "full_sets", lambda df, *a: looked_up.append(df.count()) or full(df, *a))
    rng = random.Random(9)
    common_words = " ".join(f"b{i}" for i in range(60))
    rows = [(i, common_words + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(30))) for i in range(1500)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("kept").count() == 1500 and sum(looked_up) == 0


def test_near_duplicates_without_rows(spark):
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def labelled(spark, n=240):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ba", "lo", "ti", "mu", "se") for b in ("ra", "no", "ke", "du", "pi", "sa")]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(30, 60))]
        bad, toxic = i % 4 == 1, i % 5 == 2
        if bad:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            for _ in range(rng.randrange(2, 9)):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moronic", "scum"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(n, None), (n + 1, ""), (n + 2, rows[0][1])]
    labels += [(n + 3, None, None), labels[0]]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels[:n]}


def test_quality_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark)
    model = quality.fit(docs, labels.where(~quality.held_out("doc_id")), "doc_id", "text", "quality")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model, "doc_id", "text").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and np.mean([(got[i] >= 0.5) == truth[i][0] for i in held]) > 0.95
    assert len(got) == 243 and 0 <= got[240] <= 1 and got[240] == got[241]
    kept = quality.keep(docs, model, "text")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s >= 0.5}
    none = quality.fit(docs, labels.where("false"), "doc_id", "text", "quality")
    assert abs(quality.score(docs, none, "doc_id", "text").first()["score"] - 0.5) < 0.2


def test_quality_of_texts_without_spaces(spark):
    docs, labels, truth = labelled(spark)
    runs = docs.where("length(text) > 0").select("doc_id", F.concat(F.lit("x" * 20), F.replace("text", F.lit(" "), F.lit("")), F.lit("y" * 20)).alias("text"))
    model = quality.fit(runs, labels.where(~quality.held_out("doc_id")), "doc_id", "text", "quality")
    got = {r["doc_id"]: r["score"] for r in quality.score(runs, model, "doc_id", "text").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and np.mean([(got[i] >= 0.5) == truth[i][0] for i in held]) > 0.95


def test_long_runs_have_bounded_weight():
    s = quality.Settings()
    usual = len(quality.word_features(b"a" * 40, s)[0])
    for run in ("漢字" * 100_000, "ab" * 21):
        at, weights = quality.word_features(run.encode(), s)
        assert len(at) == len(weights) and np.isclose(weights.sum(), usual)
    middle = [quality.word_features(("a" * 30 + x + "b" * 30).encode(), s)[0].tolist() for x in ("good", "evil")]
    assert middle[0] != middle[1]


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark)
    model = toxicity.fit(docs, labels.where(~quality.held_out("doc_id")), "doc_id", "text", "toxic")
    got = {r["doc_id"]: r for r in toxicity.severity(docs, model, "doc_id", "text").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["toxic"] == bool(truth[i][1]) for i in held]) > 0.95
    assert all(0 <= r["severity"] <= toxicity.GRADES for r in got.values()) and not got[240]["toxic"]
    assert {r["doc_id"] for r in toxicity.keep(docs, model, "text").collect()} == {i for i, r in got.items() if not r["toxic"]}
    none = toxicity.fit(docs, labels.where("toxic = 0"), "doc_id", "text", "toxic")
    assert not any(r["toxic"] for r in toxicity.severity(docs, none, "doc_id", "text").collect())


def test_licenses(spark):
    rows = ["This work is licensed under the GNU General Public License, version 3.", "mit license MIT-License mit", None, "", "Apache license apache license", "licensed under CC BY-NC 4.0.", "MİT license", "gnu general public", "xmit license"]
    df = spark.createDataFrame([(i, t, "x", "x") for i, t in enumerate([*rows, rows[0]])], "doc_id long, text string, s string, w string")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["base_labels"]) == (1, 6, 6, "gpl")
    assert "gpl-3.0" in got[0]["labels"].split(",") and got[0]["score"] == 1.0 and got[9]["labels"] == got[0]["labels"]
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["n_words"]) == (2, 0, 2, 5)
    assert (got[4]["n_base"], got[4]["last_word"]) == (2, 2)
    assert got[5]["base_labels"] == "cc-by" and "cc-by-nc-4.0" in got[5]["labels"]
    for i in (2, 3, 6, 7, 8):
        assert got[i]["n_base"] == 0 and got[i]["first_word"] is None and got[i]["base_labels"] == ""
    assert license_scan.scan(df.where("false")).count() == 0


def test_quality_scores_by_force(spark):
    """The folded, vectorised score against a plain sum over features, one word at a time."""
    import xxhash

    docs, labels, _ = labelled(spark)
    s = quality.Settings()
    model = quality.fit(docs, labels, "doc_id", "text", "quality", s)
    texts = ["one two two\tTWO!! x" * 3, "", None, "漢字 " * 50, "word", "a" * 70 + " b b", "\n leading  and trailing "]

    def force(t):
        words = [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
        total, n = 0.0, 0.0
        for w in words:
            chars = f"<{w}>"
            grams = [chars, *(chars[i : i + k] for k in s.grams for i in range(len(chars) - k + 1))]
            weight = 1.0 if len(chars) <= quality.LONG + 2 else (1 + sum(quality.LONG + 3 - k for k in s.grams)) / len(grams)
            for g in grams:
                total += weight * model.weight[xxhash.xxh3_64_intdigest(g) & (s.buckets - 1)]
                n += weight
        for a, b in itertools.pairwise(words):
            pair = np.array([quality.word_numbers(a.encode()), quality.word_numbers(b.encode())], np.uint64)
            for k in quality.bigrams(pair, np.array([0, 0]) if a == b else np.array([0, 1]), s.buckets):
                total += model.weight[k[0]]
                n += 1
        return 1 / (1 + math.exp(-(total / max(n, 1) + model.bias)))

    got = quality.scorer(model)(pa.array(texts, pa.string()).fill_null(""))
    assert np.allclose(got, [force(t) for t in texts], atol=1e-9)


def test_quality_training_separates():
    """Training separates two documents, and the folded weights give their probabilities."""
    s = quality.Settings(buckets=16, dim=3, epochs=40)
    rows = [(np.array([1, 2], np.int32), np.array([1.0, 3.0]), 1), (np.array([3, 4], np.int32), np.array([2.0, 1.0]), 0), (np.zeros(0, np.int32), np.zeros(0), 1)]
    m = quality.train(rows, s)
    p = [1 / (1 + math.exp(-((m.weight[a] @ n / n.sum() if len(a) else 0.0) + m.bias))) for a, n, _ in rows]
    assert p[0] > 0.8 and p[1] < 0.2


def test_whole_words_are_features():
    s = quality.Settings()
    long = ["a" * 100 + x + "b" * 100 for x in ("good", "evil")]
    assert len({tuple(quality.word_features(w.encode(), s)[0].tolist()) for w in long}) == 2
    assert len({tuple(toxicity.word_features(w.encode())) for w in long}) == 2
    assert len({quality.word_numbers(w.encode()) for w in long}) == 2


def test_cumulative_link_likelihood():
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 6, rng.integers(0, 5))) for _ in range(30)]
    owner, flat = np.repeat(np.arange(30), [len(r) for r in rows]), np.concatenate(rows)
    y, w, theta = rng.integers(0, 4, 30), rng.normal(size=6), np.array([-0.5, 0.7, 1.9])
    loss, by_w, by_theta = toxicity.likelihood(owner, flat, y, w, theta, 0.1)
    force = 0.0
    for r, k in zip(rows, y, strict=True):
        below = [0.0, *(1 / (1 + math.exp(-(t - w[r].sum()))) for t in theta), 1.0]
        force -= math.log(below[k + 1] - below[k]) / 30
    assert np.isclose(loss, force + 0.05 * (w @ w))
    for grad, x, which in ((by_w, w, 0), (by_theta, theta, 1)):
        for i in range(len(x)):
            up, down = x.copy(), x.copy()
            up[i], down[i] = up[i] + 1e-5, down[i] - 1e-5
            args = [(up, theta), (down, theta)] if which == 0 else [(w, up), (w, down)]
            slope = (toxicity.likelihood(owner, flat, y, *args[0], 0.1)[0] - toxicity.likelihood(owner, flat, y, *args[1], 0.1)[0]) / 2e-5
            assert np.isclose(grad[i], slope, atol=1e-6)
    rows = [np.array([0, 1])] * 10 + [np.array([2])] * 10 + [np.array([2, 3])] * 10
    y = np.array([2] * 10 + [0] * 10 + [1] * 10)
    w, theta = toxicity.descend(rows, y, 4, 2, toxicity.Settings())
    z = [w[r].sum() for r in rows]
    assert (np.diff(theta) >= 0).all() and z[0] > theta[1] > z[20] > theta[0] > z[10]


def test_severity_is_the_sum_of_probabilities(spark):
    m = toxicity.Model(np.array(sorted(toxicity.word_features(b"bad")), np.uint64), np.ones(1), np.array([0.0, 1.0, 3.0]), 0.6)
    sig = lambda x: 1 / (1 + math.exp(-x))
    rows = [(0, "a bad thing, bad", "x", "x", "x"), (1, "nothing", "x", "x", "x"), (2, None, "x", "x", "x"), (3, "bad " * 200_000, "x", "x", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade string, severity string, label string")
    got = {r["doc_id"]: r for r in toxicity.severity(df, m, "doc_id", "text").collect()}
    for i, z in ((0, 1), (1, 0), (2, 0), (3, 1)):
        assert np.isclose(got[i]["severity"], sum(sig(z - t) for t in m.thresholds))
        assert got[i]["toxic"] == (z == 1) and (got[i]["grade"] > 0) == (z == 1)


def test_classifiers_on_odd_tables(spark):
    """Empty tables, columns of clashing names, a very long text, and null ids."""
    docs, labels, _ = labelled(spark)
    long = spark.createDataFrame([(None, "Zap!! " * 300_000), (900, "x" * 1_000_000)], "doc_id long, text string").withColumn("score", F.lit("x"))
    odd = docs.unionByName(long).select("*", *[F.lit("x").alias(c) for c in ("id", "label", "toxic", "grade", "severity", "quality", "features", "at", "often")])
    for op, fit, apply in ((quality, "quality", lambda m, d: quality.score(d, m, "doc_id", "text")), (toxicity, "toxic", lambda m, d: toxicity.severity(d, m, "doc_id", "text"))):
        model = op.fit(odd, labels, "doc_id", "text", fit)
        assert apply(model, odd).count() == odd.count() and apply(model, odd.where("false")).count() == 0
        assert op.keep(odd, model, "text").columns == odd.columns
        nothing = op.fit(odd.where("false"), labels.where("false"), "doc_id", "text", fit)
        assert apply(nothing, docs).count() == docs.count()


def notices_by_force(texts):
    """(labels, score) of each text: every template tried at every place."""
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    often = {}
    for w in words:
        for x in set(w):
            often[x] = often.get(x, 0) + 1
    idf = lambda x: math.log((len(texts) + 1) / (often.get(x, 0) + 1)) + 1e-9
    out = []
    for w in words:
        labels, score = set(), 0.0
        for label, notice, key in license_scan.TEMPLATES:
            n, k = notice.split(), key.split()
            ko = next(i for i in range(len(n)) if n[i : i + len(k)] == k)
            rare = sorted(range(len(n)), key=lambda i: (-idf(n[i]), i))[: license_scan.INDEXED]
            outer = {i for i in rare if not ko <= i < ko + len(k)}
            for place in range(-len(n), len(w)):
                if place + ko < 0 or w[place + ko : place + ko + len(k)] != k:
                    continue
                hit = [i for i in rare if 0 <= place + i < len(w) and w[place + i] == n[i]]
                share = sum(idf(n[i]) for i in hit) / sum(idf(n[i]) for i in rare)
                if len(hit) >= min(license_scan.AGREE, len(rare)) and (not outer or outer & set(hit)) and share >= license_scan.SHARE:
                    labels.add(label)
                    score = max(score, min(1.0, share))
        out.append((labels, score))
    return out


def test_license_notices_against_brute_force(spark):
    rng = random.Random(6)
    fill = lambda n: " ".join(f"v{rng.randrange(200)}" for _ in range(n))
    rows = [fill(rng.randrange(200)) for _ in range(60)] + [None, "", "apache license, version 2.0", fill(9) + " MIT License " + fill(9)]
    for _, notice, key in license_scan.TEMPLATES:
        w = notice.split()
        rows += [f"{fill(20)} {notice} {fill(5)}", f"{notice.title()}.", " ".join(w[len(w) // 2 :]), f"{fill(3)} {key} {fill(3)}", notice.replace(key, "another text of terms"), " ".join(w[i] if rng.random() < 0.8 else "other" for i in range(len(w)))]
    rows.append(" ".join([*(t[1] for t in license_scan.TEMPLATES), "license mit software " * 3000]))  # many notices and many proposals in one long text
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, found string")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    for i, (labels, score) in enumerate(notices_by_force(rows)):
        r = got[i]
        assert set(filter(None, r["labels"].split(","))) == labels | set(filter(None, r["base_labels"].split(",")))
        assert abs(r["score"] - score) < 1e-8
    first = 64 + 6 * len(license_scan.NOTICES + license_scan.HEADS)
    key_alone, around = first + 3, first + 4  # of the GPL's statement: a key phrase without its notice, a notice without its key phrase
    assert got[key_alone]["labels"] == "gpl" and got[around]["labels"] == "" and got[first]["labels"] == "gpl,gpl-3.0"
    assert 0.5 <= min(r["score"] for r in got.values() if r["score"]) < 0.9  # scores tell whole notices from parts


def test_license_heads_and_identifiers(spark):
    rows = ["GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "// SPDX-License-Identifier: Apache-2.0", "# SPDX-License-Identifier: MIT", "All rights reserved.", "Released under the MIT License.", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"]
    got = [r["labels"] for r in license_scan.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["gpl,gpl-3.0", "apache-2.0", "mit", "", "mit", "all-rights-reserved"]
