"""Operators 11 to 13 against brute force, with the defined edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import exact_dedup, lexical_search, spelling
from tessera.llm.lexicon import ASCII_LETTERS, LETTERS_DIGITS_OTHERS, runs

SCHEMA = "doc_id long, text string, id string, fp string, word string, n string, score string, block string, item string"


def frame(spark, rows):
    """With columns whose names clash with those of results and of tables between."""
    return spark.createDataFrame([(i, t, *["x"] * 7) for i, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("pattern, inside, latin", [("[A-Za-zÀ-ÿ]+", ASCII_LETTERS, True), ("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", LETTERS_DIGITS_OTHERS, False)])
def test_runs(pattern, inside, latin):
    rng = random.Random(1)
    texts = [None, "", "a", "À", " x", "x ", *("".join(rng.choice("aZ9 .Àÿ×¿Ā漢\U0001f600\x7f@[`{/:") for _ in range(rng.randrange(30))) for _ in range(300))]
    words, codes, offsets = runs(pa.array(["skipped", *texts]).slice(1), inside, latin)
    lower = lambda w: "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
    assert [[words[c].as_py() for c in codes[a:b]] for a, b in zip(offsets, offsets[1:], strict=False)] == [list(map(lower, re.findall(pattern, t or ""))) for t in texts]


COPIES = [(5, "a  b"), (3, "a b"), (9, "a\t\n\x0b\x0c\r b"), (4, "a b"), (11, "a\x1cb"), (1, " a b"), (2, "a b "), (7, None), (6, ""), (8, " "), (10, "\n\n"), (12, "z" * 90_000), (13, "z" * 90_000), (3, "a b"), (3, "other"), (20, "other"), (None, "a b"), (None, "alone"), (None, "alone"), (14, "A b"), (15, "é"), (16, "é")]


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(2)
    for bits in (5, 12, 64):
        parts = [rng.integers(0, 1 << min(bits, 62), n, dtype=np.uint64) for n in (1, 40, 700)]
        parts.append(np.full(300, parts[0][0]))
        for shard_bits in (0, 3):
            filters = [exact_dedup.QuotientFilter.build(p, bits, shard_bits) for p in parts]
            got = Counter()
            for k in range(1 << shard_bits):
                if own := [f for x in filters for number, f in x.parts(shard_bits) if number == k]:
                    one = exact_dedup.merged(own)
                    assert all((np.diff(r.astype(np.float64)) > 0).all() for r in np.split(one.remainders, np.cumsum(one.runs)[:-1]))
                    got.update({(k << (bits - shard_bits)) | int(v): int(n) for v, n in zip(one.fingerprints(), one.counts, strict=True)})
            assert got == Counter(np.concatenate(parts).tolist())


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_duplicates(spark, bits):
    """Three bits of fingerprint make most texts collide: bytes decide."""
    got = exact_dedup.exact_duplicates(frame(spark, COPIES), bits=bits).collect()
    norm = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t in COPIES]
    want = []
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        low = min((j for j in ids if j is not None), default=None)
        want.append((i, low, len(ids), i == low, hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert exact_dedup.exact_duplicates(frame(spark, []), bits=bits).count() == 0


def test_without_duplicates(spark):
    df = frame(spark, COPIES)
    got = exact_dedup.without_duplicates(df)
    assert got.columns == df.columns
    norm = Counter(re.sub("[\x20\x09-\x0d]+", " ", r["text"] or "") for r in got.collect())
    assert norm == Counter({re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in COPIES})


def ranked(docs, items):
    find = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := find(t))]
    n_docs, every = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        terms, scores = Counter(find(text)), []
        for i, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // every
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in terms.items() if c[t])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:10], 1)]
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(400)]
    docs += [(500 + i, docs[3][1]) for i in range(30)] + [(600, None), (601, ""), (602, "!?"), (None, docs[5][1]), (603, "W7,w7;漢字 " * 4000), (4, docs[9][1])]
    items = [(i, docs[i * 7][1] + " unseen") for i in range(25)] + [(50, None), (51, ""), (52, "nowhere"), (3, "w1 w1 W1 w2"), (None, "漢字"), (53, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search(spark, corpus, monkeypatch, small):
    docs, items = corpus
    if small:  # several passes and matrices, and tiers that prove some items
        for name, value in {"PASS_ITEMS": 9, "TIERS": ((0.05, 8), (0.5, 40)), "POOL": 25, "COLUMNS": 32, "MATRIX_ITEMS": 4}.items():
            monkeypatch.setattr(lexical_search, name, value)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    got = lexical_search.search(frame(spark, docs), asked).collect()
    assert sorted(repr((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in got) == ranked(docs, items)
    assert not small or len({r["tier"] for r in got}) > 1
    assert lexical_search.search(frame(spark, []), asked).count() == 0
    assert lexical_search.search(frame(spark, docs), asked.where("false")).count() == 0


def test_matrix_bounds(monkeypatch):
    """Terms in several parts, and items whose scores may leave the doubles."""
    monkeypatch.setattr(lexical_search, "TERMS", 3)
    rng = np.random.default_rng(4)
    residual = rng.integers(0, 50, 30)
    for large in (1, 10**12):
        items = [{int(t): int(rng.integers(1, 9)) * large for t in rng.choice(30, 7, replace=False)} for _ in range(5)]
        doc, term = np.divmod(rng.choice(20 * 30, 200, replace=False), 30)
        impact = residual[term] + rng.integers(0, 100, 200)
        matrix = lexical_search.Matrix(list(range(5)), items, residual)
        assert (matrix.kind is np.int64) == (large > 1)
        seen = {(d, t): x for d, t, x in zip(doc.tolist(), term.tolist(), impact.tolist(), strict=True)}
        want = [[sum(w * seen.get((d, t), int(residual[t])) for t, w in item.items()) for d in range(20)] for item in items]
        assert matrix.bounds(doc, term, impact, 20).tolist() == want


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(docs, misspell=True):
    words = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if misspell and h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            words[w] += 1
    words = {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}
    out = {}
    for w, n in words.items():
        found = sorted((-words[v], v) for v in words if near(w, v))
        form = found[0][1] if found and -found[0][0] >= 5 * n else None
        out[w] = (form, n, len(found), words[form] if form else None)
    rows = []
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, n_near, form_n))
    return sorted(map(repr, rows))


@pytest.fixture(scope="module")
def writing():
    rng = random.Random(11)
    letters = "abcé"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 9))) for _ in range(60)]
    stems += ["aaaaaa", "aaaaaaa", "aaaaaab", "É" + "bcdefg", "é" + "bcdefg", "bcdefgh", "abcdefgh", "ab" * 100, "ab" * 99 + "a", "×÷×÷×÷"]
    often = {w: 5 ** rng.randrange(1, 4) + rng.randrange(8) for w in stems}
    flat = [w for w, n in often.items() for _ in range(n)]
    rng.shuffle(flat)
    docs = [(i, " ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in flat[k : k + 23])) for i, k in enumerate(range(0, len(flat), 23))]
    return [*docs, (None, "abcabc " * 40), (2, None), (3, ""), (0, docs[0][1]), (90, "short words only 12 漢字")]


@pytest.mark.parametrize("bits", [64, 7])
def test_variants(spark, writing, bits):
    """Seven bits of key make most words collide: strings decide."""
    want = spelled(writing)
    assert any("None" not in r for r in want)
    got = spelling.variants(frame(spark, writing), bits=bits).collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    assert spelling.variants(frame(spark, [])).count() == 0


def test_variants_follow_chains(spark):
    """Roots over several forms, without the misspelling rule."""
    docs = [(k, " ".join([w] * n)) for k, (w, n) in enumerate([("abcdef", 5), ("abcdeg", 25), ("abcdeh", 24), ("abcdgg", 125), ("abcxgg", 625), ("abcxggz", 3125), ("zzzzzz", 9)])]
    got = spelling.variants(frame(spark, docs), misspell=False).collect()
    assert sorted(repr(tuple(r)) for r in got) == spelled(docs, misspell=False)
    assert {r["word"]: r["root"] for r in got}["abcdef"] == "abcxggz"


def test_misspelling_numbers():
    rng = random.Random(5)
    words = ["".join(rng.choice("abé") for _ in range(n)) for n in (1, 2, 7, 31, 32, 33, 64, 65, 200)]
    prefixes = ["", "0:", "123456789012:"]
    doc, codes = np.divmod(np.arange(27), 9)
    got = spelling.numbers([p.encode() for p in prefixes], doc, codes, [w.encode() for w in words])
    assert got.tolist() == [zlib.crc32((prefixes[d] + words[c]).encode()) for d, c in zip(doc, codes, strict=True)]
