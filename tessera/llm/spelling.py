"""Operator 13: groups of spelling variants by rolling-hash deletions.

1. One pass splits texts into runs of letters, misspells the few that the
   contract's rule selects, and counts words, combined in each task.
2. Words are arrays of code points, taken together by length. Prefix and suffix
   sums of a polynomial hash modulo 2^64 give the hash of a word without its
   i-th code point for all i at once: prefix + (suffix divided by the base).
   Keys are (a) that hash mixed with i: words that differ by a replacement at i
   share it; (b) the hash alone, and the hash of the whole word: a word and one
   with a code point more share it.
3. Keys are partitioned by their first bits (radix) into parts of bounded size,
   each part is sorted, and in each run of equal keys the strings are compared,
   so that colliding hashes never make two words near. A run leaves one row a
   word, with the number of its near words there and the best of them; pairs
   are never written. A run is bounded by the alphabet, not by the data: words
   that agree in all but one code point.
4. Rows of a word are combined; roots are found by pointer jumping.

Only code points up to U+00FF are letters here, so a word is a byte string in
Latin-1.

Defined cases: a null text has no words; repeated ids are documents of their
own; a null id is written as empty in the misspelling rule; ties go to the
smaller word; a word without near words has no form and is its own root; an
empty table gives an empty one; other columns are left out, whatever their
names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_written, scratch, ship, text_bytes, written
from tessera.llm.lexicon import ASCII_LETTERS, runs, slices

#: Base of the polynomial hash, odd so that it can be divided by, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Words whose counts a task holds before it passes them on, and key rows of a radix part on average.
HELD, PART = 400_000, 500_000
#: A run is misspelled if its number divides by this; longer runs than ``SHORT`` code units have their checksum worked out one by one.
EVERY, SHORT = 199, 64


def _zero_table() -> np.ndarray:
    """What a zero byte makes of a CRC state, by its low byte: the table of the reflected polynomial of crc32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_ZERO = _zero_table()


def numbers(prefixes: list[bytes], doc: np.ndarray, codes: np.ndarray, words: list[bytes]) -> np.ndarray:
    """crc32(prefix of the document + word) of each occurrence: crc32 is linear, so the two checksums are combined."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    own = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    shifted = np.empty((SHORT + 1, len(prefixes)), np.uint32)
    shifted[0] = np.fromiter(map(zlib.crc32, prefixes), np.uint32, len(prefixes))
    for i in range(SHORT):  # one zero byte more
        shifted[i + 1] = (shifted[i] >> np.uint32(8)) ^ _ZERO[shifted[i] & np.uint32(255)]
    length = size[codes]
    out = shifted[np.minimum(length, SHORT), doc] ^ own[codes]
    for i in np.flatnonzero(length > SHORT):
        out[i] = zlib.crc32(prefixes[doc[i]] + words[codes[i]])
    return out


def word_counts(df: DataFrame, id_col: str, text_col: str, least_length: int, misspell: bool = True) -> DataFrame:
    """(word, n): words of at least ``least_length`` code points and how often they occur, summed up over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for start, part in slices(text_bytes(b.column(1))):
                for found in counts(b.column(0).slice(start, len(part)), part):
                    held.append(found)
                    size += found.num_rows
                    if size > HELD:
                        held = [summed(held)]
                        size = held[0].num_rows
                        if size > HELD // 2:
                            yield from held[0].to_batches()
                            held, size = [], 0
        if held:
            yield from summed(held).to_batches()

    def summed(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks()

    def counts(ids: pa.Array, texts: pa.Array) -> Iterator[pa.Table]:
        words, codes, offsets = runs(texts, ASCII_LETTERS, latin=True)
        if not len(words):
            return
        n = np.bincount(codes, minlength=len(words))
        if misspell:
            prefixes = [f"{i}:".encode() for i in pc.fill_null(ids.cast(pa.string()), "").to_pylist()]
            doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
            number = numbers(prefixes, doc, codes, words.cast(pa.binary()).to_pylist())
            hit = np.flatnonzero(number % EVERY == 0)
            n -= np.bincount(codes[hit], minlength=len(words))
            changed = []
            for w, h in zip(words.take(pa.array(codes[hit])).to_pylist(), number[hit].tolist(), strict=True):
                i = h % len(w)
                changed.append(w[:i] + w[i + 1 :])
            if changed:
                yield long_enough(pa.array(changed, pa.string()), np.ones(len(changed), np.int64))
        yield long_enough(words, n)

    def long_enough(words: pa.Array, n: np.ndarray) -> pa.Table:
        keep = pc.and_(pc.greater_equal(pc.utf8_length(words), least_length), pa.array(n > 0))
        return pa.table({"word": words.filter(keep), "n": pa.array(n).filter(keep)})

    each = df.select(id_col, text_col).mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the words without each code point, keys of the whole words) of words of one length, a row each."""
    n, length = points.shape
    power = np.array([pow(BASE, k, 1 << 64) for k in range(length)], np.uint64)
    terms = (points.astype(np.uint64) + np.uint64(1)) * power
    before = np.zeros((n, length + 1), np.uint64)
    np.cumsum(terms, axis=1, out=before[:, 1:])
    whole = before[:, -1]
    after = whole[:, None] - before[:, 1:]
    return spread(before[:, :-1] + after * np.uint64(INVERSE), length - 1), spread(whole, length)


def spread(x: np.ndarray, length: int) -> np.ndarray:
    """A bijection that lets all bits of a hash reach the first ones; words of different length are apart."""
    x = (x + np.uint64(length)) * np.uint64(BASE)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def key_rows(words: DataFrame, parts: int, bits: int) -> DataFrame:
    """(part, key, at, kind, word, n): at is the deleted place; kind 0: replacement at it, 1: word less a code point, 2: whole word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [w.encode("latin-1") for w in b.column(0).to_pylist()]
            size = np.fromiter(map(len, raw), np.int64, len(raw))
            for length in np.unique(size):
                every = np.flatnonzero(size == length)
                for begin in range(0, len(every), max(1, 200_000 // int(length))):
                    who = every[begin : begin + max(1, 200_000 // int(length))]
                    points = np.frombuffer(b"".join(raw[i] for i in who), np.uint8).reshape(len(who), length)
                    without, whole = deletion_keys(points)
                    place = np.arange(length, dtype=np.uint64)
                    keys = np.concatenate([spread(without + (place + np.uint64(1)) * np.uint64(BASE), 0).ravel(), without.ravel(), whole]) >> np.uint64(64 - bits)
                    at = np.concatenate([np.tile(np.arange(length), 2 * len(who)), np.full(len(who), -1)])
                    kind = np.repeat([0, 1, 2], [without.size, without.size, len(who)])
                    row = pa.array(np.concatenate([np.repeat(who, length), np.repeat(who, length), who]))
                    part = (keys >> np.uint64(max(0, bits - 32))) * np.uint64(parts) >> np.uint64(min(bits, 32))
                    yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(kind.astype(np.int8)), b.column(0).take(row), b.column(1).take(row)], names=["part", "key", "at", "kind", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "part int, key long, at int, kind byte, word string, n long")


def _in_part(t: pa.Table) -> pa.Table:
    """(word, near, best_n, best): for each word of each run of equal keys, its near words there and the best of them."""
    key = t.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    t = t.take(pa.array(order))
    keys, at, kind, words, n = (t.column(c).to_pylist() for c in ("key", "at", "kind", "word", "n"))
    out: list[tuple[str, int, int, str]] = []
    for _, run in groupby(range(len(keys)), keys.__getitem__):
        swaps: dict[tuple[int, str], list[tuple[int, str]]] = {}
        less: dict[str, set[tuple[int, str]]] = {}
        whole = []
        for i in run:
            w = words[i]
            if kind[i] == 2:
                whole.append((-n[i], w))
            elif kind[i] == 1:
                less.setdefault(w[: at[i]] + w[at[i] + 1 :], set()).add((-n[i], w))
            else:
                swaps.setdefault((at[i], w[: at[i]] + w[at[i] + 1 :]), []).append((-n[i], w))
        for group in swaps.values():
            if len(group) > 1:
                first, second = sorted(group)[:2]
                out += [(w, len(group) - 1, -other[0], other[1]) for m, w in group for other in [second if w == first[1] else first]]
        for own in whole:
            if longer := less.get(own[1]):
                best = min(longer)
                out.append((own[1], len(longer), -best[0], best[1]))
                out += [(w, 1, -own[0], own[1]) for _, w in longer]
    w, near, best_n, best = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.table({"word": pa.array(w, pa.string()), "near": pa.array(near, pa.int64()), "best_n": pa.array(best_n, pa.int64()), "best": pa.array(best, pa.string())})


def near_words(words: DataFrame, bits: int = 64) -> DataFrame:
    """(word, n_near, best_n, best) of each of ``words`` (word, n) that has near words."""
    parts = max(64, (words.agg(F.sum(2 * F.length("word") + 1)).first()[0] or 0) // PART)
    each = key_rows(words, parts, bits).groupBy("part").applyInArrow(_in_part, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best"))).alias("first")
    return each.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", (-F.col("first.m")).alias("best_n"), "first.best")


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, ratio: int = 5, misspell: bool = True, bits: int = 64) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word; keys have ``bits`` bits, which changes no result."""
    spark = df.sparkSession
    ship(spark)
    with scratch(spark) as result:
        words = written(spark, word_counts(df, id_col, text_col, least_length, misspell).where(F.col("n") >= least_count), "words")
        near = near_words(words, bits)
        has = F.col("best_n") >= ratio * F.col("n")
        formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"))
        formed = written(spark, formed, "formed")
        roots = written(spark, formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
        while True:  # counts grow along forms, so there is no ring, and each round doubles the way
            onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
            if roots.join(onward, "root", "left_semi").isEmpty():
                break
            done, roots = roots, written(spark, roots.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
            drop_written(spark, done)
        return result(formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
