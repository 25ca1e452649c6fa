"""Operator 1: a quality classifier on supervised subword embeddings.

A document is the mean of learned vectors: one for each word, one for each
character n-gram of it, one for each word bigram (two words that stand side by
side) and one for each bigram of word shapes (runs of capitals, of small
letters, of digits and other characters; a word that repeats the one before it
follows the shape "same"), hashed into a table. A run without white space of more than ``LONG``
characters gives all its n-grams too, but counts for no more than one of
``LONG`` characters. A softmax layer on the mean gives the class probabilities.
Both are trained by numpy stochastic gradient descent on a bounded sample of
labelled rows (:class:`Settings`).

A mean of vectors followed by a linear layer is the mean of one number for
each class and hashed feature, so a trained model is folded into one number a
feature and scores a corpus by one gather for each distinct word of a batch.

Defined cases: a null, empty or blank text has no features and gets the score
of the bias alone; conflicting labels count as rows each, repeated rows once; null
labels are left out; if labels hold one class, every score leans to it; no
labels at all give 0.5; an empty table gives an empty one; other columns of
the input are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import filtered_by, ship, text_bytes
from tessera.llm.lexicon import Memo, slices, split_words, sums


@dataclass(frozen=True)
class Settings:
    """Of the model and its training. ``sample``: labelled rows that are used at most (chosen by hash of the id)."""

    buckets: int = 1 << 17
    dim: int = 8
    grams: tuple[int, ...] = (3, 4)
    sample: int = 3000
    epochs: int = 6
    rate: float = 60.0
    seed: int = 1


#: Characters of a word that counts in full; n-grams hashed at once.
LONG, BLOCK = 40, 1 << 16
ONE = np.ones(1)
#: Capitals, other letters (what is left of them) and digits; runs of one character; the number of the shape "same".
SHAPE = re.compile(r"[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]"), re.compile(r"[^\W\d_A]"), re.compile(r"\d")
RUN = re.compile(r"(.)\1+", re.S)
SAME = 1
PACKED = np.dtype([("total", "f8"), ("n", "f8"), ("numbers", "u4", 2)])


def word_features(word: bytes, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a word and their weights (one for all, or one each): itself and its character n-grams, with marks for its ends; case is kept."""
    import xxhash

    chars = f"<{word.decode('utf-8', 'replace')}>"
    hashed = lambda parts: np.fromiter((xxhash.xxh3_64_intdigest(p) & (s.buckets - 1) for p in parts), np.int32, len(parts))
    if len(chars) <= LONG + 2:
        return hashed([chars, *(chars[i : i + n] for n in s.grams for i in range(len(chars) - n + 1))]), ONE
    counts = np.bincount(hashed([chars]), minlength=s.buckets)
    for n in s.grams:
        for begin in range(0, len(chars) - n + 1, BLOCK):
            counts += np.bincount(hashed([chars[i : i + n] for i in range(begin, min(begin + BLOCK, len(chars) - n + 1))]), minlength=s.buckets)
    at = np.flatnonzero(counts)
    most = 1 + sum(LONG + 3 - n for n in s.grams)  # one very long word must not outweigh its document
    return at.astype(np.int32), counts[at] * (most / counts.sum())


def word_numbers(word: bytes) -> tuple[int, int]:
    """32-bit numbers of a word and of its shape, of which the features of bigrams are made."""
    import xxhash

    shape = SHAPE[2].sub("0", SHAPE[1].sub("a", SHAPE[0].sub("A", word.decode("utf-8", "replace"))))
    return xxhash.xxh3_64_intdigest(word) >> 32, xxhash.xxh3_64_intdigest("shape " + RUN.sub(r"\1", shape)) >> 32


def bigrams(numbers: np.ndarray, codes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The word and shape features of each two neighbours in a run of words, given as ``codes`` of rows of :func:`word_numbers`."""
    out = []
    for k in (0, 1):
        of = numbers[:, k].astype(np.uint64)[codes]
        before = of[:-1] if k == 0 else np.where(codes[:-1] == codes[1:], np.uint64(SAME), of[:-1])
        x = (before * np.uint64(0x9E3779B97F4A7C15) + of[1:]) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((((x ^ (x >> np.uint64(29))) >> np.uint64(16)) & np.uint64(buckets - 1)).astype(np.int32))
    return out[0], out[1]


def document_features(texts: pa.Array, s: Settings, memo: Memo) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, how often) of each text."""
    words, codes, offsets = split_words(texts)
    by_word = memo.look_up(words, lambda ws: [word_features(w, s) for w in ws])
    numbers = np.array([word_numbers(w) for w in words], np.uint64).reshape(-1, 2)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if a == b:
            yield np.zeros(0, np.int32), np.zeros(0)
        else:
            kinds, often = np.unique(codes[a:b], return_counts=True)
            found = [by_word[k] for k in kinds]
            counts = np.bincount(np.concatenate([f for f, _ in found]), np.concatenate([np.full(len(f), n) if w is ONE else n * w for n, (f, w) in zip(often, found, strict=True)]), s.buckets)
            for pairs in bigrams(numbers, codes[a:b], s.buckets):
                counts += np.bincount(pairs, minlength=s.buckets)
            at = np.flatnonzero(counts)
            yield at.astype(np.int32), counts[at]


@dataclass
class Model:
    """What scoring needs: a number for each feature, whose mean is added to the bias and squashed."""

    weight: np.ndarray
    bias: float
    settings: Settings


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> Model:
    """Stochastic gradient descent over documents (features, counts, label 0 or 1), rate falling to 0."""
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    layer, bias = np.zeros((2, s.dim), np.float32), np.zeros(2, np.float32)
    share = np.bincount([y for _, _, y in rows], minlength=2) / max(1, len(rows))
    if rows:
        bias = np.log(np.maximum(share, 1e-3)).astype(np.float32)
    steps, step = s.epochs * len(rows), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            at, often, y = rows[i]
            rate = s.rate * (1 - step / steps) / 100
            step += 1
            part = (often / often.sum()).astype(np.float32) if len(at) else np.zeros(0, np.float32)
            mean = part @ vectors[at] if len(at) else np.zeros(s.dim, np.float32)
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ layer
            layer -= rate * np.outer(p, mean)
            bias -= rate * 0.1 * p
            vectors[at] -= (rate * 100 * part)[:, None] * back
    weight = vectors @ (layer[1] - layer[0])
    return Model(weight.astype(np.float64), float(bias[1] - bias[0]), s)


def training_rows(labelled: DataFrame, s: Settings) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features of the sample (id, text, label; one row each), worked out on the executors; at most ``s.sample`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for b in batches:
            for start, part in slices(text_bytes(b.column(1))):
                found = list(document_features(part, s, memo))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(part)), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([n.astype(np.float32).tobytes() for _, n in found], pa.binary()), b.column(2).slice(start, len(part))], names=["id", "at", "often", "label"])

    kind = labelled.schema["id"].dataType.simpleString()
    rows = labelled.select("id", "text", "label").mapInArrow(run, f"id {kind}, at binary, often binary, label int").collect()
    rows.sort(key=lambda r: (r["id"] is None, r["id"], r["label"]))
    return [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["often"], np.float32).astype(np.float64), r["label"]) for r in rows]


def fit(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, settings: Settings | None = None) -> Model:
    """A model from the labelled rows; labels other than 0 and 1 are left out."""
    ship(documents.sparkSession)
    s = settings or Settings()
    chosen = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    chosen = chosen.distinct().orderBy(F.xxhash64("id"), "id", "label").limit(s.sample)
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # broadcast: at most the sample's ids
    return train(training_rows(sample, s), s)


def scorer(m: Model):
    """A function from a batch of texts to their scores, with a cache of words."""
    memo = Memo()

    def weigh(words: list[bytes]) -> list[bytes]:
        """Of each word the sum of its features' weights, their number and its :func:`word_numbers`, packed: a memo holds many."""
        found = [word_features(w, m.settings) for w in words]
        sizes = np.array([len(f) for f, _ in found])
        totals = sums(m.weight[np.concatenate([f for f, _ in found])], np.concatenate([[0], np.cumsum(sizes)]))
        rows = np.zeros(len(words), PACKED)
        rows["total"], rows["n"] = totals, sizes
        for i, (f, w) in enumerate(found):
            if w is not ONE:
                rows[i]["total"], rows[i]["n"] = m.weight[f] @ w, w.sum()
        rows["numbers"] = np.array([word_numbers(w) for w in words], np.uint32)
        packed, size = rows.tobytes(), PACKED.itemsize
        return [packed[i : i + size] for i in range(0, len(packed), size)]

    def scores(texts: pa.Array) -> np.ndarray:
        done = [np.zeros(0)]
        for _, part in slices(texts):
            words, codes, offsets = split_words(part)
            by_word = np.frombuffer(b"".join(memo.look_up(words, weigh)), PACKED)
            total = np.stack([sums(by_word[c][codes], offsets) for c in ("total", "n")], axis=1)
            pairs = np.zeros(len(codes))  # the weights of each word's bigrams with the one before it
            if len(codes):
                pairs[1:] = sum(m.weight[x] for x in bigrams(by_word["numbers"], codes, m.settings.buckets))
            pairs[offsets[:-1][offsets[:-1] < len(codes)]] = 0  # a text's first word has none before it
            more = 2 * np.maximum(np.diff(offsets) - 1, 0)
            z = (total[:, 0] + sums(pairs, offsets)) / np.maximum(total[:, 1] + more, 1) + m.bias
            done.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
        return np.concatenate(done)

    return scores


def score(documents: DataFrame, model: Model, id_col: str, text_col: str, out: str = "score") -> DataFrame:
    """(id, score) for each row: the probability of label 1; one pass, no shuffle."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # its size is fixed by the settings: 8 bytes a bucket
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scorer(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(text_bytes(b.column(1))))], names=[id_col, out])

    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{out}` double")


def keep(documents: DataFrame, model: Model, text_col: str, least: float = 0.5) -> DataFrame:
    """The rows with a score of ``least`` or more, with their columns as they were."""
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def judge():
        scores = scorer(shared.value)
        return lambda texts: scores(texts) >= least

    return filtered_by(documents, text_col, judge)


def held_out(id_col: str):
    """Whether crc32 of the id as text leaves 1 when divided by 3: rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
