"""Operator 3: toxicity as a severity grade, by cumulative-link ordinal regression.

The labels say only whether a text is toxic. Severity grades for training are
0 for texts that are not, and 1 to 3 for toxic ones by thirds of their log odds
under a plain two-class model that was fitted on *other* texts: the labelled
texts are halved by hash of their features, and each half is graded by the
model of the other half. So a grade says how strongly what was learned
elsewhere speaks for toxicity, and no text grades itself.

The model has one weight for each sparse text feature, shared by all grades,
and ordered thresholds: P(grade <= k) = sigmoid(threshold_k - w.x). Features
are the presence of lower-cased words and of their first 4, 5 and 6
characters, by 64-bit hash of the whole of each. Only features enter whose link with toxicity chance
does not explain: a likelihood-ratio test at five expected errors among
all features tried, so words without meaning for the grade weigh nothing, in long
texts as in short ones. Weights are fitted by gradient steps with a small
ridge. The output is the expected severity, sum over k of P(grade > k); ``toxic`` where P(grade > 0) reaches the
cut that makes the fewest errors on the training texts; and the likeliest of
grades 1 to 3 where toxic, else grade 0.

Defined cases: a null, empty or blank text has no features and gets the
severity of the thresholds alone; conflicting labels count as rows each,
repeated rows once; null labels are left out; without toxic training texts
every severity is 0; an empty table gives an empty one; other columns of the
input are left out, whatever their names.
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
from tessera.llm.lexicon import Memo, slices, split_words

WORD = re.compile(r"\w+")
GRADES = 3


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled rows of each class that are used at most, chosen by hash of the id."""

    sample: int = 2000
    least_texts: int = 3
    ridge: float = 1e-3
    steps: int = 1000
    errors: float = 5.0


def word_features(chunk: bytes) -> list[int]:
    """64-bit hashes of the words in a chunk without white space, and of their beginnings."""
    import xxhash

    out = set()
    for w in WORD.findall(chunk.decode("utf-8", "replace").lower()):
        out.add(xxhash.xxh3_64_intdigest("=" + w))
        out.update(xxhash.xxh3_64_intdigest(w[:n]) for n in (4, 5, 6) if len(w) >= n)
    return sorted(out)


@dataclass
class Model:
    features: np.ndarray  # sorted 64-bit hashes of the features that weigh anything
    weights: np.ndarray
    thresholds: np.ndarray  # ascending
    cut: float = 0.5  # texts with P(grade > 0) of this or more are toxic


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def likelihood(owner: np.ndarray, flat: np.ndarray, y: np.ndarray, w: np.ndarray, theta: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood with its ridge, and its gradients by weights and thresholds.

    Text ``owner[i]`` has feature ``flat[i]``; ``y`` holds grades from 0 to ``len(theta)``.
    """
    n = len(y)
    z = np.bincount(owner, w[flat], n)
    ends = np.concatenate([[-np.inf], theta, [np.inf]])
    upper, lower = sigmoid(ends[y + 1] - z), sigmoid(ends[y] - z)
    upper, lower = np.where(y == len(theta), 1.0, upper), np.where(y == 0, 0.0, lower)
    p = np.maximum(upper - lower, 1e-12)
    du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
    by_w = np.bincount(flat, ((du - dl) / n)[owner], len(w)) + ridge * w
    by_theta = np.array([dl[y == k + 1].sum() - du[y == k].sum() for k in range(len(theta))]) / n
    return float(-np.log(p).mean() + ridge / 2 * (w @ w)), by_w, by_theta


def descend(rows: list[np.ndarray], y: np.ndarray, features: int, grades: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by gradient steps; rows hold feature numbers."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    w, squares = np.zeros(features), np.full(features, 1e-8)
    share = np.clip([(y <= k).mean() for k in range(grades)], 1e-3, 1 - 1e-3)
    theta, theta_squares = np.log(share / (1 - share)), np.full(grades, 1e-8)
    for _ in range(s.steps):
        _, by_w, by_theta = likelihood(owner, flat, y, w, theta, s.ridge)
        squares += by_w**2
        w = w - 0.3 / np.sqrt(squares) * by_w
        theta_squares += by_theta**2
        theta = np.maximum.accumulate(theta - 0.3 / np.sqrt(theta_squares) * by_theta)
    return w, theta


def grades_of(rows: list[np.ndarray], half: np.ndarray, toxic: np.ndarray, features: int, s: Settings) -> np.ndarray:
    """Training grades from toxic flags: thirds of the log odds under the model of the other half."""
    odds = np.zeros(len(rows))
    for part in (half, ~half):
        others = np.flatnonzero(~part)
        if len(others) and part.any():
            w, _ = descend([rows[i] for i in others], toxic[others].astype(int), features, 1, s)
            odds[part] = [w[r].sum() for r, p in zip(rows, part, strict=True) if p]
    cuts = np.quantile(odds[toxic], [1 / 3, 2 / 3])
    return np.where(toxic, 1 + (odds > cuts[0]).astype(int) + (odds > cuts[1]), 0)


def telling(among: np.ndarray, often: np.ndarray, toxic: int, texts: int, s: Settings) -> np.ndarray:
    """Which features (in ``often`` texts, ``among`` of them toxic) pass the likelihood-ratio test against no link with toxicity."""
    tried = max(2, int((often >= s.least_texts).sum()))
    total = 0.0
    for seen, kind, size in ((among, often, toxic), (often - among, often, texts - toxic), (toxic - among, texts - often, toxic), (texts - toxic - often + among, texts - often, texts - toxic)):
        expected = np.maximum(kind * size / texts, 1e-300)
        total = total + 2 * seen * np.log(np.maximum(seen, 1e-300) / expected)
    tried = max(2.0, tried / s.errors)
    bound = 2 * np.log(tried) - np.log(2 * np.log(tried)) - np.log(np.pi / 2)  # chi-square with one degree: p of about errors / tried
    return (often >= s.least_texts) & (total > bound)


def best_cut(z: np.ndarray, toxic: np.ndarray) -> float:
    """Within the widest gap among the cuts with the fewest errors on the training texts, in proportion to the spreads of both classes.

    Texts without a telling word lie close together and toxic ones far apart, so the cut is nearer to the former.
    """
    order = np.argsort(z, kind="stable")
    spread = [max(1e-9, float(z[toxic == flag].std())) if (toxic == flag).any() else 1.0 for flag in (False, True)]
    z, toxic = z[order], toxic[order]
    errors = np.cumsum(toxic)[:-1] + np.cumsum(~toxic[::-1])[::-1][1:]  # toxic ones below, others above
    gaps = np.diff(z)
    if not (gaps > 0).any():
        return float(z[-1]) + 1.0
    errors = np.where(gaps > 0, errors, len(z) + 1)
    at = np.flatnonzero(errors == errors.min())
    i = at[gaps[at].argmax()]
    return float(z[i] + gaps[i] * spread[0] / sum(spread))


def fit_rows(hashes: list[np.ndarray], toxic: np.ndarray, s: Settings) -> Model:
    """The model of training texts, each given by its distinct features."""
    if not toxic.any():
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES, 40.0))
    kinds, index, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    flag = np.repeat(toxic, [len(h) for h in hashes])
    keep = telling(np.bincount(index[flag], minlength=len(kinds)), often, int(toxic.sum()), len(toxic), s)
    new = np.cumsum(keep) - 1
    ends = np.cumsum([len(h) for h in hashes])
    rows = [new[i[keep[i]]] for i in np.split(index, ends[:-1])]
    kinds = kinds[keep]
    half = np.array([int(h.sum(dtype=np.uint64) >> np.uint64(40)) % 2 == 1 for h in hashes], bool)
    y = grades_of(rows, half, toxic, len(kinds), s)
    w, theta = descend(rows, y, len(kinds), GRADES, s)
    z = np.array([w[r].sum() for r in rows])
    return Model(kinds, w, theta, float(sigmoid(best_cut(z, toxic) - theta[0])))


def fit(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, settings: Settings | None = None) -> Model:
    """A model from labelled rows; at most ``2 * settings.sample`` texts' features reach the driver."""
    ship(documents.sparkSession)
    s = settings or Settings()
    every = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    part = lambda v: every.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(s.sample)
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(part(0).unionAll(part(1))), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # broadcast: at most the samples' ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for b in batches:
            for start, texts_part in slices(text_bytes(b.column(2))):
                words, codes, offsets = split_words(texts_part)
                by_word = memo.look_up(words, lambda ws: [np.array(word_features(w), np.uint64) for w in ws])
                out = []
                for x, y in zip(offsets[:-1], offsets[1:], strict=True):
                    found = [by_word[k] for k in np.unique(codes[x:y])]
                    out.append((np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts_part)), b.column(1).slice(start, len(texts_part)), pa.array(out, pa.binary())], names=["id", "label", "features"])

    kind = sample.schema["id"].dataType.simpleString()
    rows = sample.mapInArrow(run, f"id {kind}, label int, features binary").collect()
    rows.sort(key=lambda r: (r["id"], r["label"]))
    return fit_rows([np.frombuffer(r["features"], np.uint64) for r in rows], np.array([r["label"] == 1 for r in rows], bool), s)


def grader(m: Model):
    """A function from a batch of texts to P(grade > k) for each k, with a cache of words."""
    memo = Memo()
    index = dict(zip(m.features.tolist(), range(len(m.features)), strict=True))

    def hits(words: list[bytes]) -> list[tuple[int, ...]]:
        return [tuple(index[f] for f in word_features(w) if f in index) for w in words]

    def above(texts: pa.Array) -> np.ndarray:
        z = []
        for _, part in slices(texts):
            words, codes, offsets = split_words(part)
            by_word = memo.look_up(words, hits)
            places = np.flatnonzero(np.array([bool(h) for h in by_word], bool)[codes])
            bounds = np.searchsorted(places, offsets)
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                present = {f for c in codes[places[x:y]].tolist() for f in by_word[c]}
                z.append(float(sum(m.weights[f] for f in sorted(present))))
        return sigmoid(np.array(z).reshape(-1, 1) - m.thresholds[None, :])

    return above


def severity(documents: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(id, severity, grade, toxic) for each row; one pass, no shuffle."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the training sample's features
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grade = grader(shared.value)
        for b in batches:
            above = grade(text_bytes(b.column(1)))
            edge = np.ones((len(above), 1)), np.zeros((len(above), 1))
            chance = np.concatenate([edge[0], above], 1) - np.concatenate([above, edge[1]], 1)
            toxic = above[:, 0] >= shared.value.cut
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(above.sum(1)), pa.array(np.where(toxic, 1 + chance[:, 1:].argmax(1), 0).astype(np.int32)), pa.array(toxic)], names=[id_col, "severity", "grade", "toxic"])

    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, severity double, grade int, toxic boolean")


def keep(documents: DataFrame, model: Model, text_col: str) -> DataFrame:
    """The rows that are not toxic, with their columns as they were."""
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def judge():
        grade = grader(shared.value)
        return lambda texts: grade(texts)[:, 0] < shared.value.cut

    return filtered_by(documents, text_col, judge)
