"""Operator 12: ranked lexical search in a tiered index.

1. One pass over all texts counts their terms; of the postings it keeps those
   of terms that items ask for, in blocks of documents (one row a block).
2. N, L and, for each term, a histogram of impacts give document frequencies,
   weights and the limits of the tiers: the postings of highest impact of each
   term are tier 0, the next are tier 1, the rest tier 2. The largest impact
   below a tier is the term's residual bound there. The index has the tiers of
   a block in columns of their own, so that a search reads those it needs.
3. A search reads tier 0 first. What a document may score at most is what its
   postings found so far give, plus the residual bounds of the item's other
   terms. The ``POOL`` documents of largest bound are scored exactly from all
   tiers; if the tenth of them scores more than the bound of every document
   outside the pool, the result is exact. Items without that proof fall
   through to the next tier. In the last one no residual is left, so bounds are
   scores.

Bounds are matrix products of items and blocks, in doubles that hold whole
numbers exactly (below 2^53; items for which that isn't certain are taken in
64-bit integers). Each task keeps the best rows an item, so what leaves it does
not depend on its number of documents. Items come in passes of bounded number
and vocabulary; each pass reads all documents.

Defined cases: null or empty texts have no term, count nowhere and are never
found; an item without terms, or whose terms are in no document, has no rows;
every row of the items is an item of its own, also with a repeated or null id;
rows of one doc_id are documents of their own, and among equal scores their
order is that of reading; a null doc_id comes after all others; an empty table
on either side gives an empty result; other columns are left out, whatever
their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import scratch, ship, text_bytes, written
from tessera.llm.lexicon import LETTERS_DIGITS_OTHERS, runs, slices

#: Items and distinct terms of a pass at most (one item at least), and of items in a matrix.
PASS_ITEMS, PASS_TERMS, MATRIX_ITEMS = 4096, 100_000, 256
#: Share of a term's postings in the tiers but the last, and the least number of postings there.
TIERS = ((1 / 64, 256), (1 / 8, 4096))
#: Documents that are scored exactly for an item that isn't at the last tier.
POOL = 64
#: Documents and terms of a matrix.
COLUMNS, TERMS = 1024, 4096
#: Buckets of the histogram of impacts: eight for each doubling, of impacts up to a million.
BUCKETS = 8 * 20
_EXACT = 2**53


def terms_of(text: str | None) -> Counter:
    words, codes, _ = runs(pa.array([text], pa.string()), LETTERS_DIGITS_OTHERS)
    return Counter(dict(zip(words.to_pylist(), np.bincount(codes, minlength=len(words)).tolist(), strict=True)))


def passes(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, Counter]]]:
    """The items with terms, in lists of bounded number and vocabulary."""
    held, seen = [], set()
    for item, text in items.select(item_col, text_col).toLocalIterator():
        if not (terms := terms_of(text)):
            continue
        if held and (len(held) >= PASS_ITEMS or len(seen | terms.keys()) > PASS_TERMS):
            yield held
            held, seen = [], set()
        held.append((item, terms))
        seen |= terms.keys()
    if held:
        yield held


def counted(df: DataFrame, id_col: str, text_col: str, vocabulary: list[str]) -> DataFrame:
    """Blocks of documents: (ids, sizes, doc, term, tf, docs, total); a posting is a place in each of doc, term and tf."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(vocabulary, pa.string())
        for b in batches:
            for start, part in slices(text_bytes(b.column(1))):
                words, codes, offsets = runs(part, LETTERS_DIGITS_OTHERS)
                sizes = np.diff(offsets)
                known = pc.fill_null(pc.index_in(words, wanted), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                term = known[codes] if len(words) else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(len(part)), sizes)[term >= 0]
                posting, tf = np.unique(doc * len(vocabulary) + term[term >= 0], return_counts=True)
                one = lambda x, t: pa.array([x], pa.list_(t))
                ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), b.column(0).slice(start, len(part)))
                yield pa.RecordBatch.from_arrays([ids, one(sizes, pa.int64()), one(posting // len(vocabulary), pa.int32()), one(posting % len(vocabulary), pa.int32()), one(tf, pa.int64()), pa.array([int((sizes > 0).sum())], pa.int64()), pa.array([int(sizes.sum())], pa.int64())], names=["ids", "sizes", "doc", "term", "tf", "docs", "total"])

    return df.select(id_col, text_col).mapInArrow(run, f"ids array<{kind}>, sizes array<long>, doc array<int>, term array<int>, tf array<long>, docs long, total long")


def impacts(sizes: np.ndarray, doc: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a posting contributes, but for its term's weight; at most 10^6."""
    m = 25 + (75 * sizes * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])


def bucket(impact: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, (8 * np.log2(np.maximum(impact, 1))).astype(np.int64))


def values(column: pa.Array, row: int, kind=np.int64) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False).astype(kind, copy=False)


def histogram(blocks: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(term, bucket, n, top): postings and the largest impact of each bucket of impacts of each term; summed up in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, top = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                doc, term, tf = (values(b.column(k), i) for k in (1, 2, 3))
                imp = impacts(values(b.column(0), i), doc, tf, n_docs, n_terms)
                keys = np.concatenate([key, term * BUCKETS + bucket(imp)])
                key, at = np.unique(keys, return_inverse=True)
                n = np.bincount(at, np.concatenate([n, np.ones(len(imp), np.int64)]), len(key)).astype(np.int64)
                most, all_tops = np.zeros(len(key), np.int64), np.concatenate([top, imp])
                np.maximum.at(most, at, all_tops)
                top = most
        yield pa.RecordBatch.from_arrays([pa.array((key // BUCKETS).astype(np.int32)), pa.array((key % BUCKETS).astype(np.int32)), pa.array(n), pa.array(top)], names=["term", "bucket", "n", "top"])

    each = blocks.select("sizes", "doc", "term", "tf").mapInArrow(run, "term int, bucket int, n long, top long")
    return each.groupBy("term", "bucket").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


def limits(histogram: DataFrame) -> DataFrame:
    """(term, df, cut0, res0, cut1, res1): a tier ends at a bucket; the residual is the largest impact below it."""
    down = Window.partitionBy("term").orderBy(F.desc("bucket"))
    whole = Window.partitionBy("term")
    h = histogram.select("*", (F.sum("n").over(down) - F.col("n")).alias("above"), F.sum("n").over(whole).alias("df"))
    cuts = []
    for k, (share, least) in enumerate(TIERS):
        inside = F.col("above") < F.greatest(F.lit(least), F.ceil(F.col("df") * share))
        cuts += [F.min(F.when(inside, F.col("bucket"))).alias(f"cut{k}"), F.coalesce(F.max(F.when(~inside, F.col("top"))), F.lit(0)).alias(f"res{k}")]
    return h.groupBy("term").agg(F.first("df").alias("df"), *cuts)


def tiered(blocks: DataFrame, n_docs: int, n_terms: int, cuts: np.ndarray) -> DataFrame:
    """The index: (block, ids, doc0, term0, impact0, doc1, ...), one row a block, sorted by document in each tier."""
    kind = blocks.schema["ids"].dataType.simpleString()
    names = [f"{c}{k}" for k in range(len(TIERS) + 1) for c in ("doc", "term", "impact")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[] for _ in names]
            for i in range(b.num_rows):
                doc, term, tf = (values(b.column(k), i) for k in (3, 4, 5))
                imp = impacts(values(b.column(2), i), doc, tf, n_docs, n_terms)
                tier = (bucket(imp)[:, None] < cuts[term]).sum(1)
                for k in range(len(TIERS) + 1):
                    for c, x in enumerate((doc, term, imp)):
                        out[3 * k + c].append(x[tier == k].astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.list_(pa.int32())) for x in out)], names=["block", "ids", *names])

    source = blocks.select(F.monotonically_increasing_id().alias("block"), "ids", "sizes", "doc", "term", "tf")
    return source.mapInArrow(run, f"block long, ids {kind}, {', '.join(f'{n} array<int>' for n in names)}")


class Matrix:
    """Some items: their terms, and the weight times the occurrences of each term of each item."""

    def __init__(self, numbers: list[int], items: list[dict[int, int]], residual: np.ndarray):
        self.numbers = np.array(numbers, np.int32)
        self.terms = np.array(sorted({t for x in items for t in x}), np.int64)
        self.weights = np.zeros((len(items), len(self.terms)), np.int64)
        for i, x in enumerate(items):
            for t, w in x.items():
                self.weights[i, np.searchsorted(self.terms, t)] = w
        self.residual = residual[self.terms]
        self.rest = self.weights @ self.residual
        self.kind = np.float64 if int(self.weights.sum(1).max()) * 2_000_000 < _EXACT else np.int64
        self.weights = self.weights.astype(self.kind)

    def bounds(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n: int) -> np.ndarray:
        """The most that each of ``n`` documents may score for each item."""
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        ours = self.terms[at] == term
        at, doc, gain = at[ours], doc[ours], impact[ours] - self.residual[at[ours]]
        total = np.repeat(self.rest[:, None], n, 1)
        used, at = np.unique(at, return_inverse=True)
        for begin in range(0, len(used), TERMS):
            here = (at >= begin) & (at < begin + TERMS)
            block = np.zeros((len(used[begin : begin + TERMS]), n), self.kind)
            block[at[here] - begin, doc[here]] = gain[here]
            total += (self.weights[:, used[begin : begin + TERMS]] @ block).astype(np.int64)
        return total


def matrices(items: dict[int, dict[int, int]], residual: np.ndarray) -> list[Matrix]:
    numbers = list(items)
    return [Matrix(part, [items[i] for i in part], residual) for part in (numbers[k : k + MATRIX_ITEMS] for k in range(0, len(numbers), MATRIX_ITEMS))]


def best_bounds(index: DataFrame, items: dict[int, dict[int, int]], residual: np.ndarray, tiers: int, keep: int) -> DataFrame:
    """(item, id, block, doc, bound): the ``keep`` documents of largest bound above 0 of each item, from the first ``tiers`` tiers."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    columns = [f"{c}{k}" for k in range(tiers) for c in ("doc", "term", "impact")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = matrices(items, residual)
        best = [None] * len(held)
        for b in batches:
            for i in range(b.num_rows):
                ids = b.column(1)[i].values
                order = pc.sort_indices(ids).to_numpy()
                place = np.empty(len(ids), np.int64)
                place[order] = np.arange(len(ids))  # ties go to the smaller id
                doc, term, imp = (np.concatenate([values(b.column(2 + 3 * k + c), i) for k in range(tiers)]) for c in range(3))
                doc = place[doc]
                by_doc = np.argsort(doc, kind="stable")
                doc, term, imp = doc[by_doc], term[by_doc], imp[by_doc]
                for m, matrix in enumerate(held):
                    for begin in range(0, len(ids), COLUMNS):
                        n = min(COLUMNS, len(ids) - begin)
                        lo, hi = np.searchsorted(doc, [begin, begin + n])
                        found = matrix.bounds(doc[lo:hi] - begin, term[lo:hi], imp[lo:hi], n)
                        best[m] = merge(best[m], found, ids.take(pa.array(order[begin : begin + n])), b.column(0)[i].as_py(), order[begin : begin + n])
        for matrix, found in zip(held, best, strict=True):
            if found is not None and found.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(matrix.numbers[found.column("row").to_numpy()]), *(found.column(c).combine_chunks() for c in ("id", "block", "doc", "bound"))], names=["item", "id", "block", "doc", "bound"])

    def merge(old: pa.Table | None, bounds: np.ndarray, ids: pa.Array, block: int, docs: np.ndarray) -> pa.Table:
        """The best rows of each item among those held and a matrix of bounds, whose columns ascend by id."""
        n = bounds.shape[1]
        row, col = np.nonzero(bounds > 0)
        if n > keep:
            least = -np.partition(-bounds, keep - 1, axis=1)[:, keep - 1]
            if old is not None:
                least = np.maximum(least, floor(old, len(bounds)))
            row, col = np.nonzero((bounds > 0) & (bounds >= least[:, None]))
        new = pa.table({"row": pa.array(row), "id": ids.take(pa.array(col)), "block": pa.array(np.full(len(row), block)), "doc": pa.array(docs[col].astype(np.int32)), "bound": pa.array(bounds[row, col])})
        both = new if old is None else pa.concat_tables([old, new])
        both = both.take(pc.sort_indices(both, sort_keys=[("row", "ascending"), ("bound", "descending"), ("id", "ascending"), ("block", "ascending"), ("doc", "ascending")]))
        rows = both.column("row").to_numpy()
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        return both.filter(pa.array(rank < keep))

    def floor(old: pa.Table, n: int) -> np.ndarray:
        """The bound that a row must reach to be among the best of its item."""
        rows, bound = old.column("row").to_numpy(), old.column("bound").to_numpy()
        full = np.bincount(rows, minlength=n) >= keep
        np.minimum.at(out := np.full(n, np.iinfo(np.int64).max), rows, bound)
        return np.where(full, out, 0)

    each = index.select("block", "ids", *columns).mapInArrow(run, f"item int, id {kind}, block long, doc int, bound long")
    salt = F.pmod(F.xxhash64("block"), F.lit(64))
    for keys in ([F.col("item"), salt], [F.col("item")]):  # no task ranks what all tasks have found for an item
        order = Window.partitionBy(*keys).orderBy(F.desc("bound"), F.asc_nulls_last("id"), "block", "doc")
        each = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    return each


def exact_scores(index: DataFrame, pool: DataFrame, items: dict[int, dict[int, int]]) -> DataFrame:
    """(item, id, block, doc, bound, place, score) of the rows of ``pool``, whose number the items bound: all tiers, in the blocks that hold them."""
    tiers = len(TIERS) + 1
    columns = [f"{c}{k}" for k in range(tiers) for c in ("doc", "term", "impact")]
    wanted = pool.groupBy("block").agg(F.collect_list(F.struct("item", "doc")).alias("pairs"))
    joined = index.select("block", *columns).join(F.broadcast(wanted), "block").select("block", "pairs", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                doc, term, imp = (np.concatenate([values(b.column(2 + 3 * k + c), i) for k in range(tiers)]) for c in range(3))
                order = np.argsort(doc, kind="stable")
                doc, term, imp = doc[order], term[order], imp[order]
                pairs = b.column(1)[i].values
                item, at = pairs.field("item").to_pylist(), pairs.field("doc").to_pylist()
                score = []
                for q, d in zip(item, at, strict=True):
                    lo, hi = np.searchsorted(doc, [d, d + 1])
                    score.append(sum(items[q].get(t, 0) * x for t, x in zip(term[lo:hi].tolist(), imp[lo:hi].tolist(), strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array([b.column(0)[i].as_py()] * len(item), pa.int64()), pa.array(at, pa.int32()), pa.array(score, pa.int64())], names=["item", "block", "doc", "score"])

    return pool.join(F.broadcast(joined.mapInArrow(run, "item int, block long, doc int, score long")), ["item", "block", "doc"])


def search(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score, tier) for the ``k`` best documents of each item; ``tier``: the last one that its proof needed."""
    spark = df.sparkSession
    ship(spark)
    kinds = items.schema[item_col].dataType.simpleString(), df.schema[id_col].dataType.simpleString()
    out = spark.createDataFrame([], f"{item_col} {kinds[0]}, rank int, {id_col} {kinds[1]}, score long, tier int")
    with scratch(spark) as result:
        for held in passes(items, item_col, query_col):
            found = written(spark, _search_pass(df, id_col, text_col, held, k), "found")
            names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(held)], f"item int, item_id {kinds[0]}")
            out = out.unionAll(found.join(F.broadcast(names), "item").select("item_id", "rank", "id", "score", "tier"))
        return result(out, "ranked")


def _search_pass(df: DataFrame, id_col: str, text_col: str, held: list[tuple[object, Counter]], k: int) -> DataFrame:
    """(item, rank, id, score, tier) for the items of one pass, named by their places."""
    spark = df.sparkSession
    vocabulary = sorted({t for _, terms in held for t in terms})
    place = {t: i for i, t in enumerate(vocabulary)}
    blocks = written(spark, counted(df, id_col, text_col, vocabulary), "counted")
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    tiers = len(TIERS) + 1
    cuts, residual = np.zeros((len(vocabulary), tiers - 1), np.int64), np.zeros((tiers, len(vocabulary)), np.int64)
    weight = {}
    for r in limits(histogram(blocks, n_docs, n_terms)).toLocalIterator() if n_docs else ():
        weight[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
        for t in range(tiers - 1):
            cuts[r["term"], t], residual[t, r["term"]] = r[f"cut{t}"], r[f"res{t}"]
    wanted = {i: {place[t]: weight[place[t]] * c for t, c in terms.items() if weight.get(place[t], 0) > 0} for i, (_, terms) in enumerate(held)}
    wanted = {i: terms for i, terms in wanted.items() if terms}
    kind = df.schema[id_col].dataType.simpleString()
    done = spark.createDataFrame([], f"item int, rank int, id {kind}, score long, tier int")
    if not wanted:
        return done
    index = written(spark, tiered(blocks, n_docs, n_terms, cuts), "index")
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "block", "doc")
    for tier in range(tiers):
        last = tier == tiers - 1
        best = best_bounds(index, wanted, residual[tier], tier + 1, k if last else POOL + 1)
        if last:
            return done.unionAll(best.select("item", F.col("place").alias("rank"), "id", F.col("bound").alias("score"), F.lit(tier).alias("tier")))
        best = written(spark, best, "bounds")
        scored = written(spark, exact_scores(index, best.where(F.col("place") <= POOL), wanted).withColumn("rank", F.row_number().over(by_score)), "scored")
        outside = best.where(F.col("place") > POOL).select("item", F.col("bound").alias("outside"))
        proof = scored.where((F.col("rank") == k) & (F.col("score") > 0)).select("item", F.col("score").alias("least"))
        proven = best.select("item").distinct().join(outside, "item", "left").join(proof, "item", "left").where("outside IS NULL OR least > outside").select("item")
        proven = written(spark, proven, "proven")
        done = done.unionAll(scored.join(proven, "item").where((F.col("rank") <= k) & (F.col("score") > 0)).select("item", "rank", "id", "score", F.lit(tier).alias("tier")))
        closed = {r[0] for r in proven.toLocalIterator()}
        wanted = {i: terms for i, terms in wanted.items() if i not in closed}
        if not wanted:
            return done
    return done
