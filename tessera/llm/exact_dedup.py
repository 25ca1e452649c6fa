"""Operator 11: exact duplicates by counting quotient filters.

1. One pass normalises each text (runs of white space become one space) and
   gives its SHA-256 and a fingerprint.
2. Each partition puts its fingerprints into counting quotient filters: the
   high bits (the quotient) pick a run, the low bits (the remainder) are stored
   in it in ascending order, once, with a count. Nothing is rounded, so filters
   merge without loss: the sorted remainders of equal quotients are merged and
   counts of equal ones added. Filters are cut by the first bits of quotients
   into shards of bounded size, and each shard is merged in a task of its own.
   A text with a third of all rows is one slot of each filter.
3. Rows whose fingerprint counts more than once go to byte verification: their
   normalised texts are grouped by all bytes, combined before the shuffle. A
   fingerprint that turns out to stand for several texts is resolved by these
   groups, so a collision never joins two texts.

Defined cases: a null text is an empty one, and all empty texts are equal; of
equal texts the smallest id stays; rows of that id with the same text are all
marked kept by :func:`exact_duplicates`, and :func:`without_duplicates` leaves
one of them; a row without an id is kept only if no equal text has an id; an
empty table gives an empty one; other columns of the input are left out,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import few, few_keys, scratch, ship, text_bytes, written
from tessera.llm.lexicon import slices

#: Fingerprints that one filter takes, those of a shard on average, and the least number of shards (powers of two).
CAPACITY, SHARD, SHARDS = 1 << 20, 1 << 20, 64
#: A fingerprint is hot if it has more than one in so many of all rows, so at most so many are broadcast.
HOT_KEYS = 100_000
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def normalised(text: bytes) -> bytes:
    """Each run of space, tab, newline, vertical tab, form feed and carriage return as one space."""
    text = text.translate(_SPACES)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


@dataclass
class QuotientFilter:
    """Fingerprints of ``bits`` bits with counts: ``runs[q]`` remainders of quotient ``q``, ascending, in the order of quotients."""

    bits: int
    runs: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @property
    def quotient_bits(self) -> int:
        return len(self.runs).bit_length() - 1

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray, bits: int, least: int = 0) -> QuotientFilter:
        """From ascending distinct fingerprints; about one slot a quotient, and ``least`` quotient bits or more."""
        q = min(bits, max(least, max(1, len(fingerprints)).bit_length() - 1))
        rest = np.uint64(bits - q)
        quotients = fingerprints >> rest if bits > q else fingerprints  # numpy shifts by 64 are undefined, so q = 0 is apart
        if q == 0:
            return cls(bits, np.array([len(fingerprints)]), fingerprints, counts)
        runs = np.bincount(quotients.astype(np.int64), minlength=1 << q)
        return cls(bits, runs, fingerprints & ((np.uint64(1) << rest) - np.uint64(1)), counts)

    @classmethod
    def build(cls, fingerprints: np.ndarray, bits: int, least: int = 0) -> QuotientFilter:
        return cls.of(*np.unique(fingerprints, return_counts=True), bits, least)

    def fingerprints(self) -> np.ndarray:
        """All that were put in, ascending: a filter loses nothing."""
        if self.quotient_bits == 0:
            return self.remainders
        return np.repeat(np.arange(len(self.runs), dtype=np.uint64), self.runs) << np.uint64(self.bits - self.quotient_bits) | self.remainders

    def parts(self, shard_bits: int) -> Iterator[tuple[int, QuotientFilter]]:
        """(number, filter of the rest of the bits) for each value of the first bits that is there."""
        by_shard = self.runs.reshape(1 << shard_bits, -1)
        ends = np.cumsum(by_shard.sum(1))
        for k in np.flatnonzero(by_shard.any(1)):
            lo, hi = ends[k - 1] if k else 0, ends[k]
            yield int(k), QuotientFilter(self.bits - shard_bits, by_shard[k], self.remainders[lo:hi], self.counts[lo:hi])


def merged(filters: list[QuotientFilter]) -> QuotientFilter:
    """One filter with the fingerprints and the summed counts of all: a stable sort merges runs that are sorted already."""
    keys = np.concatenate([f.fingerprints() for f in filters])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([f.counts for f in filters])[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return QuotientFilter.of(keys[first], np.add.reduceat(counts, first), filters[0].bits)


def fingerprints(df: DataFrame, id_col: str, text_col: str, bits: int, bytes_too: bool = False) -> DataFrame:
    """(id, fp, sha) for each row, or (id, fp, norm) with the bytes of its normalised text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for start, part in slices(text_bytes(b.column(1))):
                texts = [normalised(t) for t in part.cast(pa.binary()).to_pylist()]
                fp = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts)) >> np.uint64(64 - bits)
                last = pa.array(texts, pa.binary()) if bytes_too else pa.array([hashlib.sha256(t).hexdigest() for t in texts])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(part)), pa.array(fp.view(np.int64)), last], names=["id", "fp", "norm" if bytes_too else "sha"])

    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, fp long, {'norm binary' if bytes_too else 'sha string'}")


def repeated(fps: DataFrame, total: int, bits: int) -> DataFrame:
    """(fp, m): fingerprints of the one column of ``fps`` that count more than once, by merged filters."""
    shard_bits = min(bits - 1, max(SHARDS.bit_length() - 1, (total // SHARD).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += len(held[-1])
            if n >= CAPACITY:
                yield rows(QuotientFilter.build(np.concatenate(held), bits, shard_bits))
                held, n = [], 0
        if n:
            yield rows(QuotientFilter.build(np.concatenate(held), bits, shard_bits))

    def rows(f: QuotientFilter) -> pa.RecordBatch:
        parts = list(f.parts(shard_bits))
        return pa.RecordBatch.from_pydict({"shard": pa.array([k for k, _ in parts], pa.int32()), "runs": pa.array([p.runs for _, p in parts], pa.list_(pa.int32())), "remainders": pa.array([p.remainders.view(np.int64) for _, p in parts], pa.list_(pa.int64())), "counts": pa.array([p.counts for _, p in parts], pa.list_(pa.int64()))})

    def join(t: pa.Table) -> pa.Table:
        filters = [QuotientFilter(bits - shard_bits, *(np.asarray(x.values) for x in row[:1]), np.asarray(row[1].values).view(np.uint64), np.asarray(row[2].values)) for row in zip(t.column("runs"), t.column("remainders"), t.column("counts"), strict=True)]
        f = merged(filters)
        more = f.counts > 1
        fp = np.uint64(t.column("shard")[0].as_py()) << np.uint64(bits - shard_bits) | f.fingerprints()[more]
        return pa.table({"fp": fp.view(np.int64), "m": f.counts[more]})

    return fps.mapInArrow(build, "shard int, runs array<int>, remainders array<long>, counts array<long>").groupBy("shard").applyInArrow(join, "fp long, m long")


def _attach(rows: DataFrame, table: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` left-joined with a table of one row a fingerprint; the fingerprints of ``hot``, whose number is bounded, by broadcast."""
    large = F.broadcast(table.join(F.broadcast(hot), "fp", "left_semi"))
    return rows.join(large, "fp").unionByName(rows.join(F.broadcast(hot), "fp", "left_anti").join(table, "fp", "left"))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row; fingerprints have ``bits`` bits, which changes no result."""
    spark = df.sparkSession
    ship(spark)
    with scratch(spark) as result:
        rows = written(spark, fingerprints(df, id_col, text_col, bits), "fingerprints")
        total = rows.count()
        twice = written(spark, repeated(rows.select("fp"), total, bits), "repeated")
        hot = twice.where(F.col("m") > max(1000, total // HOT_KEYS)).select("fp")
        wanted = written(spark, _attach(rows.select("id", "fp"), twice, hot).where("m IS NOT NULL").select("id").distinct(), "wanted")
        there = few(wanted).withColumnRenamed("id", "_wanted")
        named = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        texts = fingerprints(named.join(there, F.col("id").eqNullSafe(F.col("_wanted")), "left_semi"), "id", "text", bits, bytes_too=True)
        by_bytes = texts.groupBy("fp", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        groups = written(spark, by_bytes.select("fp", "keep_id", "group_size"), "groups")
        collided = written(spark, groups.groupBy("fp").count().where("count > 1").select("fp"), "collided")
        if collided.isEmpty():
            out = _attach(rows, groups, hot)
        else:  # one fingerprint, several texts: their rows find their group by all bytes
            apart = few(collided)
            own = texts.join(apart, "fp", "left_semi")
            own = own.join(by_bytes.join(apart, "fp", "left_semi"), ["fp", "norm"]).select("fp", "id", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size")
            out = _attach(rows.join(apart, "fp", "left_anti"), groups.join(apart, "fp", "left_anti"), hot).unionByName(own)
        keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
        out = result(out.select("id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "sha"), "exact-duplicates")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("id")).alias("kept"), F.col("sha").alias("text_sha256"))


def without_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, all columns as they were: exactly one row of each text."""
    marked = exact_duplicates(df, id_col, text_col)
    sha, place = (x * (1 + max(map(len, df.columns))) for x in "hn")  # clash with no column
    named = lambda rows: few_keys(rows.select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha")))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col(sha) == F.col("_sha"))
    hashed = df.withColumn(sha, F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[ \\t\\n\\x0B\\f\\r]+", " "), 256))
    rest = hashed.join(named(marked.where("NOT kept").distinct()), same, "left_anti")
    often = named(marked.where("kept").groupBy(id_col, "text_sha256").count().where("count > 1"))
    order = Window.partitionBy(id_col, sha).orderBy(F.xxhash64(*df.columns), *df.columns)
    once = rest.join(often, same, "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return rest.join(often, same, "left_anti").select(df.columns).unionByName(once.select(df.columns))
