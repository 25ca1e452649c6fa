"""Operator 4: near-duplicate documents by circulant MinHash.

1. One pass over the texts gives each document its set of word shingles as
   64-bit hashes, a key of the whole set, and a MinHash signature from *two*
   permutations: ``sigma`` places each shingle in the universe, and ``pi``,
   circularly shifted by 0, 1, 2, ... places, gives all coordinates. A
   shingle's values are a contiguous slice of ``pi``, so a signature is the
   minimum of slices. Signatures are cut into bands.
2. Documents with equal sets are one class; only its smallest id goes on.
3. Documents that share a band are candidates. In each band's bucket all
   members are compared with the bucket's smallest id, and links found are
   joined to components. Buckets of more than ``HOT`` members get their
   smallest id by broadcast (while there are at most ``HOT_KEYS`` such buckets;
   beyond, by joins that split large keys), so no task takes a large bucket.
4. Buckets whose members then lie in several components are finished exactly,
   each on its own, so texts that only chain through others never meet: a large
   bucket is dealt into blocks, a large component's members into blocks of their
   own, and two blocks are a tile, unless both are of one component; small
   buckets share tiles. A tile holds signatures, a byte a coordinate, not sets,
   and passes on the members that have a partner of another component whose
   size allows a link and whose signature agrees in at least ``AGREE`` of its
   places. Their tiles are then made again, with the full sets.
5. Pairs that pass that filter (those of step 3 go through it, too) are compared
   on their full sets by exact Jaccard similarity. What leaves a tile are links
   that join two components, one for each two, never all pairs.

With 60 bands of 8 coordinates a pair at the threshold of 0.8 shares a band
with probability 1 - (1 - 0.8^8)^60 > 0.99998, above 0.85 > 0.9999999, and its
480 coordinates agree in less than ``AGREE`` of 480 places (7 standard
deviations off) with a probability under 10^-11. Of texts at 0.5, such as share
their boilerplate, about one pair in five shares a bucket and none is compared
on full sets.

Defined cases: null or blank texts have an empty set and link with nothing;
with fewer words than a shingle has, the whole sequence is one shingle; ties
go to the smallest id; rows with one id are one document in links, and all of
them are kept or none; a row without an id links with nothing, has no component
and is kept; an empty table gives an empty one; other columns of the input are
left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import few, scratch, ship, text_bytes, written
from tessera.llm.components import components
from tessera.llm.lexicon import slices, split_words

#: Bands, coordinates in a band, and size of the permuted universe.
BANDS, ROWS, UNIVERSE = 60, 8, 1 << 20
#: Members of a bucket that is joined by broadcast, and how many such buckets may be.
HOT, HOT_KEYS = 200, 100_000
#: Documents and shingles of a block of a tile, and of the small buckets that share a tile, on average at most.
BLOCK, BLOCK_SHINGLES, SHARED, SHARED_SHINGLES = 1024, 500_000, 8192, 1_000_000
#: Share of coordinates that must agree before full sets are compared, for the threshold of 80 %; it moves with other ones.
AGREE = 0.67
#: Pairs of one document that are compared in one group.
GROUP = 200
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@cache
def factors(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def permutations() -> tuple[np.ndarray, np.ndarray]:
    """sigma, and the windows of pi: row ``i`` holds pi at i, i + 1, ..., around the circle."""
    rng = np.random.default_rng(20_240_501)
    sigma, pi = rng.permutation(UNIVERSE).astype(np.int32), rng.permutation(UNIVERSE).astype(np.uint32)
    return sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: BANDS * ROWS - 1]]), BANDS * ROWS)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingles, as 64-bit hashes."""
    import xxhash

    words, codes, offsets = split_words(texts, lower=True)
    by_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    w, f = by_word[codes], factors(width, 7)
    total = np.zeros(max(0, len(w) - width + 1), np.uint64)
    for k in range(width):
        total += w[k : k + len(total)] * f[k]
    total = mixed(total)
    for begin, end in zip(offsets[:-1], offsets[1:], strict=True):
        if end - begin >= width:
            yield np.unique(total[begin : end - width + 1].view(np.int64))
        elif end > begin:
            part = w[begin:end]
            yield mixed(np.array([len(part)], np.uint64) * MIX + (part * f[: len(part)]).sum(dtype=np.uint64, keepdims=True)).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def signature(shingles: np.ndarray) -> np.ndarray:
    sigma, windows = permutations()
    at = sigma[shingles.view(np.uint64) >> np.uint64(44)]
    return np.min([windows[at[i : i + 2048]].min(0) for i in range(0, len(at), 2048)], axis=0)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is part of it."""
    x = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    x = (mixed(x * MIX) * factors(ROWS, 11)).sum(axis=2, dtype=np.uint64)
    return mixed(x + np.arange(1, BANDS + 1, dtype=np.uint64) * MIX).view(np.int64)


def sketches(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n_shingles, k1, k2, bands, signature): the set's size, 128-bit key, band keys, and a byte of each coordinate; no bands for an empty set."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for start, part in slices(text_bytes(b.column(1))):
                sets = list(shingle_sets(part, width))
                sizes = np.array([len(s) for s in sets], np.int64)
                keys = np.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "S16")
                keys = np.frombuffer(b"".join(x.ljust(16, b"\0") for x in keys.tolist()), np.int64).reshape(-1, 2)
                signatures = np.array([signature(s) for s in sets if len(s)], np.uint32).reshape(-1, BANDS * ROWS)
                bands, low = band_keys(signatures), iter((mixed(signatures.astype(np.uint64)) & np.uint64(255)).astype(np.uint8))
                ends = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(part)), pa.array(sizes), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel())), pa.array([next(low).tobytes() if len(s) else None for s in sets], pa.binary())], names=["id", "n_shingles", "k1", "k2", "bands", "signature"])

    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_shingles long, k1 long, k2 long, bands array<long>, signature binary")


def full_sets(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, shingles): the sets themselves, as sorted arrays; none for an empty one, which another row of its id may have."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in slices(text_bytes(b.column(1))):
                found = list(shingle_sets(part, width))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                sets = pa.RecordBatch.from_arrays([b.column(0).slice(start, len(part)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], names=["id", "shingles"])
                yield sets.filter(pa.array([len(x) > 0 for x in found], pa.bool_()))

    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, shingles array<long>")


def beside(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """(a, b, x, y): the values of a and b beside each pair. A document of many pairs is dealt out: one copy of its value for ``GROUP`` of them."""
    spark = pairs.sparkSession
    out = pairs.select("a", "b")
    for end, name, other in (("a", "x", "b"), ("b", "y", "a")):
        named = table.select(F.col("id").alias(end), F.col(value).alias(name))
        many = written(spark, out.groupBy(end).count().where(F.col("count") > GROUP).select(end, F.ceil(F.col("count") / GROUP).cast("int").alias("parts")), "many")
        if many.isEmpty():
            out = out.join(named, end)
            continue
        salt = F.pmod(F.xxhash64(other), F.col("parts")).cast("int")
        dealt = out.join(many, end, "left").withColumn("part", F.coalesce(salt, F.lit(0))).drop("parts")  # adaptive joins split large keys; rows are narrow here
        copies = named.join(many, end, "left").select(end, name, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        out = dealt.join(copies, [end, "part"]).drop("part")
    return out.select("a", "b", "x", "y")


def _kept(joined: DataFrame, good) -> DataFrame:
    kind = joined.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [good(x, y) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        pa.default_memory_pool().release_unused()

    return joined.mapInArrow(run, f"a {kind}, b {kind}")


def same_enough(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of sorted sets."""
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on full sets."""

    return _kept(beside(pairs, sets, "shingles"), lambda x, y: same_enough(x.values.to_numpy(), y.values.to_numpy(), percent))


def least_agreeing(percent: int) -> int:
    """How many coordinates of a pair must agree: ``0.8 - AGREE`` of them fewer than the threshold lets expect, over five standard deviations for any threshold."""
    return int(BANDS * ROWS * (percent / 100 - (0.8 - AGREE)))


def agreeing(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree well enough to be compared on full sets."""
    least = least_agreeing(percent)

    def good(x: pa.Scalar, y: pa.Scalar) -> bool:
        return int((np.frombuffer(x.as_buffer(), np.uint8) == np.frombuffer(y.as_buffer(), np.uint8)).sum()) >= least

    return _kept(beside(pairs, signatures, "signature"), good)


def partners(i: int, signatures: np.ndarray, sizes: np.ndarray, labels: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Rows of ``right`` of another label than row ``i`` that its size and signature let through."""
    near = right[(labels[right] != labels[i]) & (np.minimum(sizes[right], sizes[i]) * 100 >= np.maximum(sizes[right], sizes[i]) * percent)]
    least, out = least_agreeing(percent), [np.zeros(0, np.int64)]
    for part in (near[n : n + 4096] for n in range(0, len(near), 4096)):
        out.append(part[(signatures[part] == signatures[i]).sum(1) >= least])
    return np.concatenate(out)


def links_in_tile(sets: list[np.ndarray], signatures: np.ndarray, sizes: np.ndarray, labels: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links between rows (one of ``left``, one of ``right``) of different labels, one for each two labels that are not joined by earlier ones."""
    labels = labels.copy()
    for i in left:
        for j in partners(i, signatures, sizes, labels, right, percent):
            if labels[i] != labels[j] and same_enough(sets[i], sets[j], percent):
                yield i, j
                labels[labels == labels[j]] = labels[i]


def tiles(docs: DataFrame) -> DataFrame:
    """(id, n, c, h, tile, side): what members (h, id, n, c) of buckets go to which tiles; ``side`` is 0, 1, or 2 for both.

    A component with ``BLOCK`` members or more in a bucket has blocks of its own, which are not compared with each other; smaller ones share blocks.
    """
    spark = docs.sparkSession
    parts = docs.groupBy("h", "c").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    parts = parts.withColumn("own", F.when(F.col("m") >= BLOCK, F.col("c")))
    size = F.greatest(F.ceil(F.sum("m") / BLOCK), F.ceil(F.sum("s") / BLOCK_SHINGLES)).cast("int")
    blocks = written(spark, parts.groupBy("h", "own").agg(F.sum("m").alias("m"), F.sum("s").alias("s"), size.alias("blocks")), "blocks")
    buckets = blocks.groupBy("h").agg(F.sum("blocks").alias("all_blocks"), F.sum("m").alias("m"), F.sum("s").alias("s"))
    small, large = (written(spark, buckets.where(c), "buckets") for c in ("all_blocks = 1", "all_blocks > 1"))
    rows, shingles = small.agg(F.sum("m"), F.sum("s")).first()
    packs = max(64, (rows or 0) // SHARED, (shingles or 0) // SHARED_SHINGLES)
    out = docs.join(small.select("h"), "h", "left_semi").select("id", "n", "c", "h", F.pmod(F.xxhash64("h", F.lit(7)), F.lit(packs)).alias("tile"), F.lit(2).alias("side"))
    if large.isEmpty():
        return out
    number = lambda own, k: F.xxhash64("h", own.isNull(), own, k)
    own = parts.where("own IS NOT NULL").select("h", "c", "own")
    dealt = docs.join(large.select("h"), "h", "left_semi").join(own, ["h", "c"], "left")
    count = blocks.select("h", F.coalesce(F.col("own").cast("string"), F.lit("")).alias("o"), "blocks")
    dealt = dealt.withColumn("o", F.coalesce(F.col("own").cast("string"), F.lit(""))).join(count, ["h", "o"])
    dealt = dealt.select("id", "n", "c", "h", number(F.col("own"), F.pmod(F.xxhash64("id"), "blocks").cast("int")).alias("block"))
    each = blocks.join(large.select("h"), "h", "left_semi").select("h", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    each = each.select("h", "own", number(F.col("own"), F.col("k")).alias("block"))
    left, right = each.select("h", F.col("own").alias("x"), F.col("block").alias("lo")), each.select("h", F.col("own").alias("y"), F.col("block").alias("hi"))
    pairs = left.join(right, "h").where((F.col("lo") <= F.col("hi")) & F.coalesce(F.col("x") != F.col("y"), F.lit(True)))
    pairs = pairs.select("h", "lo", "hi", F.xxhash64("h", "lo", "hi").alias("tile"))
    sides = pairs.select("h", "tile", F.when(F.col("lo") == F.col("hi"), 2).otherwise(0).alias("side"), F.col("lo").alias("block"))
    sides = sides.unionAll(pairs.where("lo != hi").select("h", "tile", F.lit(1).alias("side"), F.col("hi").alias("block")))
    return out.unionByName(dealt.join(sides, ["h", "block"]).select("id", "n", "c", "h", "tile", "side"))


def _buckets(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left, right) rows of each bucket of a tile, which is sorted by bucket."""
    h, side = t.column("h").to_numpy(), t.column("side").to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    for lo, hi in zip(starts, [*starts[1:], len(h)], strict=True):
        yield lo + np.flatnonzero(side[lo:hi] != 1), lo + np.flatnonzero(side[lo:hi] != 0)


def _columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    signatures = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(len(t), -1)
    return signatures, t.column("n").to_numpy(), t.column("c").combine_chunks().dictionary_encode().indices.to_numpy()


def links_in_buckets(docs: DataFrame, signatures: DataFrame, sets_of, percent: int) -> DataFrame:
    """Links (a, b) that join different components of members (h, id, n, c) of one bucket; ``sets_of`` gives the sets of a table of ids."""
    spark, kind = docs.sparkSession, docs.schema["id"].dataType.simpleString()
    by_bucket = lambda t: t.take(pa.array(np.argsort(t.column("h").to_numpy(), kind="stable")))

    def look(t: pa.Table) -> pa.Table:
        t = by_bucket(t)
        columns, taken = _columns(t), np.zeros(len(t), bool)
        for left, right in _buckets(t):
            for i in left:
                found = partners(i, *columns, right, percent)
                taken[found] = True
                taken[i] |= len(found) > 0
        found = t.select(["h", "id"]).filter(pa.array(taken))
        pa.default_memory_pool().release_unused()  # workers are kept, and other stages need the memory
        return found

    def join(t: pa.Table) -> pa.Table:
        t = by_bucket(t)
        columns, sets, ids = _columns(t), [x.values.to_numpy() for x in t.column("shingles")], t.column("id")
        pairs = [p for left, right in _buckets(t) for p in links_in_tile(sets, *columns, left, right, percent)]
        pa.default_memory_pool().release_unused()
        return pa.table({k: ids.take(pa.array([p[n] for p in pairs], pa.int64())) for n, k in enumerate("ab")})

    met = tiles(docs).join(signatures, "id").groupBy("tile").applyInArrow(look, f"h long, id {kind}")
    met = written(spark, docs.join(met.distinct(), ["h", "id"], "left_semi"), "met")
    if met.isEmpty():
        return spark.createDataFrame([], f"a {kind}, b {kind}")
    sets = sets_of(met.select("id").distinct())
    return written(spark, tiles(met).join(signatures, "id").join(sets, "id").groupBy("tile").applyInArrow(join, f"a {kind}, b {kind}"), "more")


def hot_keys(table: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys of more than ``HOT`` rows in a table of counts ``m``, or None if there are none or too many to broadcast."""
    hot = table.where(F.col("m") > HOT).select(keys)
    return hot if 0 < hot.limit(HOT_KEYS + 1).count() <= HOT_KEYS else None


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """``rows`` joined with a table of one row a key, where a key may hold any share of the rows: hot ones by broadcast."""
    if hot is None:
        return rows.join(table, keys)  # adaptive skew joins split large keys
    large = F.broadcast(table.join(F.broadcast(hot), keys, "left_semi"))
    joined = rows.join(large, keys).unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys))
    return joined.hint("rebalance")  # the first part has as many partitions as texts were read in, each with few rows


def repeated_ids(sketched: DataFrame) -> DataFrame | None:
    """(id, several, mixed) of the ids of more than one row, or None: whether they have several sets, and an empty one beside others."""
    spark = sketched.sparkSession
    full = F.col("n_shingles") > 0
    ends = [f(F.when(full, F.col(k))).alias(f"{n}{k}") for k in ("k1", "k2") for f, n in ((F.min, "low_"), (F.max, "high_"))]
    counted = sketched.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("m"), F.count(F.when(full, 1)).alias("full"), *ends).where("m > 1")
    out = written(spark, counted.select("id", F.coalesce(F.expr("low_k1 != high_k1 OR low_k2 != high_k2"), F.lit(False)).alias("several"), F.expr("full BETWEEN 1 AND m - 1").alias("mixed")), "repeated")
    return None if out.isEmpty() else out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row."""
    spark = df.sparkSession
    ship(spark)
    with scratch(spark) as result:
        sketched = written(spark, sketches(df, id_col, text_col, width), "sketches")
        usable = sketched.where("n_shingles > 0 AND id IS NOT NULL")
        classes = written(spark, usable.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("m")), "classes")
        copied = hot_keys(classes, ["k1", "k2"])
        repeated = repeated_ids(sketched)
        reps = usable.join(classes.select(F.col("rep").alias("id"), "k1", "k2"), ["id", "k1", "k2"], "left_semi")
        if repeated is not None:
            reps = reps.dropDuplicates(["id", "k1", "k2"])
        reps = reps.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("h"))
        buckets = reps.groupBy("h").agg(F.min(F.struct("id", "n")).alias("first"), F.max("id").alias("last"), F.count("*").alias("m")).where("first.id != last")
        buckets = written(spark, buckets.select("h", F.col("first.id").alias("leader"), F.col("first.n").alias("leader_n"), "m"), "buckets")
        hot = hot_keys(buckets, ["h"])
        members = written(spark, join_hot(reps, buckets.drop("m"), ["h"], hot), "members")
        fits = F.least("n", "leader_n") * 100 >= F.greatest("n", "leader_n") * percent
        first = members.where(F.col("id") != F.col("leader")).where(fits).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
        wanted = written(spark, members.select("id").distinct(), "wanted")
        signatures = written(spark, usable.join(few(wanted), "id", "left_semi").join(classes.select(F.col("rep").alias("id"), "k1", "k2"), ["id", "k1", "k2"], "left_semi").dropDuplicates(["id", "k1", "k2"]).select("id", "signature"), "signatures")
        texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

        def sets_of(ids: DataFrame) -> DataFrame:
            part = texts.join(few(written(spark, ids, "part")), "id", "left_semi")
            if repeated is not None:
                part = part.dropDuplicates(["id", "text"])
            return written(spark, full_sets(part, "id", "text", width), "sets")

        first = written(spark, agreeing(first, signatures, percent), "pairs")
        links = written(spark, similar(first, sets_of(first.select(F.explode(F.array("a", "b")).alias("id")).distinct()), percent), "links")
        if repeated is not None:
            several = usable.join(few(repeated.where("several").select("id")), "id", "left_semi").select("id", "k1", "k2").distinct()
            through = join_hot(several, classes.select("rep", "k1", "k2"), ["k1", "k2"], copied).where("rep != id").select(F.col("rep").alias("a"), F.col("id").alias("b"))
            links = written(spark, links.unionByName(through), "links")
        label = components(links, "a", "b")
        placed = written(spark, members.select("h", "id", "n").join(label.withColumnRenamed("vertex", "id"), "id", "left").select("h", "id", "n", F.coalesce("label", "id").alias("c")), "placed")
        open_buckets = placed.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high").select("h", F.lit(1).alias("open"))
        involved = written(spark, join_hot(placed, open_buckets, ["h"], hot).select("h", "id", "n", "c").distinct(), "open")
        more = links_in_buckets(involved, signatures, sets_of, percent)
        label = components(links.unionByName(more), "a", "b")
        by_class = classes.join(label.withColumnRenamed("vertex", "rep"), "rep", "left").select("k1", "k2", F.coalesce("label", "rep").alias("component_id"))
        known = sketched.select("id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("k1")).alias("k1"), "k2")
        linked = join_hot(known.where("k1 IS NOT NULL"), by_class, ["k1", "k2"], copied).select("id", "n_shingles", "component_id")
        alone = known.where("k1 IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
        if repeated is not None:
            of_id = linked.join(few(repeated.where("mixed").select("id")), "id", "left_semi").groupBy("id").agg(F.min("component_id").alias("c"))
            alone = alone.join(of_id, "id", "left").select("id", "n_shingles", F.coalesce("c", "component_id").alias("component_id"))
        out = result(linked.unionByName(alone), "near-duplicates")
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
