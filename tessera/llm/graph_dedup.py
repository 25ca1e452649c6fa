"""Operator 7: near-duplicate vectors by a robust-pruned flat graph.

Only vectors of one label and one length are compared. Equal vectors are one
node, which counts its copies.

1. *Overlapping cluster shards.* The nodes of a label are cut by k-means on a
   bounded sample, and again, until a shard holds at most ``SHARD`` nodes. A
   node goes to its nearest centre's shard, its home, and as a guest to each
   shard whose bisector with its own is within ``OVERLAP`` of half the largest
   distance of a link. (At an overlap of 1 no link could be lost; in many
   dimensions a fraction of it is enough, and the audit tells.) Guests are asked
   for by sketches of ``BITS`` signs before any vector moves: only those stay
   whose sketch is near that of a node at home there, and a link passes that
   test but for ``DEVIATIONS`` standard deviations. So rows of shards follow the
   nodes and their links, however often they are cut; a cut that still makes
   more than ``GROWS`` times its rows is not made.
2. *Flat graph.* In each shard every node gets robust-pruned neighbours: all
   nodes within range of a link, pruned with factor 1 and without a limit, and
   up to ``DEGREE`` more of its nearest others, pruned with factor ``ALPHA``.
3. *Union.* A node's adjacency lists from all its shards are united.
4. *Search.* In its home shard each node is searched for: a greedy walk from
   the shard's medoid, then range expansion over all nodes within twice the
   angle of a link. That finds every link of the shard: if ``x`` is linked
   with ``q`` and no neighbour of ``q``, it was pruned for a neighbour that
   is nearer to ``x``, which is linked with ``x`` in turn, and so on, and all
   of these lie within twice the angle.
5. *Verification* by cosine in double precision. What leaves a shard is one
   row a node, with the number of its links and one edge to a representative
   of its linked nodes, never the pairs.
6. *Audit.* A sample of nodes, spread over labels and growing with their
   number, is compared with all nodes of their labels. If fewer than ``AUDIT``
   of the links were found, all labels that were cut into several shards are
   worked out again by exact tiles. Labels of one shard are exact already, so
   the result is then exact throughout.

A shard that k-means can't cut (its nodes are all near each other) is worked
out by exact tiles of bounded blocks, with the same output; so no task takes
an unbounded group, whatever its label.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without a label or id, link with nothing and stand for
themselves; labels of any type are compared as text; vectors of different
lengths are compared with none of each other; rows of one id are one node's
copies only if equal; an empty table gives an empty one; other columns of the
input are left out, whatever their names.
"""

from __future__ import annotations

import itertools
import logging
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import few, few_keys, scratch, ship, written
from tessera.llm.components import components
from tessera.llm.nearest import usable

#: Nodes of a shard at most; shards a cut makes at most; sampled nodes for each; cuts of one node at most.
SHARD, FANOUT, SAMPLED, DEPTH = 1500, 64, 24, 9
#: How far shards overlap; a cut that leaves a shard of more than this share of its parent has failed.
OVERLAP, SHRINKS = 0.4, 0.8
POOL, DEGREE, ALPHA = 64, 24, 1.2
#: Least recall; nodes that are audited: one a label, no fewer than the first and no more than the second number.
AUDIT, AUDITED, MOST_AUDITED = 0.999, 200, 2000
#: Rows on each side of an exact tile, on average at most; rows dealt to shards at once.
TILE, DEAL = 8192, 4096
#: Signs of a sketch, how far from its mean a link's sketch may be, and sketches on each side of a block that compares them.
BITS, DEVIATIONS, MEET = 128, 5.5, 32768
#: Rows that a cut may make of one; nodes of a cell whose guests all stay, since its next shards are its last.
GROWS, PLAIN = 3, 2048
#: Rows of a cut that need no proof of use.
STAYS = "home OR sketch IS NULL"
#: Neighbours that are looked up at once.
STEP = 1 << 18
NAMES = ["label", "path", "parent", "home", "id", "copies", "v"]
COUNTS = "id long, others long, root long"
log = logging.getLogger(__name__)


def node_of(vectors: str) -> str:
    return f"label string, path long, parent long, home boolean, id long, copies long, v {vectors}"


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """Vectors as rows in double precision; tables hold them as they came."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


# --- shards ---


def centres(sample: np.ndarray, count: int) -> np.ndarray:
    """A few rounds of spherical k-means from the first rows of a sample in random order."""
    c = sample[:count].copy()
    for _ in range(4):
        near = (sample @ c.T).argmax(1)
        for k in range(len(c)):
            if (mean := sample[near == k].sum(0)).any():
                c[k] = mean / np.linalg.norm(mean)
    return c


def guests(near: np.ndarray, c: np.ndarray, least: float, overlap: float = OVERLAP) -> np.ndarray:
    """Whether each row, given its products with the centres, goes to each centre's shard (its own among them)."""
    home, squares = near.argmax(1), (c * c).sum(1)
    apart = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * c @ c.T, 0))
    gap = near[np.arange(len(near)), home][:, None] - near
    return gap <= (overlap * np.sqrt(2 - 2 * least) / 2 + 1e-6) * apart[home] + 1e-6


@cache
def planes(dimensions: int) -> np.ndarray:
    return np.random.default_rng(17).standard_normal((dimensions, BITS))


def sketch(u: np.ndarray) -> np.ndarray:
    """The signs of each row's products with random planes, as unsigned 64-bit numbers (bits of signed ones are counted by absolute value)."""
    return np.packbits(u @ planes(u.shape[1]) > 0, axis=1).view(np.uint64)


def most_apart(least: float) -> int:
    """Signs in which the sketches of a link differ at most."""
    share = np.arccos(np.clip(least, -1, 1)) / np.pi
    return int(BITS * share + DEVIATIONS * np.sqrt(BITS * share * (1 - share)))


def met(asked: np.ndarray, homes: np.ndarray, least: float) -> np.ndarray:
    """Which of the sketches ``asked`` are near one of ``homes``."""
    out, most = np.zeros(len(asked), bool), most_apart(least)
    for i in range(0, len(asked), 256):
        part = asked[i : i + 256]
        for j in range(0, len(homes), 4096):
            apart = sum(np.bitwise_count(part[:, k, None] ^ homes[None, j : j + 4096, k]).astype(np.uint16) for k in range(part.shape[1]))
            out[i : i + 256] |= (apart <= most).any(1)
    return out


def useful(dealt: DataFrame, least: float) -> DataFrame:
    """(label, path, id) of the guests in ``dealt`` with sketches, where these are near that of a node at home there; only sketches move, in blocks."""
    spark = dealt.sparkSession
    dealt = dealt.where("sketch IS NOT NULL")
    sizes = dealt.groupBy("label", "path").agg(F.ceil(F.count_if("home") / MEET).cast("int").alias("homes"), F.ceil(F.count_if(~F.col("home")) / MEET).cast("int").alias("guests"))
    rows = dealt.select("label", "path", "home", "id", "sketch").join(few_keys(written(spark, sizes.where("homes > 0 AND guests > 0"), "sizes")), ["label", "path"])
    block = lambda count, seed: F.pmod(F.xxhash64("id", F.lit(seed)), count).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    ours = rows.where("home").select("label", "path", block(F.col("homes"), 29).alias("r"), each("guests").alias("c"), "home", "id", "sketch")
    theirs = rows.where("NOT home").select("label", "path", each("homes").alias("r"), block(F.col("guests"), 31).alias("c"), "home", "id", "sketch")

    def run(t: pa.Table) -> pa.Table:
        home = t.column("home").to_numpy()
        signs = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(t), -1)
        asked = np.flatnonzero(~home)
        return t.select(["label", "path", "id"]).take(pa.array(asked[met(signs[asked], signs[home], least)]))

    return written(spark, ours.unionAll(theirs).groupBy("label", "path", "r", "c").applyInArrow(run, "label string, path long, id long").distinct(), "useful")


def cut(cells: DataFrame, nodes: DataFrame, sizes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The rows of the cells in ``sizes``, dealt to the shards of the next level, and (label, path) of those cells that must stay whole."""
    spark = cells.sparkSession
    parts = F.least(F.lit(FANOUT), F.greatest(F.lit(2), F.ceil(F.col("n") * 2.5 / SHARD))).cast("int")
    sizes = sizes.withColumn("parts", parts).withColumn("salts", F.ceil(F.col("n") / DEAL).cast("int"))
    rows = cells.join(few_keys(sizes), ["label", "path"])
    rank = F.pmod(F.xxhash64("id", F.lit(3), "path"), F.lit(1_000_000)) / 1_000_000
    sample = rows.where(rank * F.col("n") < F.col("parts") * SAMPLED).select("label", "path", "parts", "id", "v")
    kind = cells.schema["v"].dataType.simpleString()

    def means(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("id").to_numpy(), kind="stable")
        x = unit(matrix(t.column("v"), len(t)))[order]
        c = centres(x[np.random.default_rng(7).permutation(len(x))], min(len(x), t.column("parts")[0].as_py()))
        return pa.table({"label": t.column("label").slice(0, 1).take(pa.array([0] * len(c))), "path": t.column("path").take(pa.array([0] * len(c))), "k": pa.array(np.arange(len(c))), "means": pa.array(list(c), pa.list_(pa.float64()))})

    found = sample.groupBy("label", "path").applyInArrow(means, "label string, path long, k long, means array<double>")
    found = found.join(few_keys(sizes.select("label", "path", "salts")), ["label", "path"])
    each = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    theirs = found.select("label", "path", each, F.lit(0).cast("long").alias("parent"), F.lit(False).alias("home"), F.col("k").alias("id"), F.lit(0).cast("long").alias("copies"), F.lit(None).cast(kind).alias("v"), "means")
    ours = rows.select("label", "path", F.pmod(F.xxhash64("id", F.lit(11)), "salts").cast("int").alias("salt"), F.col("n").alias("parent"), "home", "id", "copies", "v", F.lit(None).cast("array<double>").alias("means"))

    def deal(t: pa.Table) -> pa.Table:
        is_centre = t.column("means").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        c, rows = t.filter(pa.array(is_centre)).sort_by("id"), t.filter(pa.array(~is_centre))
        if not len(rows):
            return rows.select(NAMES).append_column("sketch", pa.array([], pa.binary()))
        u = unit(matrix(rows.column("v"), len(rows)))
        c = matrix(c.column("means"), len(c)) if len(c) else u[:1]
        near = u @ c.T
        i, j = np.nonzero(guests(near, c, least))
        out = rows.take(pa.array(i))
        path = out.column("path").to_numpy() * (FANOUT + 1) + j + 1
        home = out.column("home").to_numpy() & (near.argmax(1)[i] == j)
        v, signs = out.column("v"), pa.nulls(len(i), pa.binary())
        if rows.column("parent")[0].as_py() > PLAIN:
            v = rows.column("v").take(pa.array(i, mask=~home))  # guests come without, until they are known to be of use
            signs = pa.array([x.tobytes() for x in sketch(u)], pa.binary()).take(pa.array(i))
        return pa.table([out.column("label"), pa.array(path), out.column("parent"), pa.array(home), out.column("id"), out.column("copies"), v, signs], names=[*NAMES, "sketch"])

    dealt = written(spark, ours.unionByName(theirs).groupBy("label", "path", "salt").applyInArrow(deal, f"{node_of(kind)}, sketch binary"), "dealt")
    asked = useful(dealt, least)
    above = F.floor((F.col("path") - 1) / (FANOUT + 1)).cast("long")
    whole = sizes.select("label", F.col("path").alias("above"), "n")
    grown = dealt.where(STAYS).select("label", above.alias("above")).unionAll(asked.select("label", above.alias("above"))).groupBy("label", "above").count()
    whole = written(spark, grown.join(few_keys(whole), ["label", "above"]).where(F.col("count") > F.col("n") * GROWS).select("label", "above"), "whole")
    made = lambda df: df.join(few_keys(whole), (df["label"] == whole["label"]) & (F.floor((df["path"] - 1) / (FANOUT + 1)).cast("long") == whole["above"]), "left_anti")
    visiting = made(asked).join(nodes.select("id", "copies", "v"), "id").select("label", "path", F.lit(None).cast("long").alias("parent"), F.lit(False).alias("home"), "id", "copies", "v")
    return made(dealt.where(STAYS)).select(NAMES).unionByName(written(spark, visiting, "guests")), whole.select("label", F.col("above").alias("path"))


def shards(nodes: DataFrame, least: float) -> tuple[DataFrame, DataFrame | None]:
    """(rows of shards of at most ``SHARD`` nodes, rows of those that can't be cut so small)."""
    spark = nodes.sparkSession
    cells = nodes.select("label", F.lit(0).cast("long").alias("path"), F.lit(None).cast("long").alias("parent"), F.lit(True).alias("home"), "id", "copies", "v")
    small, dense = [], []
    for depth in range(DEPTH + 1):
        sizes = cells.groupBy("label", "path").agg(F.count("*").alias("n"), F.max("parent").alias("whole"))
        stuck = (F.col("n") > F.col("whole") * SHRINKS) | F.lit(depth == DEPTH)
        state = F.when(F.col("n") <= SHARD, "small").when(F.coalesce(stuck, F.lit(False)), "dense").otherwise("big")
        sizes = written(spark, sizes.select("label", "path", "n", state.alias("state")), "sizes")
        states = {r["state"] for r in sizes.select("state").distinct().collect()}  # three at most
        part = lambda keys: cells.join(few_keys(keys.select("label", "path")), ["label", "path"])  # noqa: B023, E731
        if "small" in states:
            small.append(part(sizes.where("state = 'small'")))
        if "dense" in states:
            dense.append(part(sizes.where("state = 'dense'")))
        if "big" not in states:
            break
        below, whole = cut(cells, nodes, sizes.where("state = 'big'").select("label", "path", "n"), least)
        if not whole.isEmpty():
            dense.append(part(whole))
        cells = below
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(small) if small else cells.where("false"), union(dense) if dense else None


# --- graph ---


def pruned(s: np.ndarray, least: float) -> list[np.ndarray]:
    """Robust-pruned neighbours (row numbers) of each row, given all products ``s`` of a shard's unit vectors; in blocks."""
    n, out = len(s), []
    for begin in range(0, n, 256):
        near = s[begin : begin + 256].copy()
        rows = np.arange(len(near))
        near[rows, begin + rows] = -np.inf
        width = min(n - 1, max(POOL, int((near >= least).sum(1).max())))
        if not width:
            out += [np.zeros(0, int)] * len(near)
            continue
        candidates = np.argpartition(-near, width - 1, axis=1)[:, :width]
        sims = np.take_along_axis(near, candidates, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        candidates, sims = np.take_along_axis(candidates, order, 1), np.take_along_axis(sims, order, 1)
        linked = sims >= least
        alive, kept = linked | (np.arange(width) < POOL), np.zeros(sims.shape, bool)
        more = np.full(len(near), DEGREE)  # neighbours out of range that may still be kept
        while (some := alive.any(1)).any():
            first = alive.argmax(1)
            go = rows[some]
            kept[go, first[some]] = True
            more[go] -= ~linked[go, first[some]]
            between = s[candidates[go, first[some]][:, None], candidates[go]]
            nearer = np.where(linked[go], between > sims[go], ALPHA**2 * (2 - 2 * between) <= 2 - 2 * sims[go])
            alive[go] &= ~nearer
            alive[go, first[some]] = False
            alive &= linked | (more > 0)[:, None]
        out += [candidates[i][kept[i]] for i in range(len(near))]
    return out


def in_range(s: np.ndarray, neighbours: list[np.ndarray], queries: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """Rows found within range of each query row: a greedy walk from the medoid, then range expansion."""
    n = len(s)
    degree = np.array([len(x) for x in neighbours], np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *neighbours]).astype(np.int64)
    starts = np.cumsum(degree) - degree

    def spread(who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``who``, neighbour) for all neighbours of some rows; hubs have many, so lists are not padded."""
        sizes = degree[who]
        of = np.repeat(np.arange(len(who)), sizes)
        return of, flat[np.arange(len(of)) + np.repeat(starts[who] - (np.cumsum(sizes) - sizes), sizes)]

    medoid = int(s.sum(1).argmax())
    reach = 2 * least * least - 1 - 1e-9 if least > 0 else -1.0  # the cosine of twice the angle
    for begin in range(0, len(queries), 128):
        q = queries[begin : begin + 128]
        at, walking = np.full(len(q), medoid), np.arange(len(q))
        while len(walking):
            of, nb = spread(at[walking])
            order = np.lexsort((s[q[walking[of]], nb], of))  # each one's best neighbour is its last
            last = order[np.flatnonzero(np.diff(np.append(of[order], -1)))] if len(order) else order
            one, to = walking[of[last]], nb[last]
            better = s[q[one], to] > s[q[one], at[one]]
            walking = one[better]
            at[walking] = to[better]
        seen = np.zeros((len(q), n), bool)
        close = np.flatnonzero(s[q, at] >= reach)
        rows, who = np.concatenate([np.arange(len(q)), close]), np.concatenate([q, at[close]])  # the query's own node, and where the walk ended
        seen[rows, who] = True
        while len(rows):
            found = [np.zeros(0, np.int64)]
            ends = np.cumsum(degree[who])
            parts = np.unique([0, *(np.searchsorted(ends, np.arange(STEP, int(ends[-1]), STEP)) + 1), len(who)])
            for x, y in itertools.pairwise(parts):  # memory follows the step, however many rows are in range
                of, nb = spread(who[x:y])
                r = rows[x:y][of]
                new = ~seen[r, nb] & (s[q[r], nb] >= reach)
                pairs = np.unique(r[new] * n + nb[new])
                seen[pairs // n, pairs % n] = True
                found.append(pairs)
            pairs = np.concatenate(found)
            rows, who = pairs // n, pairs % n
        for i in range(len(q)):
            near = np.flatnonzero(seen[i])
            yield near[(s[q[i], near] >= least) & (near != q[i])]


def rooted(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows reaches over links (a, b)."""
    root = np.arange(n)
    while True:
        old = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == old).all():
            return root


def counted(ids: np.ndarray, own: np.ndarray, others: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Rows of ``COUNTS``: own nodes with their links' copies, and an edge to a representative for each linked node."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), int)
    place[order] = np.arange(len(ids))  # so that representatives are the smallest ids
    root = ids[order][rooted(len(ids), place[a], place[b])[place]]
    some = own | (root != ids)
    return pa.table({"id": pa.array(ids[some]), "others": pa.array(np.where(own, others, 0)[some]), "root": pa.array(root[some])})


def graph_counts(cells: DataFrame, least: float) -> DataFrame:
    """``COUNTS`` of the nodes of shards of bounded size, by the graph."""
    spark = cells.sparkSession

    def build(t: pa.Table) -> pa.Table:
        ids, u = t.column("id").to_numpy(), unit(matrix(t.column("v"), len(t)))
        near = pruned(u @ u.T, least)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in near])]).astype(np.int32)
        return pa.table({"id": pa.array(ids), "near": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[np.concatenate([np.zeros(0, int), *near])]))})

    lists = cells.groupBy("label", "path").applyInArrow(build, "id long, near array<long>")
    graph = written(spark, lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")  # as many lists as a node has shards

    def search(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, copies, own = t.column("id").to_numpy(), t.column("copies").to_numpy(), t.column("home").to_numpy()
        u = unit(matrix(t.column("v"), len(t)))
        near = t.column("near").combine_chunks()
        flat, ends = near.flatten().to_numpy(), near.offsets.to_numpy() - near.offsets.to_numpy()[0]
        at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        here = ids[at] == flat
        lists = [at[a:b][here[a:b]] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        queries, others = np.flatnonzero(own), np.zeros(len(ids), np.int64)
        a, b = [np.zeros(0, int)], [np.zeros(0, int)]
        for q, found in zip(queries, in_range(u @ u.T, lists, queries, least), strict=True):
            others[q] = copies[found].sum()
            a.append(np.full(len(found), q))
            b.append(found)
        return counted(ids, own, others, np.concatenate(a), np.concatenate(b))

    return written(spark, cells.join(graph, "id").groupBy("label", "path").applyInArrow(search, COUNTS), "counts")


def tile_counts(cells: DataFrame, least: float) -> DataFrame:
    """``COUNTS`` of the nodes of shards of any size, by exact tiles of bounded blocks; a node's count may be spread over rows."""
    spark = cells.sparkSession
    sizes = cells.groupBy("label", "path").agg(F.ceil(F.count_if("home") / TILE).cast("int").alias("asked_blocks"), F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    cells = cells.join(written(spark, sizes, "sizes"), ["label", "path"])
    block = lambda count, seed: F.pmod(F.xxhash64("id", F.lit(seed)), count).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    asked = cells.where("home").select("label", "path", block(F.col("asked_blocks"), 19).alias("r"), each("blocks").alias("c"), "id", "copies", "v", F.lit(True).alias("asked"))
    others = cells.where("asked_blocks > 0").select("label", "path", each("asked_blocks").alias("r"), block(F.col("blocks"), 23).alias("c"), "id", "copies", "v", F.lit(False).alias("asked"))

    def run(t: pa.Table) -> pa.Table:
        flags = t.column("asked").to_numpy()
        q, x = np.flatnonzero(flags), np.flatnonzero(~flags)
        every, number = np.unique(t.column("id").to_numpy(), return_inverse=True)
        copies, u = t.column("copies").to_numpy(), unit(matrix(t.column("v"), len(t)))
        total, own = np.zeros(len(every), np.int64), np.zeros(len(every), bool)
        own[number[q]] = True
        root = np.arange(len(every))
        for part in (q[i : i + 256] for i in range(0, len(q), 256)):
            i, j = np.nonzero((u[part] @ u[x].T >= least) & (number[part][:, None] != number[x][None, :]))
            np.add.at(total, number[part[i]], copies[x[j]])
            # links so far are kept as one edge a row, so memory follows the rows
            old = np.flatnonzero(root != np.arange(len(root)))
            root = rooted(len(every), np.concatenate([old, number[part[i]]]), np.concatenate([root[old], number[x[j]]]))
        linked = np.flatnonzero(root != np.arange(len(root)))
        return counted(every, own, total, linked, root[linked])

    return written(spark, asked.unionAll(others).groupBy("label", "path", "r", "c").applyInArrow(run, COUNTS), "tiled")


# --- audit ---


def audit(nodes: DataFrame, found: DataFrame, least: float) -> dict[str, tuple[int, int]]:
    """label -> (true links, links found) of a bounded sample of nodes, spread over labels.

    Half of the sample has links already, if there are such nodes.
    """
    spark = nodes.sparkSession
    most = min(MOST_AUDITED, max(AUDITED, nodes.select("label").distinct().count()))
    ranked = nodes.join(found, "id").withColumn("some", F.col("others") > 0)
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("label", "some").orderBy(F.xxhash64("id", F.lit(5)), "id"))).where(F.col("r") <= most // 2)
    sample = ranked.orderBy("r", F.xxhash64("label", "id"), "id").select("id", "label", "others", "v").limit(most).collect()
    if not sample:
        return {}
    shared = spark.sparkContext.broadcast([(r["id"], r["label"], r["v"]) for r in sample])  # at most MOST_AUDITED vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels = np.array([i for i, *_ in shared.value]), np.array([x for _, x, _ in shared.value])
        total = np.zeros(len(ids), np.int64)
        vectors = {x: unit(np.array([v for _, y, v in shared.value if y == x], float)) for x in set(labels.tolist())}
        for b in batches:
            theirs = np.array(b.column(1).to_pylist(), object)
            for x, q in vectors.items():
                if len(at := np.flatnonzero(theirs == x)):
                    rows = b.take(pa.array(at))
                    u = unit(rows.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1))
                    mine = np.flatnonzero(labels == x)
                    hit = (q @ u.T >= least) & (ids[mine][:, None] != rows.column(0).to_numpy()[None, :])
                    total[mine] += (hit * rows.column(3).to_numpy()[None, :]).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["id", "n"])

    true = {r["id"]: r["n"] for r in nodes.select("id", "label", "v", "copies").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    out: dict[str, tuple[int, int]] = {}
    for r in sample:
        a, b = out.get(r["label"], (0, 0))
        out[r["label"]] = a + true[r["id"]], b + r["others"]
    return out


def recall(audited: dict[str, tuple[int, int]]) -> float:
    true = sum(a for a, _ in audited.values())
    return sum(b for _, b in audited.values()) / true if true else 1.0


# --- operator ---


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93) -> DataFrame:
    """(id, n_links, component_id, kept) for each row; ids are whole numbers."""
    spark = df.sparkSession
    ship(spark)
    kind = "array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"  # what came in single precision is kept so, and compared in double
    with scratch(spark) as result:
        rows = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(kind).alias("v"))
        rows = rows.withColumn("label", F.when(usable(F.col("v")) & F.col("label").isNotNull() & F.col("row_id").isNotNull(), F.concat("label", F.lit("/"), F.size("v"))))
        keys = [F.when(F.col("label").isNotNull(), F.xxhash64(F.lit(i), "label", "v")).alias(f"k{i}") for i in (1, 2)]  # 128 bits tell vectors apart
        rows = written(spark, rows.select("row_id", *keys, "label", F.when(F.col("label").isNotNull(), F.col("v")).alias("v")), "vectors")
        nodes = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min("row_id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
        nodes = written(spark, nodes, "nodes")
        # rows of one id may be two nodes if their vectors differ; a node's number is its own
        numbered = written(spark, nodes.select(F.xxhash64("k1", "k2", "id").alias("id"), F.col("id").alias("row_id"), "k1", "k2", "copies", "label", "v"), "numbered")
        plain = numbered.select("id", "label", "copies", "v")
        small, dense = shards(plain, least)
        counts = [graph_counts(small, least), *([tile_counts(dense, least)] if dense is not None else [])]
        every = counts[0] if len(counts) == 1 else counts[0].unionByName(counts[1])
        found = every.groupBy("id").agg(F.sum("others").alias("others"))
        audited = audit(plain, found, least)
        log.info("recall of links %.4f", recall(audited))
        if recall(audited) < AUDIT:
            # within one shard every link is found (see above), so what was missed lies in labels that were cut: all of them again, exactly
            paths = small.select("label", "path") if dense is None else small.select("label", "path").unionByName(dense.select("label", "path"))
            cut = written(spark, paths.groupBy("label").agg(F.min("path").alias("a"), F.max("path").alias("b")).where("a != b").select("label"), "cut")
            log.warning("recall of links %.4f is under %s: %d labels again by exact tiles", recall(audited), AUDIT, cut.count())
            whole = written(spark, plain.join(few(cut), "label", "left_semi"), "again")
            more = tile_counts(whole.select("label", F.lit(0).cast("long").alias("path"), F.lit(True).alias("home"), "id", "copies", "v"), least)
            every = every.join(few(whole.select("id")), "id", "left_anti").unionByName(more)
            found = every.groupBy("id").agg(F.sum("others").alias("others"))
        # components go by the smallest row ids of nodes
        names = numbered.select("id", "row_id")
        edges = every.where("id != root").select("id", "root").distinct()
        edges = edges.join(names.withColumnRenamed("row_id", "a"), "id").join(names.select(F.col("id").alias("root"), F.col("row_id").alias("b")), "root")
        label = components(edges, "a", "b").select(F.col("vertex").alias("row_id"), F.col("label").alias("component_id"))
        by_node = numbered.select("id", "row_id", "k1", "k2", "copies").join(found, "id", "left").join(label, "row_id", "left")
        by_node = by_node.select("k1", "k2", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "row_id").alias("component_id"))
        out = result(rows.select("row_id", "k1", "k2").join(by_node, ["k1", "k2"], "left").select("row_id", "n_links", "component_id"), "linked")
    component = F.coalesce("component_id", "row_id")
    return out.select(F.col("row_id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("row_id")).alias("kept"))
