"""Label statistics of a parsed question corpus, and fuzzy grouping of labels."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tessera.functions.headers import labels
from tessera.operators.lineage import cut_lineage
from tessera.operators.similar import candidates, indexable

#: Words that are left out before labels are compared, by kind; labels within the generic string never match.
DROPPED = {"t": (" Exercise", " Activity"), "m": ("Exercise ", "Activity ")}
GENERIC = "ExerciseActivityQuestionGame"


def exploded(parsed: DataFrame, kind: str, order: str = "doc_id") -> DataFrame:
    """A row for each label of a record: (order, label, place); the placeholder is a label."""
    return parsed.select(order, F.posexplode(labels(F.col(kind))).alias("place", "label"))


def counts(parsed: DataFrame, kind: str, order: str = "doc_id") -> DataFrame:
    """(label, cnt, first_pos): how often each label occurs, and the first record that has it."""
    return exploded(parsed, kind, order).groupBy("label").agg(F.count("*").alias("cnt"), F.min(order).alias("first_pos"))


def normalised(label: Column, kind: str) -> Column:
    out = label
    for word in DROPPED[kind]:
        out = F.replace(out, F.lit(word), F.lit(""))
    return out


@F.pandas_udf(IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence: a bit for each character of ``a``, a step for each of ``b``.

    Folds of built-in functions say the same, but copy a row of the table a
    cell, which took a millisecond and a half a pair of labels.
    """

    def one(x: str | None, y: str | None) -> int | None:
        if x is None or y is None:
            return None
        places: dict[str, int] = {}
        for i, c in enumerate(x):
            places[c] = places.get(c, 0) | 1 << i
        full = (1 << len(x)) - 1
        free = full
        for c in y:
            hit = free & places.get(c, 0)
            free = ((free + hit) | (free - hit)) & full
        return len(x) - free.bit_count()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """100 times twice the common subsequence over both lengths, words sorted first."""
    x, y = sorted_words(a), sorted_words(b)
    total = F.length(x) + F.length(y)
    return F.when(total == 0, 100.0).otherwise(F.lit(200.0) * lcs(x, y) / total)


def sorted_words(x: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(x, r"\s+"), lambda w: w != "")), " ")


def fuzzy_pairs(found: DataFrame, kind: str, least: float = 90) -> DataFrame:
    """(label, other, score) of distinct labels, later one first, whose score is over ``least`` and that no word sets apart.

    Labels are compared by their sorted words, each such text once. An index on
    q-grams proposes the pairs of texts (:mod:`tessera.operators.similar`); where
    ``least`` is so low that a pair may have none in common, texts meet by length.
    """
    n = found.where("label is not null").select("label", "first_pos", sorted_words(normalised(F.col("label"), kind)).alias("text"))
    if kind == "t":
        n = n.where(F.instr(F.lit(GENERIC), F.col("label")) == 0)
    texts = n.select("text").distinct()
    longest = n.agg(F.max(F.length("text"))).first()[0] or 0
    pairs = candidates(texts, least) if indexable(longest, least) else _by_length(texts, least)
    scored = pairs.withColumn("score", F.lit(200.0) * lcs("x", "y") / (F.length("x") + F.length("y"))).where(F.col("score") > least)
    both = scored.unionByName(scored.select(F.col("y").alias("x"), F.col("x").alias("y"), "score")).unionByName(texts.select(F.col("text").alias("x"), F.col("text").alias("y"), F.lit(100.0).alias("score")))
    late = n.select("label", F.col("first_pos").alias("p"), F.col("text").alias("x"))
    early = n.select(F.col("label").alias("other"), F.col("first_pos").alias("op"), F.col("text").alias("y"))
    apart = lambda a, b: F.col(a).contains("Exercise") & F.col(b).contains("Activity")
    met = late.join(both, "x").join(early, "y").where((F.col("p") > F.col("op")) | ((F.col("p") == F.col("op")) & (F.col("label") > F.col("other"))))
    return met.where(~apart("label", "other") & ~apart("other", "label")).where(F.lit(100.0 > least)).select("label", "other", "score")


def _by_length(texts: DataFrame, least: float) -> DataFrame:
    """(x, y), x < y: all pairs of texts whose lengths allow the score."""
    share = least / (200 - least)
    sized = texts.withColumn("size", F.length("text"))
    if share <= 0:
        return sized.select(F.col("text").alias("x"), F.lit(0).alias("k")).join(sized.select(F.col("text").alias("y"), F.lit(0).alias("k")), "k").where("x < y").select("x", "y")
    wide = sized.select(F.col("text").alias("x"), F.explode(F.sequence(F.floor(F.col("size") * share).cast("int"), F.ceil(F.col("size") / share).cast("int"))).alias("size"))
    return wide.join(sized.withColumnRenamed("text", "y"), "size").where("x < y").select("x", "y")


def aliases(found: DataFrame, kind: str, least: float = 90) -> DataFrame:
    """(alias, canonical): labels in order of first place; one becomes the alias of the kept label with the best score, the earliest on ties.

    Which labels are kept depends on earlier ones alone, so a few rounds settle
    all: a label is kept once all its earlier partners are aliases, and an alias
    once one of them is kept and the rest are settled.
    """
    pairs = cut_lineage(fuzzy_pairs(found, kind, least).join(found.select(F.col("label").alias("other"), "first_pos"), "other"))
    # labels without an earlier partner are kept; only the others have to wait
    state = cut_lineage(pairs.select(F.col("other").alias("label")).join(pairs.select("label"), "label", "left_anti").distinct().select("label", F.lit(True).alias("kept")).unionByName(pairs.select("label", F.lit(None).cast("boolean").alias("kept")).distinct()))
    while not state.where("kept is null").isEmpty():
        seen = pairs.join(state.select(F.col("label").alias("other"), "kept"), "other").groupBy("label").agg(F.max("kept").alias("some"), F.count_if(F.col("kept").isNull()).alias("open"))
        kept = F.when(F.coalesce("some", F.lit(False)), F.lit(False)).when(F.coalesce("open", F.lit(0)) == 0, F.lit(True)).otherwise(F.col("kept"))
        state = cut_lineage(state.join(seen, "label", "left").select("label", kept.alias("kept")))
    best = pairs.join(state.where("kept").select(F.col("label").alias("other")), "other", "left_semi")
    best = best.join(state.where("not kept"), "label", "left_semi").groupBy("label").agg(F.min_by("other", F.struct(-F.col("score"), "first_pos", "other")).alias("canonical"))
    return best.select(F.col("label").alias("alias"), "canonical")


def canonical(rows: DataFrame, alias: DataFrame) -> DataFrame:
    """Rows with ``label`` replaced by what it is an alias of."""
    return rows.join(alias.withColumnRenamed("alias", "label"), "label", "left").withColumn("label", F.coalesce("canonical", "label")).drop("canonical")


def combination_counts(parsed: DataFrame, order: str = "doc_id") -> DataFrame:
    """(combo, cnt, first_pos) of subject, types, grade and modifiers; labels of a list joined without separator."""
    joined = lambda c: F.array_join(labels(F.col(c)), "")
    combo = F.concat_ws("|", F.trim("s"), joined("t"), F.trim("g"), joined("m"))
    return parsed.groupBy(combo.alias("combo")).agg(F.count("*").alias("cnt"), F.min(order).alias("first_pos"))


def combinations(parsed: DataFrame, order: str = "doc_id") -> DataFrame:
    """(s, types, g, modifiers, cnt, first_pos) with lists as arrays, so that no two different combinations are one."""
    return parsed.groupBy(F.trim("s").alias("s"), labels(F.col("t")).alias("types"), F.trim("g").alias("g"), labels(F.col("m")).alias("modifiers")).agg(F.count("*").alias("cnt"), F.min(order).alias("first_pos"))


def _by_row(parsed: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """A row for each label, beside its record's columns and a key of the record: records that share an id stay apart."""
    name = "_" * (1 + max(map(len, parsed.columns)))  # clashes with no column
    return parsed.withColumn(name, F.monotonically_increasing_id()).select("*", F.posexplode_outer(labels(F.col(kind))).alias("place", "label")), name


def canonical_records(parsed: DataFrame, alias: dict[str, DataFrame]) -> DataFrame:
    """``parsed`` with the lists of the kinds in ``alias`` (kind -> aliases) rewritten to canonical labels, in their order, commas between."""
    for kind, table in alias.items():
        rows, key = _by_row(parsed, kind)
        named = canonical(rows, table)
        listed = F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("place", "label"))))
        text = F.when(F.size("_listed") > 0, F.array_join(F.transform("_listed", lambda x: x["label"]), ","))
        whole = named.groupBy(key).agg(F.first(F.struct(*parsed.columns)).alias("_row"), listed.alias("_listed"))
        parsed = whole.select(*[text.alias(c) if c == kind else F.col("_row")[c].alias(c) for c in parsed.columns])
    return parsed


class Statistics(Mapping):
    """All statistics of a corpus on canonical labels, each worked out when it is asked for.

    ``s t g m combo``: counts (label or combo, cnt, first_pos); ``alias``: (kind,
    alias, canonical); ``unique``: (kind, n); ``share``: (kind, n, share) of
    labels that occur more than twice, for types and modifiers.
    """

    def __init__(self, parsed: DataFrame, order: str = "doc_id"):
        self.parsed, self.order, self._alias = parsed.select(order, *"stgm"), order, {}

    def aliases(self, kind: str) -> DataFrame:
        if kind not in self._alias:
            self._alias[kind] = cut_lineage(aliases(counts(self.parsed, kind, self.order), kind))
        return self._alias[kind]

    def __getitem__(self, name: str) -> DataFrame:
        if name in ("s", "g"):
            return counts(self.parsed, name, self.order)
        if name in ("t", "m"):
            return canonical(exploded(self.parsed, name, self.order), self.aliases(name)).groupBy("label").agg(F.count("*").alias("cnt"), F.min(self.order).alias("first_pos"))
        if name == "combo":
            return combination_counts(canonical_records(self.parsed, {k: self.aliases(k) for k in "tm"}), self.order)
        parts = {
            "alias": lambda: [self.aliases(k).select(F.lit(k).alias("kind"), "alias", "canonical") for k in "tm"],
            "unique": lambda: [self[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k in (*"stgm", "combo")],
            "share": lambda: [frequent_share(self[k]).select(F.lit(k).alias("kind"), "n", "share") for k in "tm"],
        }[name]()
        return reduce(DataFrame.unionByName, parts)

    def __iter__(self) -> Iterator[str]:
        return iter((*"stgm", "combo", "alias", "unique", "share"))

    def __len__(self) -> int:
        return 8


def statistics(parsed: DataFrame, order: str = "doc_id") -> Statistics:
    return Statistics(parsed, order)


def top(counted: DataFrame, n: int) -> DataFrame:
    """The n commonest, ties by first place."""
    return counted.orderBy(F.desc("cnt"), "first_pos").limit(n)


def rarest(parsed: DataFrame, counted: DataFrame, kind: str, compat: bool = False, order: str = "doc_id", alias: DataFrame | None = None) -> DataFrame:
    """(order, label, single): the rarest label of each record's list, the last of ties.

    ``alias``: labels are replaced by what they are aliases of, and ``counted``
    holds counts of those. ``compat``: the last label whose count is not over the first label's.
    """
    rows, key = _by_row(parsed.select(order, kind), kind)
    rows = rows.where("label IS NOT NULL")
    rows = (rows if alias is None else canonical(rows, alias)).join(counted.select("label", "cnt"), "label", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    same, single = F.first(order).alias(order), (F.count("*") == 1).alias("single")
    if compat:
        pick = rows.groupBy(key).agg(same, single, F.min_by("cnt", "place").alias("c"), F.collect_list(F.struct("place", "label", "cnt")).alias("xs"))
        good = F.array_sort(F.filter("xs", lambda x: x.cnt <= F.col("c")))
        return pick.select(order, F.element_at(good, -1).label.alias("label"), "single")
    return rows.groupBy(key).agg(same, F.max_by("label", F.struct(-F.col("cnt"), "place")).alias("label"), single).drop(key)


def frequent_share(counted: DataFrame, over: int = 2) -> DataFrame:
    """How many labels occur more than ``over`` times, and their share of all occurrences in percent."""
    often = F.col("cnt") > over
    return counted.agg(F.count_if(often).alias("n"), F.round(100.0 * F.sum(F.when(often, F.col("cnt")).otherwise(0)) / F.sum("cnt"), 6).alias("share"))


def unknown_words(parsed: DataFrame, vocabulary: DataFrame, header: str = "header") -> DataFrame:
    """(word, cnt) of header words, brackets left out, that the vocabulary lacks."""
    words = parsed.select(F.explode(F.regexp_extract_all(F.translate(header, "()", ""), F.lit(r"(?U)\b(\w+)\b"))).alias("word"))
    return words.join(vocabulary.select("word"), "word", "left_anti").groupBy("word").agg(F.count("*").alias("cnt"))


