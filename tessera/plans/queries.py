"""Registered queries over the driver's tables, each with equivalent DuckDB SQL.

Feeds (:mod:`tessera.plans.feeds`) are one text for both engines; everything
after them is written twice: as DataFrame operations here, as SQL below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import headers, instruct, markup, pixels, templates
from tessera.operators import conversation, labels, layout, ranks, requests, segments, split
from tessera.plans import feeds
from tessera.plans.registry import QUERIES, SQL, query, spread, t  # noqa: F401  both tables are read here by others
from tessera.streaming import sessions

Q = f"WITH q AS ({feeds.QUESTIONS.format(documents='documents')}), p AS (SELECT *, regexp_matches(header, h) AS ok, translate(regexp_extract(header, h, 1), '()', '') AS s, translate(regexp_extract(header, h, 2), '()', '') AS t, regexp_extract(header, h, 3) AS g, translate(regexp_extract(header, h, 4), '()', '') AS m, regexp_extract(header, h, 0) AS whole FROM q, (SELECT '{headers.HEADER}' AS h)), v AS (SELECT * FROM p WHERE ok)"
STRIPPED = "regexp_replace(x, '^\\s+|\\s+$', '', 'g')"
SPLIT = "list_transform(string_split({c}, ','), lambda x: " + STRIPPED + ")"
C = f"WITH c AS ({feeds.CONVERSATIONS.format(conversations='conversations')})"
B = f"WITH b AS ({feeds.BLOCKS.format(lineitem='lineitem')})"


def questions(spark: SparkSession, d: str) -> DataFrame:
    return headers.parse(feeds.feed(spark, feeds.QUESTIONS, documents=t(spark, d, "documents").select("doc_id", "text")))


def parsed(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).where("s is not null")


# headers


@query("header_parse", Q + " SELECT doc_id, s, t, g, m, CASE WHEN g <> 'G' THEN g::INTEGER END AS grade FROM v")
def header_parse(spark, d):
    return parsed(spark, d).select("doc_id", "s", "t", "g", "m", "grade")


@query("header_reject", Q + " SELECT doc_id, header FROM p WHERE NOT ok")
def header_reject(spark, d):
    return questions(spark, d).where("s is null").select("doc_id", "header")


@query("header_trailing", Q + " SELECT doc_id, header FROM v WHERE length(whole) <> length(header)")
def header_trailing(spark, d):
    return parsed(spark, d).where("trailing").select("doc_id", "header")


@query("record_split", Q + ", r AS (SELECT doc_id, header || chr(10) || coalesce(body, '') AS r FROM q) SELECT doc_id, string_split(r, chr(10))[1] AS header, length(substr(r, instr(r, chr(10)) + 1)) AS body_chars FROM r")
def record_split(spark, d):
    q = questions(spark, d).select("doc_id", F.concat("header", F.lit("\n"), F.coalesce("body", F.lit(""))).alias("r"))
    h, b = headers.split_record(F.col("r"))
    return q.select("doc_id", h.alias("header"), F.length(b).alias("body_chars"))


# instructions

ART = "(CASE WHEN regexp_matches(lower({x}), '^(hour|honest|honou?r|heir)') OR (regexp_matches(lower({x}), '^[aeiou]') AND NOT regexp_matches(lower({x}), '^(uni|use|usu|eu|one|once)')) THEN 'an ' ELSE 'a ' END || {x})"
SUFFIX = "CASE WHEN {n} % 100 BETWEEN 11 AND 13 THEN 'th' WHEN {n} % 10 = 1 THEN 'st' WHEN {n} % 10 = 2 THEN 'nd' WHEN {n} % 10 = 3 THEN 'rd' ELSE 'th' END"
TYPE = f"(SELECT CASE WHEN v.t = 'T' THEN 'Give me an exercise' WHEN len(l) = 1 THEN 'Give me ' || l[1] ELSE 'Give me a combination of ' || list_aggregate(l[1:len(l)-1], 'string_agg', ', ') || CASE WHEN len(l) > 2 THEN ',' ELSE '' END || ' and ' || l[len(l)] END FROM (SELECT list_transform({SPLIT.format(c='lower(v.t)')}, lambda x: {ART.format(x='x')}) AS l))"
GRADE = f"(CASE WHEN v.g = 'G' THEN 'for a student' ELSE 'for a ' || v.g || {SUFFIX.format(n='try_cast(v.g AS INTEGER)')} || ' grade student' END || CASE WHEN v.s = 'S' THEN '.' ELSE ' learning ' || CASE WHEN v.s IN ('French','English','Dutch','Spanish','German') THEN v.s ELSE lower(v.s) END || '.' END)"
_SECT = "('With Answer','With Material','With Prerequisites','With Context','With Hint')"
_OTHER = f"""(CASE x WHEN 'With Illustration' THEN '{instruct.SENTENCES["With Illustration"]}' WHEN 'With Marks' THEN '{instruct.SENTENCES["With Marks"]}' WHEN 'With Instruction' THEN '{instruct.SENTENCES["With Instruction"]}' WHEN 'Multi-part' THEN '{instruct.SENTENCES["Multi-part"]}'
 ELSE ' It should be ' || {ART.format(x="replace(CASE WHEN string_split(x, ' ')[2] = 'with' THEN regexp_replace(x, 'with', 'involving') ELSE x END, string_split(x, ' ')[1], lower(string_split(x, ' ')[1]))")} || '.' END)"""
MODIFIER = f"""(SELECT CASE WHEN v.m = 'M' THEN '' ELSE CASE WHEN len(w) = 0 THEN '' ELSE ' It should have a subsection for ' || list_aggregate(w[1:greatest(len(w) - 1, 1)], 'string_agg', ', ') || CASE WHEN len(w) > 1 THEN ', and ' || w[len(w)] ELSE '' END || '.' END || coalesce(list_aggregate(o, 'string_agg', ''), '') END
 FROM (SELECT list_transform(list_transform(list_filter(l, lambda x: x IN {_SECT}), lambda x: lower(replace(x, 'With ', ''))), lambda x: CASE WHEN x = 'context' OR x LIKE '%s' THEN x ELSE x || 's' END) AS w, list_transform(list_filter(l, lambda x: x NOT IN {_SECT}), lambda x: {_OTHER}) AS o FROM (SELECT {SPLIT.format(c='v.m')} AS l)))"""


@query("ordinal_suffix", f"SELECT DISTINCT p_size AS n, p_size::VARCHAR || {SUFFIX.format(n='p_size')} AS ordinal FROM part")
def ordinal_suffix(spark, d):
    return t(spark, d, "part").select(F.col("p_size").alias("n")).distinct().select("n", F.concat(F.col("n").cast("string"), instruct.ordinal_suffix(F.col("n"))).alias("ordinal"))


@query("exercise_type_text", Q + f" SELECT doc_id, {TYPE} AS text FROM v")
def exercise_type_text(spark, d):
    return parsed(spark, d).select("doc_id", instruct.exercise_type(F.col("t")).alias("text"))


@query("grade_subject_text", Q + f" SELECT doc_id, {GRADE} AS text FROM v")
def grade_subject_text(spark, d):
    return parsed(spark, d).select("doc_id", instruct.grade_and_subject(F.col("g"), F.col("s")).alias("text"))


@query("modifier_text", Q + f" SELECT doc_id, {MODIFIER} AS text FROM v")
def modifier_text(spark, d):
    return parsed(spark, d).select("doc_id", instruct.modifier(F.col("m")).alias("text"))


@query("instruction_text", Q + f" SELECT doc_id, {TYPE} || ' ' || {GRADE} || {MODIFIER} AS instruction, md5(coalesce(body, '')) AS response_md5 FROM v")
def instruction_text(spark, d):
    return parsed(spark, d).select("doc_id", instruct.instruction(*map(F.col, "stgm")).alias("instruction"), F.md5(F.coalesce("body", F.lit(""))).alias("response_md5"))


# label statistics


def _count_sql(kind: str) -> str:
    return f", e AS (SELECT doc_id, unnest({SPLIT.format(c=kind)}) AS label FROM v), n AS (SELECT label, count(*) AS cnt, min(doc_id) AS first_pos FROM e GROUP BY label)"


for _name, _kind in (("subject_counts", "s"), ("grade_counts", "g"), ("type_counts", "t"), ("modifier_counts", "m")):
    query(_name, Q + _count_sql(_kind) + " SELECT * FROM n")(lambda spark, d, k=_kind: labels.counts(parsed(spark, d), k))

COMBO = ", k AS (SELECT doc_id, trim(s) || '|' || list_aggregate(" + SPLIT.format(c="t") + ", 'string_agg', '') || '|' || g || '|' || list_aggregate(" + SPLIT.format(c="m") + ", 'string_agg', '') AS combo FROM v), n AS (SELECT combo, count(*) AS cnt, min(doc_id) AS first_pos FROM k GROUP BY combo)"


@query("combo_counts", Q + COMBO + " SELECT * FROM n")
def combo_counts(spark, d):
    return labels.combination_counts(parsed(spark, d))


@query("top10_combos", Q + COMBO + " SELECT * FROM n ORDER BY cnt DESC, first_pos LIMIT 10")
def top10_combos(spark, d):
    return labels.top(labels.combination_counts(parsed(spark, d)), 10)


@query("top10_types", Q + _count_sql("t") + " SELECT * FROM n ORDER BY cnt DESC, first_pos LIMIT 10")
def top10_types(spark, d):
    return labels.top(labels.counts(parsed(spark, d), "t"), 10)


@query("frequent_share", Q + _count_sql("m") + " SELECT count(*) FILTER (cnt > 2) AS n, round(100.0 * sum(CASE WHEN cnt > 2 THEN cnt ELSE 0 END) / sum(cnt), 6) AS share FROM n")
def frequent_share(spark, d):
    return labels.frequent_share(labels.counts(parsed(spark, d), "m"))


@query("unique_counts", Q + COMBO + f", u AS (SELECT 's' AS kind, count(DISTINCT s) AS n FROM v UNION ALL SELECT 'g', count(DISTINCT g) FROM v UNION ALL SELECT 't', count(DISTINCT x) FROM (SELECT unnest({SPLIT.format(c='t')}) AS x FROM v) UNION ALL SELECT 'm', count(DISTINCT x) FROM (SELECT unnest({SPLIT.format(c='m')}) AS x FROM v) UNION ALL SELECT 'combo', count(*) FROM n) SELECT * FROM u")
def unique_counts(spark, d):
    p = parsed(spark, d)
    each = [labels.counts(p, k).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k in "sgtm"]
    out = labels.combination_counts(p).agg(F.count("*").alias("n")).select(F.lit("combo").alias("kind"), "n")
    for e in each:
        out = out.unionByName(e)
    return out


# fuzzy labels

SORTED = "list_aggregate(list_sort(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')), 'string_agg', ' ')"
MANY = f"q0 AS ({feeds.MANY_LABELS.format(documents='documents')}), v AS (SELECT doc_id, translate(s, '()', '') AS s, translate(t, '()', '') AS t, g, translate(m, '()', '') AS m FROM q0)"


def _alias_sql(k: str) -> str:
    """Aliases of a kind's labels in ``v``: common subsequences by the dynamic programme over all prefixes, then label by label."""
    first, second = labels.DROPPED[k]
    generic = f"WHERE NOT contains('{labels.GENERIC}', label)" if k == "t" else ""
    return f"""e{k} AS (SELECT doc_id, unnest({SPLIT.format(c=k)}) AS label, generate_subscripts({SPLIT.format(c=k)}, 1) AS place FROM v), n{k} AS (SELECT label, count(*) AS cnt, min(doc_id) AS first_pos FROM e{k} GROUP BY label),
 z{k} AS (SELECT label, first_pos, coalesce({SORTED.format(x=f"replace(replace(label, '{first}', ''), '{second}', '')")}, '') AS x FROM n{k} {generic}),
 pr{k} AS (SELECT a.label, b.label AS other, b.first_pos AS op, a.x AS x, b.x AS y FROM z{k} a JOIN z{k} b ON (a.first_pos, a.label) > (b.first_pos, b.label) AND NOT (contains(a.label, 'Exercise') AND contains(b.label, 'Activity')) AND NOT (contains(b.label, 'Exercise') AND contains(a.label, 'Activity'))),
 sc{k} AS (SELECT label, other, op, CASE WHEN length(x) + length(y) = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * list_extract(list_reduce(string_split(x, ''), lambda above, c: list_reduce(range(length(y)), lambda done, j: list_append(done, CASE WHEN substr(y, j::INTEGER + 1, 1) = c THEN above[j + 1] + 1 ELSE greatest(above[j + 2], done[len(done)]) END), [0::BIGINT]), list_transform(range(length(y) + 1), lambda i: 0::BIGINT)), -1) / (length(x) + length(y)) END AS score FROM pr{k}),
 f{k} AS (SELECT label, other, op, score FROM sc{k} WHERE score > 90),
 o{k} AS (SELECT n{k}.label, row_number() OVER (ORDER BY first_pos, n{k}.label) AS i, coalesce(others, []) AS others FROM n{k} LEFT JOIN (SELECT label, list(other) AS others FROM f{k} GROUP BY label) x ON n{k}.label = x.label),
 ks{k} AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS kept UNION ALL SELECT o.i, CASE WHEN list_has_any(kept, others) THEN kept ELSE list_append(kept, label) END FROM ks{k} JOIN o{k} o ON o.i = ks{k}.i + 1),
 last{k} AS (SELECT arg_max(kept, i) AS kept FROM ks{k}),
 al{k} AS (SELECT f{k}.label AS alias, first(other ORDER BY score DESC, op, other) AS canonical FROM f{k}, last{k} WHERE list_contains(kept, other) AND NOT list_contains(kept, f{k}.label) GROUP BY f{k}.label),
 c{k} AS (SELECT doc_id, place, coalesce(canonical, label) AS label FROM e{k} LEFT JOIN al{k} ON label = alias), nc{k} AS (SELECT label, count(*) AS cnt, min(doc_id) AS first_pos FROM c{k} GROUP BY label)"""


def _many(spark, d):
    q = feeds.feed(spark, feeds.MANY_LABELS, documents=t(spark, d, "documents").select("doc_id"))
    return q.select("doc_id", *[F.translate(c, "()", "").alias(c) for c in "stgm"])


_CANON = f"WITH RECURSIVE {MANY}, {_alias_sql('t')}, {_alias_sql('m')}"
_CCOMBO = ", kc AS (SELECT v.doc_id, trim(s) || '|' || ct.x || '|' || g || '|' || cm.x AS combo FROM v JOIN (SELECT doc_id, string_agg(label, '' ORDER BY place) AS x FROM ct GROUP BY doc_id) ct ON ct.doc_id = v.doc_id JOIN (SELECT doc_id, string_agg(label, '' ORDER BY place) AS x FROM cm GROUP BY doc_id) cm ON cm.doc_id = v.doc_id)"


@query("canonical_alias", _CANON + " SELECT 't' AS kind, * FROM alt UNION ALL SELECT 'm', * FROM alm")
def canonical_alias(spark, d):
    return labels.statistics(_many(spark, d))["alias"]


@query("canonical_types", _CANON + " SELECT * FROM nct")
def canonical_types(spark, d):
    return labels.statistics(_many(spark, d))["t"]


@query("canonical_modifiers", _CANON + " SELECT * FROM ncm")
def canonical_modifiers(spark, d):
    return labels.statistics(_many(spark, d))["m"]


@query("canonical_combos", _CANON + _CCOMBO + " SELECT combo, count(*) AS cnt, min(doc_id) AS first_pos FROM kc GROUP BY combo")
def canonical_combos(spark, d):
    return labels.statistics(_many(spark, d))["combo"]


@query("canonical_unique", _CANON + _CCOMBO + " SELECT 's' AS kind, count(DISTINCT s) AS n FROM v UNION ALL SELECT 't', count(*) FROM nct UNION ALL SELECT 'g', count(DISTINCT g) FROM v UNION ALL SELECT 'm', count(*) FROM ncm UNION ALL SELECT 'combo', count(DISTINCT combo) FROM kc")
def canonical_unique(spark, d):
    return labels.statistics(_many(spark, d))["unique"]


_SHARE = "SELECT '{k}' AS kind, count(*) FILTER (cnt > 2) AS n, round(100.0 * sum(CASE WHEN cnt > 2 THEN cnt ELSE 0 END) / sum(cnt), 6) AS share FROM nc{k}"


@query("canonical_share", _CANON + " " + _SHARE.format(k="t") + " UNION ALL " + _SHARE.format(k="m"))
def canonical_share(spark, d):
    return labels.statistics(_many(spark, d))["share"]


@query("rarest_canonical", _CANON + " SELECT cm.doc_id, arg_max(cm.label, (-ncm.cnt) * 1000 + place) AS label, count(*) = 1 AS single FROM cm JOIN ncm ON cm.label = ncm.label GROUP BY cm.doc_id")
def rarest_canonical(spark, d):
    p = _many(spark, d)
    found = labels.counts(p, "m")
    alias = labels.aliases(found, "m")
    merged = labels.canonical(labels.exploded(p, "m"), alias).groupBy("label").agg(F.count("*").alias("cnt"))
    return labels.rarest(p, merged, "m", alias=alias)


@query("fuzzy_pairs")
def fuzzy_pairs(spark, d):
    return labels.fuzzy_pairs(labels.counts(parsed(spark, d), "m"), "m").withColumn("score", F.round("score", 6))


@query("fuzzy_alias")
def fuzzy_alias(spark, d):
    return labels.aliases(labels.counts(parsed(spark, d), "m"), "m")


@query("counts_after_alias")
def counts_after_alias(spark, d):
    p = parsed(spark, d)
    alias = labels.aliases(labels.counts(p, "m"), "m")
    return labels.canonical(labels.exploded(p, "m"), alias).groupBy("label").agg(F.count("*").alias("cnt"))


@query("rarest_label", Q + _count_sql("m") + f", r AS (SELECT doc_id, unnest({SPLIT.format(c='m')}) AS label, generate_subscripts({SPLIT.format(c='m')}, 1) AS place FROM v) SELECT r.doc_id, arg_max(r.label, (-n.cnt) * 1000 + place) AS label, count(*) = 1 AS single FROM r JOIN n ON r.label = n.label GROUP BY r.doc_id")
def rarest_label(spark, d):
    p = parsed(spark, d)
    return labels.rarest(p, labels.counts(p, "m"), "m")


@query("spell_unknown", Q + ", w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS word FROM benchmark), x AS (SELECT unnest(regexp_extract_all(translate(header, '()', ''), '[\\p{L}\\p{N}_]+')) AS word FROM v) SELECT word, count(*) AS cnt FROM x WHERE word NOT IN (SELECT word FROM w) GROUP BY word")
def spell_unknown(spark, d):
    vocabulary = t(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?U)\b(\w+)\b"))).alias("word")).distinct()
    return labels.unknown_words(parsed(spark, d), vocabulary)


# splits

def _level(i: int, cls: str, multi: str) -> str:
    """One level as SQL on ``l{i-1}`` (doc_id, s, t, g, m, split, pos): every block is drawn from one record at a time.

    The next draw is for the split with the least count by ratio (7, 2, 1: counts times 2, 7, 14), the lower one on ties.
    """
    return f"""a{i} AS (SELECT *, count(*) OVER g AS n, min(pos) OVER g AS first, row_number() OVER (PARTITION BY split, {cls} ORDER BY pos) AS rn, {multi} AS multi FROM l{i - 1} WINDOW g AS (PARTITION BY split, {cls})),
 b{i} AS (SELECT *, rn <= n - n % 10 AS main FROM a{i}),
 c{i} AS (SELECT *, row_number() OVER (PARTITION BY split, {cls}, main, multi ORDER BY pos DESC) AS j FROM b{i}),
 t{i} AS (SELECT split AS s0, {cls} AS k0, main AS m0, count(*) FILTER (NOT multi) AS n0, count(*) FILTER (multi) AS n1 FROM c{i} GROUP BY ALL),
 w{i} AS (SELECT *, 0::BIGINT AS k, 0::BIGINT AS u0, 0::BIGINT AS u1, 0::BIGINT AS c0, 0::BIGINT AS c1, 0::BIGINT AS c2, -1 AS drawn, false AS took, 0::BIGINT AS j FROM t{i}
  UNION ALL SELECT s0, k0, m0, n0, n1, k + 1, u0 + (NOT took)::INT, u1 + took::INT, c0 + (drawn = 0)::INT, c1 + (drawn = 1)::INT, c2 + (drawn = 2)::INT, drawn, took, CASE WHEN took THEN u1 + 1 ELSE u0 + 1 END FROM (
   SELECT *, CASE WHEN drawn = 0 THEN u0 >= n0 ELSE u1 < n1 END AS took FROM (
    SELECT s0, k0, m0, n0, n1, k, u0, u1, c0, c1, c2, CASE WHEN c0 * 2 <= c1 * 7 AND c0 * 2 <= c2 * 14 THEN 0 WHEN c1 * 7 <= c2 * 14 THEN 1 ELSE 2 END AS drawn FROM w{i} WHERE k < n0 + n1))),
 l{i} AS (SELECT doc_id, s, t, g, m, drawn AS split, row_number() OVER (ORDER BY s0, n, first, NOT main, k) AS pos FROM c{i} JOIN w{i} ON s0 = split AND k0 = {cls} AND m0 = main AND took = multi AND c{i}.j = w{i}.j)"""


_L0 = Q.replace("WITH", "WITH RECURSIVE", 1) + ", l0 AS (SELECT doc_id, s, t, g, m, 0 AS split, doc_id AS pos FROM v), "
_FOUR = _L0 + ", ".join(_level(i, c, x) for i, (c, x) in enumerate((("s", "false"), ("g", "contains(t, ',')"), ("t", "contains(m, ',')"), ("m", "contains(m, ',')")), 1))


@query("split_one_level", _L0 + _level(1, "s", "contains(t, ',')") + " SELECT doc_id, split FROM l1")
def split_one_level(spark, d):
    df = parsed(spark, d).select("doc_id", "s", "t", "g", "m", F.lit(0).alias("split"), F.col("doc_id").alias("pos"))
    return split.stratify(df, (7, 2, 1), "s", F.instr(F.col("t"), ",") > 0).select("doc_id", "split")


@query("split_four_level", _FOUR + " SELECT doc_id, split FROM l4")
def split_four_level(spark, d):
    return split.four_levels(parsed(spark, d))


@query("split_composition", _FOUR + " SELECT ['Train', 'Val', 'Test'][split + 1] AS split, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 2)::DOUBLE AS percent FROM l4 GROUP BY split")
def split_composition(spark, d):
    return split.composition(split.four_levels(parsed(spark, d)))


# text segments: a corpus of files of ten questions each

FILES = Q + ", fl AS (SELECT doc_id // 10 AS file, string_agg(header || chr(10) || coalesce(body, '') || chr(10) || chr(10), chr(10) ORDER BY doc_id) AS text FROM q GROUP BY 1), l AS (SELECT file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM fl)"


def file_lines(spark, d):
    """Lines of files whose parts are documents."""
    q = questions(spark, d).select(F.floor(F.col("doc_id") / 10).alias("file"), "doc_id", F.concat("header", F.lit("\n"), F.coalesce("body", F.lit("")), F.lit("\n\n")).alias("r"))
    return segments.lines(q, "r", "file", part="doc_id")


def _digest(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n_lines", F.md5("text").alias("text_md5"))


RECORD_SQL = "^(\\([^\\n]*?\\) \\([^\\n]*?\\)|\\([^\\n]*?\\) T D [0-9])"


@query("corpus_segments", FILES + f", s AS (SELECT *, sum(CASE WHEN line_no > 1 AND regexp_matches(line, '{RECORD_SQL}') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no) AS record FROM l) SELECT file, record::BIGINT AS record, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text_md5 FROM s GROUP BY file, record")
def corpus_segments(spark, d):
    return _digest(segments.records(file_lines(spark, d), "file"), "file", "record")


@query("raw_segments", FILES + ", s AS (SELECT *, sum(contains(line, '(Science)')::INT) OVER (PARTITION BY file ORDER BY line_no) AS segment FROM l) SELECT file, segment::BIGINT AS segment, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text_md5 FROM s WHERE segment > 0 GROUP BY file, segment")
def raw_segments(spark, d):
    return _digest(segments.raw_segments(file_lines(spark, d), "file", "(Science)"), "file", "segment")


@query("line_chunks", FILES + " SELECT file, (line_no - 1) // 20 AS chunk, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text_md5 FROM l GROUP BY file, chunk")
def line_chunks(spark, d):
    return _digest(segments.chunks(file_lines(spark, d), "file", 20), "file", "chunk")


NARROW_SQL = "^\\([^\\n]*?\\) \\([^\\n]*?\\)"
_SEG = ", s AS (SELECT *, sum(CASE WHEN line_no > 1 AND regexp_matches(line, '{p}') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no) AS record FROM l), r AS (SELECT file, record::BIGINT AS record, regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '^\\s+|\\s+$', '', 'g') AS text, count(*) AS n_lines FROM s GROUP BY file, record)"


@query("narrow_segments", FILES + _SEG.format(p=NARROW_SQL) + " SELECT file, record, n_lines, md5(text) AS text_md5, contains(text, 'Mathematics') AS wanted FROM r WHERE text <> ''")
def narrow_segments(spark, d):
    return segments.records(file_lines(spark, d), "file", narrow=True).select("file", "record", "n_lines", F.md5("text").alias("text_md5"), F.col("text").contains("Mathematics").alias("wanted"))


_PAIRS = FILES + _SEG.format(p=RECORD_SQL) + f", hb AS (SELECT file, record, string_split(text, chr(10))[1] AS header, CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS body FROM r WHERE text <> ''), ph AS (SELECT *, regexp_matches(header, '{headers.HEADER}') AS fits FROM hb)"


@query("corpus_pairs", _PAIRS + f" SELECT file, record, {TYPE} || ' ' || {GRADE} || {MODIFIER} AS instruction, md5(body) AS response_md5, whole <> header AS trailing FROM (SELECT file, record, body, header, regexp_extract(header, h, 0) AS whole, translate(regexp_extract(header, h, 1), '()', '') AS s, translate(regexp_extract(header, h, 2), '()', '') AS t, regexp_extract(header, h, 3) AS g, translate(regexp_extract(header, h, 4), '()', '') AS m FROM ph, (SELECT '{headers.HEADER}' AS h) WHERE fits) v")
def corpus_pairs(spark, d):
    return segments.pairs(file_lines(spark, d), "file")[0].select("file", "record", "instruction", F.md5("response").alias("response_md5"), "trailing")


@query("corpus_pairs_rejected", _PAIRS + " SELECT file, record, header FROM ph WHERE NOT fits")
def corpus_pairs_rejected(spark, d):
    return segments.pairs(file_lines(spark, d), "file")[1]


_SUBJ = "|".join(feeds.SUBJECTS)


@query("sections", FILES + f", s AS (SELECT *, sum(regexp_matches(line, '^\\(({_SUBJ})\\)')::INT) OVER (PARTITION BY file ORDER BY line_no) AS section FROM l) SELECT file, section::BIGINT AS section, regexp_extract(arg_min(line, line_no), '^\\(({_SUBJ})\\)', 1) AS subject, (min(line_no) - 1) // 100 AS chunk, count(*) AS n_lines FROM s WHERE section > 0 GROUP BY file, section")
def sections(spark, d):
    return segments.sections(file_lines(spark, d), "file", feeds.SUBJECTS).select("file", "section", "subject", "chunk", "n_lines")


@query("sections_saved", FILES + f", s AS (SELECT *, sum(regexp_matches(line, '^\\(({_SUBJ})\\)')::INT) OVER (PARTITION BY file ORDER BY line_no) AS section FROM l) SELECT file, section::BIGINT AS section, md5(rtrim(string_agg(line, chr(10) ORDER BY line_no), chr(10)) || repeat(chr(10), 3)) AS text_md5 FROM s WHERE section BETWEEN 1 AND 5 GROUP BY file, section")
def sections_saved(spark, d):
    return segments.saved(segments.sections(file_lines(spark, d), "file", feeds.SUBJECTS), 5).select("file", "section", F.md5("text").alias("text_md5"))


@query("subject_contains", Q + " SELECT doc_id FROM (SELECT doc_id, header || chr(10) || coalesce(body, '') AS r FROM q) WHERE contains(r, 'Mathematics')")
def subject_contains(spark, d):
    q = questions(spark, d).select("doc_id", F.concat("header", F.lit("\n"), F.coalesce("body", F.lit(""))).alias("r"))
    return segments.containing(q, "r", "Mathematics").select("doc_id")


# requests

PARTS = "len(regexp_extract_all({x}, '[A-Za-z0-9]{{1,6}}|[^\\sA-Za-z0-9]'))"
TOKENS = f"(SELECT doc_id, source, 3 + 3 + 3 + {PARTS.format(x=chr(39) + 'system' + chr(39))} + {PARTS.format(x=chr(39) + 'Extract the exercise.' + chr(39))} + {PARTS.format(x=chr(39) + 'user' + chr(39))} + {PARTS.format(x='coalesce(text, ' + 2 * chr(39) + ')')} AS tokens FROM documents)"


def _requests(spark, d):
    return t(spark, d, "documents").select("doc_id", "source", requests.request(F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string")), "Extract the exercise.", F.col("text")).alias("r"))


def _tokens(spark, d):
    return _requests(spark, d).select("doc_id", "source", requests.message_tokens(F.col("r")["body"]["messages"]).alias("tokens"))


@query("request_fanout", "SELECT 'synthetic2_from_example' || item_id AS custom_id, r AS repeat, md5('Write one like this: ' || text) AS content_md5 FROM benchmark, range(100) x(r)")
def request_fanout(spark, d):
    return requests.fan_out(t(spark, d, "benchmark"), 100, 2, "Write one like this: ", "item_id", "text").select("custom_id", F.col("repeat").cast("long").alias("repeat"), F.md5("content").alias("content_md5"))


@query("request_json", "SELECT doc_id, source || '_' || doc_id AS custom_id, 'POST' AS method, '/v1/chat/completions' AS url, 'gpt-4o' AS model, 0.3::DOUBLE AS temperature, 3000 AS max_tokens, 'system' AS role0, 'Extract the exercise.' AS content0, 'user' AS role1, md5(text) AS content1_md5 FROM documents")
def request_json(spark, d):
    raw = _requests(spark, d).select("doc_id", F.to_json("r").alias("j"))
    g = lambda p: F.get_json_object("j", f"$.{p}")
    return raw.select("doc_id", g("custom_id").alias("custom_id"), g("method").alias("method"), g("url").alias("url"), g("body.model").alias("model"), g("body.temperature").cast("double").alias("temperature"), g("body.max_tokens").cast("int").alias("max_tokens"), g("body.messages[0].role").alias("role0"), g("body.messages[0].content").alias("content0"), g("body.messages[1].role").alias("role1"), F.md5(g("body.messages[1].content")).alias("content1_md5"))


@query("request_patch", "SELECT doc_id, 'system' AS role0, 'A new prompt.' AS content0, md5(text) AS content1_md5 FROM documents")
def request_patch(spark, d):
    m = _requests(spark, d).select("doc_id", requests.patched(F.col("r"), "A new prompt.")["body"]["messages"].alias("m"))
    return m.select("doc_id", F.col("m")[0]["role"].alias("role0"), F.col("m")[0]["content"].alias("content0"), F.md5(F.col("m")[1]["content"]).alias("content1_md5"))


@query("token_count", f"SELECT doc_id, tokens FROM {TOKENS}")
def token_count(spark, d):
    return _tokens(spark, d).select("doc_id", "tokens")


PACK = f"""WITH RECURSIVE x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM {TOKENS}),
 r AS (SELECT source, doc_id, tokens, i, 1::BIGINT AS batch_id, tokens AS total FROM x WHERE i = 1
  UNION ALL SELECT x.source, x.doc_id, x.tokens, x.i, r.batch_id + CASE WHEN r.total + x.tokens >= 5000 THEN 1 ELSE 0 END, CASE WHEN r.total + x.tokens >= 5000 THEN x.tokens ELSE r.total + x.tokens END FROM r JOIN x ON x.source = r.source AND x.i = r.i + 1)"""


def _packed(spark, d):
    return requests.pack(_tokens(spark, d), "source", "doc_id", "tokens", 5000)


@query("token_pack", PACK + " SELECT source, doc_id, tokens, batch_id FROM r")
def token_pack(spark, d):
    return _packed(spark, d)


@query("pack_summary", PACK + " SELECT source, batch_id, count(*) AS items, sum(tokens)::BIGINT AS tokens FROM r GROUP BY source, batch_id")
def pack_summary(spark, d):
    return requests.batch_summary(_packed(spark, d), "source", "tokens")


NAMED = "9 + CASE WHEN source IS NULL THEN 0 ELSE 1 END + " + " + ".join(PARTS.format(x=x) for x in ("'system'", "'Extract the exercise.'", "'user'", "coalesce(source, '')", "coalesce(text, '')")).replace("{{", "{").replace("}}", "}")


@query("token_count_named", f"SELECT doc_id, {NAMED} AS tokens FROM documents")
def token_count_named(spark, d):
    m = lambda role, content, name: F.struct(F.lit(role).alias("role"), content.alias("content"), name.alias("name"))
    messages = F.array(m("system", F.lit("Extract the exercise."), F.lit(None).cast("string")), m("user", F.col("text"), F.col("source")))
    return t(spark, d, "documents").select("doc_id", requests.message_tokens(messages, named=True).alias("tokens"))


@query("token_count_parts", f"SELECT item_id, 3 + 3 + {PARTS.format(x=chr(39) + 'user' + chr(39))} + {PARTS.format(x='text')} AS tokens FROM benchmark")
def token_count_parts(spark, d):
    """Parts with an image and a text: the text counts."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    message = F.struct(F.lit("user").alias("role"), F.array(part("image_url", F.lit(None).cast("string")), part("text", F.col("text"))).alias("content"))
    return t(spark, d, "benchmark").select("item_id", requests.message_tokens(F.array(message), parts=True).alias("tokens"))


@query("image_request", "SELECT item_id, 'image_url' AS kind, 'http://h/' || item_id AS url FROM benchmark")
def image_request(spark, d):
    body = requests.request(F.col("item_id").cast("string"), "Read it.", F.to_json(requests.image_part(F.concat(F.lit("http://h/"), F.col("item_id").cast("string")))))
    content = body["body"]["messages"][1]["content"]
    return t(spark, d, "benchmark").select("item_id", F.get_json_object(content, "$[0].type").alias("kind"), F.get_json_object(content, "$[0].image_url.url").alias("url"))


@query("request_lines", "SELECT 'synthetic2_from_example' || item_id AS custom_id, count(*) AS n, md5('Write one like this: ' || text) AS content_md5 FROM benchmark, range(100) GROUP BY item_id, text")
def request_lines(spark, d):
    made = requests.fan_out(t(spark, d, "benchmark"), 100, 2, "Write one like this: ", "item_id", "text")
    lines = requests.request_lines(made, "Be brief.").select("custom_id", F.md5(F.get_json_object("value", "$.body.messages[1].content")).alias("content_md5"))
    return lines.groupBy("custom_id", "content_md5").agg(F.count("*").alias("n"))


@query("job_results", "SELECT 'job' || doc_id % 7 AS job_id, 'a_' || doc_id AS custom_id, md5(text) AS content_md5 FROM documents WHERE doc_id % 7 IN (2, 5)")
def job_results(spark, d):
    body = F.struct(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")).alias("body"))
    raw = F.to_json(F.struct(F.concat(F.lit("a_"), F.col("doc_id").cast("string")).alias("custom_id"), body.alias("response")))
    results = t(spark, d, "documents").select(F.concat(F.lit("job"), (F.col("doc_id") % 7).cast("string")).alias("job_id"), raw.alias("raw"))
    jobs = spark.createDataFrame([("job2",), ("job5",), ("job5",), ("job99",)], "job_id string")
    return requests.results_of(jobs, results).select("job_id", "custom_id", F.md5("content").alias("content_md5"))


@query("without_fence", "SELECT item_id, '{\"a\": ' || text || '}' AS text FROM benchmark")
def without_fence(spark, d):
    return t(spark, d, "benchmark").select("item_id", requests.without_fence(F.concat(F.lit('```json\n{"a": '), "text", F.lit("}\n```"))).alias("text"))


OCR = "SELECT doc_id, 'Science_' || (doc_id % 12 + 1) || CASE WHEN doc_id % 10 = 3 THEN '' ELSE '_0' END AS custom_id, 'x*NEW*' || coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN '*NEW*again' ELSE '' END AS content FROM documents"


def _ocr(spark, d):
    i = F.col("doc_id")
    return t(spark, d, "documents").select("doc_id", F.concat(F.lit("Science_"), (i % 12 + 1).cast("string"), F.when(i % 10 == 3, "").otherwise("_0")).alias("custom_id"), F.concat(F.lit("x*NEW*"), F.coalesce("text", F.lit("")), F.when(i % 3 == 0, "*NEW*again").otherwise("")).alias("content"))


@query("ocr_explode", f"WITH o AS ({OCR}), e AS (SELECT custom_id, unnest(string_split(content, '*NEW*')) AS body, generate_subscripts(string_split(content, '*NEW*'), 1) - 1 AS place FROM o WHERE len(string_split(custom_id, '_')) = 3) SELECT custom_id, place::INTEGER AS place, md5('(' || string_split(custom_id, '_')[1] || ') T D ' || string_split(custom_id, '_')[2] || ' M' || chr(10) || body) AS record_md5 FROM e WHERE place > 0")
def ocr_explode(spark, d):
    return requests.ocr_records(_ocr(spark, d), "custom_id", "content").select("custom_id", "place", F.md5("record").alias("record_md5"))


@query("response_content", f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE md5(content) END AS content_md5 FROM ({OCR})")
def response_content(spark, d):
    o = _ocr(spark, d)
    good = F.to_json(F.struct("custom_id", F.struct(F.struct(F.array(F.struct(F.struct("content").alias("message"))).alias("choices")).alias("body")).alias("response")))
    raw = F.when(F.col("doc_id") % 7 == 0, "{broken").otherwise(good)
    return o.select("doc_id", F.md5(requests.response_content(raw)).alias("content_md5"))


# conversations

U = "CASE WHEN regexp_matches(replace(message, '<\\/U>', '</U>'), '(?s)<U>.*?</U>') THEN regexp_extract(replace(message, '<\\/U>', '</U>'), '(?s)<U>(.*?)</U>', 1) END"
E = "CASE WHEN regexp_matches(message, '(?s)<E>.*?</E>') THEN regexp_extract(message, '(?s)<E>(.*?)</E>', 1) WHEN contains(message, '<E>') THEN regexp_extract(message, '(?s)<E>(.*)', 1) END"
CT = C + f""", u AS (SELECT *, {U} AS txt, {E} AS ex FROM c),
 k AS (SELECT *, ex IS NOT NULL AND regexp_matches(ex, '''R'': (True|False)') AS parsable, contains(ex, '}}, {{') AS multi, regexp_matches(ex, '''R'': True}}\\)?$') AS ready FROM u),
 x AS (SELECT *, sender = 'gpt' AND txt IS NOT NULL AND ex IS NOT NULL AS called FROM k),
 y AS (SELECT *, CASE WHEN called AND NOT parsable THEN 1 WHEN txt IS NULL AND ex IS NULL THEN 1 ELSE 0 END AS bad,
  CASE WHEN (sender = 'gpt' AND txt IS NULL AND ex IS NOT NULL) OR (sender = 'human' AND ex IS NOT NULL) THEN 'tool' WHEN sender = 'gpt' THEN 'assistant' ELSE 'user' END AS role FROM x),
 st AS (SELECT conv_id, sum(bad) AS bad, bool_or(called AND parsable AND multi) AS anymulti FROM y GROUP BY conv_id),
 ok AS (SELECT y.conv_id, turn, role, CASE WHEN role = 'tool' THEN ex WHEN called AND ready THEN NULL ELSE txt END AS content, called AND parsable AND ready AS calls, multi, anymulti FROM y JOIN st ON y.conv_id = st.conv_id WHERE st.bad = 0)"""


def _conv(spark, d):
    return feeds.feed(spark, feeds.CONVERSATIONS, conversations=t(spark, d, "conversations"))


def _cleaned(spark, d, only=None):
    out = conversation.clean(_conv(spark, d), only=only)
    return out.select("conv_id", "turn", "role", F.md5("content").alias("content_md5"), F.coalesce(F.size("params"), F.lit(0)).alias("calls"))


_CLEAN = " SELECT conv_id, turn, role, md5(content) AS content_md5, CASE WHEN NOT calls OR calls IS NULL THEN 0 WHEN multi THEN 2 ELSE 1 END AS calls FROM ok"


@query("role_map", "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'assistant' ELSE role END AS role FROM conversations")
def role_map(spark, d):
    wire = t(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role")).alias("from"))
    return wire.select("conv_id", "turn", conversation.role_mapped(F.col("from")).alias("role"))


@query("chat_render", "SELECT conv_id, md5(string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10))) AS text_md5 FROM conversations GROUP BY conv_id")
def chat_render(spark, d):
    c = t(spark, d, "conversations")
    return conversation.rendered(c, "conv_id", "turn", F.col("role"), F.col("text")).select("conv_id", F.md5("text").alias("text_md5"))


@query("conv_extract_params", CT + " SELECT conv_id, turn, md5(ex) AS expert_md5, md5(txt) AS text_md5 FROM y")
def conv_extract_params(spark, d):
    m = F.col("message")
    return _conv(spark, d).select("conv_id", "turn", F.md5(F.get(conversation.expert_parts(m), F.lit(0))).alias("expert_md5"), F.md5(conversation.user_text(m)).alias("text_md5"))


@query("conv_clean", CT + _CLEAN)
def conv_clean(spark, d):
    return _cleaned(spark, d)


@query("conv_multi_only", CT + _CLEAN + " WHERE anymulti")
def conv_multi_only(spark, d):
    return _cleaned(spark, d, "multi")


@query("conv_single_only", CT + _CLEAN + " WHERE NOT anymulti")
def conv_single_only(spark, d):
    return _cleaned(spark, d, "single")


@query("tool_call_args", CT + " SELECT conv_id, turn, CASE WHEN multi THEN 'Math,Biology' ELSE 'Math' END AS subjects, CASE WHEN multi THEN '4,5' ELSE (conv_id % 12 + 1)::VARCHAR END AS grades, true AS ready FROM ok WHERE calls")
def tool_call_args(spark, d):
    c = conversation.clean(_conv(spark, d)).where("params is not null").select("conv_id", "turn", conversation.arguments(F.col("params")).alias("a"))
    return c.select("conv_id", "turn", F.array_join("a.subjects", ",").alias("subjects"), F.array_join("a.grade_levels", ",").alias("grades"), "a.ready")


@query("tool_conversations", CT + " SELECT conv_id, count(*) AS n, count(*) FILTER (calls) AS n_calls FROM ok GROUP BY conv_id")
def tool_conversations(spark, d):
    m = conversation.tool_conversations(conversation.clean(_conv(spark, d)))
    return m.select("conv_id", F.size("messages").cast("long").alias("n"), F.size(F.filter("messages", lambda x: x["tool_calls"].isNotNull())).cast("long").alias("n_calls"))


NESTED = CT + """, fin AS (SELECT conv_id, turn, CASE WHEN anymulti THEN 'multi' ELSE 'single' END AS kind, coalesce(role, '') || ':' || coalesce(content, '-') || ':' || CASE WHEN NOT calls OR calls IS NULL THEN 0 WHEN multi THEN 2 ELSE 1 END AS said FROM ok WHERE anymulti OR conv_id % 13 + 1 = 13 OR conv_id % 2 = 0)"""


@query("conv_corpora", NESTED + " SELECT kind, conv_id, count(*) AS n, md5(string_agg(said, chr(10) ORDER BY turn)) AS messages_md5 FROM fin GROUP BY kind, conv_id")
def conv_corpora(spark, d):
    """Nested conversations to clean training data: single parameter sets of some files, several sets of all."""
    nested = _conv(spark, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "sender", "message"))), lambda x: F.struct(x["sender"].alias("from"), x["message"].alias("value"))).alias("conversations"))
    turns = conversation.exploded(nested.withColumn("file", F.col("conv_id") % 13 + 1 + F.when(F.col("conv_id") % 2 == 0, 100).otherwise(0)))
    found = conversation.corpora(turns, "file", [13, *range(101, 114)], [*range(1, 14), *range(101, 114)])
    said = F.transform("messages", lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(":"), F.coalesce(m["content"], F.lit("-")), F.lit(":"), F.coalesce(F.size(m["tool_calls"][0]["function"]["arguments"]["subjects"]), F.lit(0)).cast("string")))
    return found.select("kind", "conv_id", F.size("messages").cast("long").alias("n"), F.md5(F.array_join(said, "\n")).alias("messages_md5"))


@query("conv_turns", C + " SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, sender, md5(message) AS message_md5 FROM c")
def conv_turns(spark, d):
    nested = _conv(spark, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "sender", "message"))), lambda x: F.struct(x["sender"].alias("from"), x["message"].alias("value"))).alias("conversations"))
    return conversation.exploded(nested).select("conv_id", F.col("turn").cast("long").alias("turn"), "sender", F.md5("message").alias("message_md5"))


REPLY = "'Sure. {\"name\": \"generate_exercise\", \"parameters\": {\"subjects\": [\"Math\", \"S' || item_id || '\"], \"exercise_types\": [\"Quiz\"], \"grade_levels\": [], \"modifications\": null, \"ready\": ' || CASE WHEN item_id % 2 = 0 THEN 'true' ELSE 'false' END || '}}'"


@query("tool_call_parsed", "SELECT item_id, CASE WHEN item_id % 5 = 0 THEN NULL ELSE 'Math,S' || item_id END AS subjects, CASE WHEN item_id % 5 = 0 THEN NULL ELSE item_id % 2 = 0 END AS ready FROM benchmark")
def tool_call_parsed(spark, d):
    reply = F.when(F.col("item_id") % 5 == 0, F.col("text")).otherwise(F.expr(REPLY.replace("\\", "\\\\")))
    return t(spark, d, "benchmark").select("item_id", conversation.call_parameters(reply).alias("p")).select("item_id", F.array_join("p.subjects", ",").alias("subjects"), "p.ready")


@query("mock_exercises", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'More parameters are needed.' WHEN p_size % 2 = 0 THEN 'one,one,one' END AS items FROM part")
def mock_exercises(spark, d):
    subjects = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("Math"))).otherwise(F.array(F.lit("Art")))
    items = conversation.mock_exercise(subjects, [F.lit(1), F.lit(3)], F.col("p_size") % 3 != 0, {"Math": "one", "English": "two"})
    return t(spark, d, "part").select("p_partkey", F.array_join(items, ",").alias("items"))


@query("grades_tidied", "SELECT p_partkey, '{' || chr(39) || 'G' || chr(39) || ': ' || CASE WHEN p_size % 14 BETWEEN 1 AND 11 THEN (p_size % 14)::VARCHAR ELSE chr(39) || (p_size % 14) || chr(39) END || '} ' AS text FROM part")
def grades_tidied(spark, d):
    text = F.concat(F.lit("{'G': '"), (F.col("p_size") % 14).cast("string"), F.lit("'} <U> "))
    return t(spark, d, "part").select("p_partkey", conversation.tidy_grades(text).alias("text"))


@query("chat_render_system", "SELECT conv_id, md5('<|system|>' || chr(10) || 'Be brief.' || chr(10) || string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10))) AS text_md5 FROM conversations GROUP BY conv_id")
def chat_render_system(spark, d):
    c = t(spark, d, "conversations")
    return conversation.rendered(c, "conv_id", "turn", F.col("role"), F.col("text"), system="Be brief.").select("conv_id", F.md5("text").alias("text_md5"))


# layout

NEAR = "(abs({eb} - {ea}) <= 15 AND {lb} BETWEEN {la} - 15 AND {ha} + 15 AND {hb} BETWEEN {la} - 15 AND {ha} + 15)"
_X = {"lb": "b2.x0", "hb": "b2.x1", "la": "b1.x0", "ha": "b1.x1"}
_Y = {"lb": "b2.y0", "hb": "b2.y1", "la": "b1.y0", "ha": "b1.y1"}
CLOSE = f"CASE WHEN b2.y0 >= b1.y1 THEN {NEAR.format(eb='b2.y0', ea='b1.y1', **_X)} WHEN b2.y1 <= b1.y0 THEN {NEAR.format(eb='b2.y1', ea='b1.y0', **_X)} WHEN b2.x1 <= b1.x0 THEN {NEAR.format(eb='b2.x1', ea='b1.x0', **_Y)} WHEN b2.x0 >= b1.x1 THEN {NEAR.format(eb='b2.x0', ea='b1.x1', **_Y)} ELSE true END"


def _blocks(spark, d):
    return feeds.feed(spark, feeds.BLOCKS, lineitem=t(spark, d, "lineitem"))


@query("blocks_close", B + f" SELECT b1.page_id, b1.block_no, b2.block_no AS near_no FROM b b1 JOIN b b2 ON b1.page_id = b2.page_id AND b1.block_no <> b2.block_no WHERE {CLOSE}")
def blocks_close(spark, d):
    return layout.close_pairs(_blocks(spark, d))


@query("blocks_combined", B + " SELECT page_id, string_agg(text, chr(10) ORDER BY block_no, text) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b GROUP BY page_id")
def blocks_combined(spark, d):
    return layout.combined(_blocks(spark, d))


@query("near_edges", B + " SELECT page_id, block_no, y0 <= 200 AS near_top, page_height - y1 <= 200 AS near_bottom FROM b")
def near_edges(spark, d):
    return layout.near_edges(_blocks(spark, d))


@query("page_ranges", "WITH r AS (SELECT p_partkey AS range_id, p_partkey * 7 AS start, p_partkey * 7 + p_size % 5 AS stop FROM part) SELECT o_orderkey AS page, range_id, start, stop FROM orders JOIN r ON o_orderkey BETWEEN start + 2 AND stop + 2")
def page_ranges(spark, d):
    k = F.col("p_partkey")
    ranges = t(spark, d, "part").select(k.alias("range_id"), (k * 7).alias("start"), (k * 7 + F.col("p_size") % 5).alias("stop"))
    return layout.pages_in_ranges(t(spark, d, "orders").select(F.col("o_orderkey").alias("page")), ranges, "page", 2).select("page", "range_id", "start", "stop")


@query("images_stacked", "SELECT l_orderkey, arg_min(l_linenumber * 10, l_linenumber)::BIGINT AS width, arg_min(l_linenumber + 20, l_linenumber)::BIGINT * count(*) AS height, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def images_stacked(spark, d):
    images = t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("image_no"), (F.col("l_linenumber") * 10).cast("long").alias("width"), (F.col("l_linenumber") + 20).cast("long").alias("height"))
    return layout.stacked(images, "l_orderkey")


@query("pages_by_range", "WITH r AS (SELECT p_partkey AS range_id, p_partkey * 7 AS start, p_partkey * 7 + p_size % 5 AS stop FROM part) SELECT range_id, count(*) AS n, min(o_orderkey) AS first_page, max(o_orderkey) AS last_page FROM orders JOIN r ON o_orderkey BETWEEN start + 2 AND stop + 2 GROUP BY range_id")
def pages_by_range(spark, d):
    """One row a range: the pages that make up its image."""
    k = F.col("p_partkey")
    ranges = t(spark, d, "part").select(k.alias("range_id"), (k * 7).alias("start"), (k * 7 + F.col("p_size") % 5).alias("stop"))
    found = layout.pages_in_ranges(t(spark, d, "orders").select(F.col("o_orderkey").alias("page")), ranges, "page", 2)
    return found.groupBy("range_id").agg(F.count("*").alias("n"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


@query("page_image_names", "SELECT p_partkey, 'Science_' || (p_size % 12) || '_' || ((power(10, p_size % 4)::BIGINT + 1) * p_partkey + 1) AS name FROM part")
def page_image_names(spark, d):
    return t(spark, d, "part").select("p_partkey", layout.page_image_name(F.lit("Science"), (F.col("p_size") % 12).cast("string"), F.col("p_size") % 4, F.col("p_partkey")).alias("name"))


# mark-up

MARKED = "concat('_', {w}, '_ x *', {w}, '* and **', {w}, '** y _', {w}, '_ z *', {w}, '-a* .')"


@query("latex_format", "SELECT p_partkey, '_w' || p_partkey || '_ x \\emph{w' || p_partkey || '} and \\textbf{w' || p_partkey || '} y \\underline{w' || p_partkey || '} z *w' || p_partkey || '-a* .' AS text FROM part")
def latex_format(spark, d):
    """Marks at the text's start and around more than a word stay."""
    return spread(t(spark, d, "part")).select("p_partkey", markup.to_latex_words(F.expr(MARKED.format(w="concat('w', p_partkey)"))).alias("text"))


@query("latex_sections", "SELECT p_partkey, p_name || chr(10) || '\\section{Answers}' || chr(10) || '\\section{Solution} ' || p_type AS text, 'With Answer,With Solution' AS tags FROM part")
def latex_sections(spark, d):
    x = F.concat("p_name", F.lit("\nAnswers\nSolution "), "p_type")
    return spread(t(spark, d, "part")).select("p_partkey", markup.sections_to_latex(x).alias("text"), F.array_join(markup.section_tags(x), ",").alias("tags"))


@query("brackets_removed", "SELECT p_partkey, replace(replace(p_name, '(', ''), ')', '') || p_type || p_brand AS text FROM part")
def brackets_removed(spark, d):
    return t(spark, d, "part").select("p_partkey", markup.without_brackets(F.concat(F.lit("(["), "p_name", F.lit("]{"), "p_type", F.lit("}"), "p_brand", F.lit(")"))).alias("text"))


@query("type_detected", "SELECT p_partkey, '(Science) (' || left(trim(p_type), 40) || ') D 4 M' AS header, chr(10) || p_name AS body FROM part")
def type_detected(spark, d):
    h, b = markup.detected_type(F.lit("(Science) T D 4 M"), F.concat(F.lit("\n[ "), "p_type", F.lit("]\n"), "p_name"))
    return t(spark, d, "part").select("p_partkey", F.replace(h, F.lit("( "), F.lit("(")).alias("header"), b.alias("body"))


@query("list_formatted", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '\\begin{enumerate}' || chr(10) || '\\item ' || p_name || chr(10) || '\\item ' || p_type || chr(10) || '\\end{enumerate}' ELSE '\\begin{enumerate}' || chr(10) || '\\item 1. ' || p_name || chr(10) || '\\item ! ' || p_type || chr(10) || '\\end{enumerate}' END AS text FROM part")
def list_formatted(spark, d):
    x = F.concat(F.lit("1. "), "p_name", F.lit("\n"), F.when(F.col("p_size") % 2 == 0, "b) ").otherwise("! "), "p_type")
    return t(spark, d, "part").select("p_partkey", markup.formatted_list(x).alias("text"))


_LIST = "'\\begin{enumerate}' || chr(10) || '\\item ' || trim(regexp_replace(p_name, '[0-9]', '', 'g')) || chr(10) || '\\item ' || trim(regexp_replace(p_type, '[0-9]', '', 'g')) || chr(10) || '\\end{enumerate}' || chr(10)"


def _listed() -> F.Column:
    return F.concat(F.lit("1. "), F.regexp_replace("p_name", r"\d", ""), F.lit("\n2. "), F.regexp_replace("p_type", r"\d", ""), F.lit("\n"))


@query("lists_to_latex", f"SELECT p_partkey, {_LIST} AS text FROM part")
def lists_to_latex(spark, d):
    return spread(t(spark, d, "part")).select("p_partkey", markup.lists_to_latex(_listed()).alias("text"))


@query("latex_document", f"SELECT p_partkey, '(Science) (Essay) D ' || CASE WHEN p_size % 12 + 1 > 9 THEN '(' || (p_size % 12 + 1) || ')' ELSE (p_size % 12 + 1)::VARCHAR END || CASE WHEN p_size % 2 = 0 THEN ' (With Hint, With Answer)' ELSE ' (With Answer)' END || chr(10) || {_LIST} || chr(10) || '\\section{{Answers}}' || chr(10) || chr(10) || 'x \\emph{{y}} z' AS text FROM part")
def latex_document(spark, d):
    head = F.concat(F.lit("(Science) (Essay) D "), (F.col("p_size") % 12 + 1).cast("string"), F.when(F.col("p_size") % 2 == 0, " (With Hint)").otherwise(" M"), F.lit("\n"))
    return spread(t(spark, d, "part")).select("p_partkey", markup.to_latex(F.concat(head, _listed(), F.lit("\nAnswers\n  \nx *y* z"))).alias("text"))


@query("replaced_all", "SELECT p_partkey, replace(p_name || p_name, 'a', 'aa') AS text FROM part")
def replaced_all(spark, d):
    return t(spark, d, "part").select("p_partkey", markup.replaced_all(F.concat("p_name", "p_name"), "a", "aa").alias("text"))


@query("text_wrapped", "SELECT p_partkey, '\\textbf{' || p_name || '}\\textit{' || p_type || '}\\underline{' || p_brand || '}' AS text FROM part")
def text_wrapped(spark, d):
    parts = [markup.wrapped(F.col(c), k) for c, k in (("p_name", "textbf"), ("p_type", "textit"), ("p_brand", "underline"))]
    return t(spark, d, "part").select("p_partkey", F.concat(*parts).alias("text"))


_NAMES = SPLIT.format(c="translate({m}, '()', '')")


def _tag_sql(m: str, tag: str, shown: str) -> str:
    names = _NAMES.format(m=m)
    return f"(CASE WHEN list_has_any({names}, ['{tag}', '{tag}s']) AND NOT {shown} THEN CASE WHEN len(list_filter({names}, lambda z: z NOT IN ('{tag}', '{tag}s'))) = 0 THEN 'M' ELSE '(' || list_aggregate(list_filter({names}, lambda z: z NOT IN ('{tag}', '{tag}s')), 'string_agg', ', ') || ')' END WHEN NOT list_has_any({names}, ['{tag}', '{tag}s']) AND {shown} THEN CASE WHEN {m} = 'M' THEN '({tag})' ELSE '(' || list_aggregate({names}, 'string_agg', ', ') || ', {tag})' END ELSE {m} END)"


@query("tags_reconciled", Q + ", w AS (SELECT doc_id, whole, header, regexp_extract(header, h, 4) AS m0, doc_id % 4 = 0 AS ans, doc_id % 6 = 0 AS fig FROM v), x AS (SELECT *, " + _tag_sql("m0", "With Answer", "ans") + " AS m1 FROM w), y AS (SELECT *, " + _tag_sql("m1", "With Illustration", "fig") + " AS m2 FROM x) SELECT doc_id, CASE WHEN length(whole) = length(header) THEN left(header, length(header) - length(m0)) || m2 ELSE header END AS header FROM y")
def tags_reconciled(spark, d):
    i = F.col("doc_id")
    body = F.concat(F.lit("x"), F.when(i % 4 == 0, markup.ANSWERS).otherwise(""), F.when(i % 6 == 0, markup.FIGURE).otherwise(""))
    return parsed(spark, d).select("doc_id", markup.reconciled(F.col("header"), body).alias("header"))


@query("first_number", "SELECT p_partkey, nullif(regexp_extract(p_brand || p_name, '[0-9]+', 0), '') AS number FROM part")
def first_number(spark, d):
    return t(spark, d, "part").select("p_partkey", markup.first_number(F.concat("p_brand", "p_name")).alias("number"))


# sessions, unions, samples


@query("session_history", "SELECT user_id, count(*) AS n, md5(string_agg(event_type, ',' ORDER BY ts, event_id, event_type)) AS history_md5 FROM events GROUP BY user_id")
def session_history(spark, d):
    return sessions.history(t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "n", F.md5(F.array_join("messages", ",")).alias("history_md5"))


@query("session_known", "SELECT event_id, user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) AS known FROM events")
def session_known(spark, d):
    ids = t(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"))
    good, refused = sessions.known(t(spark, d, "events"), ids, "user_id")
    return good.select("event_id", F.lit(True).alias("known")).unionByName(refused.select("event_id", F.lit(False).alias("known")))


@query("session_latency", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY user_id")
def session_latency(spark, d):
    return sessions.latency(t(spark, d, "events"), "user_id", "value")


@query("union_sources", "SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT source, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY source")
def union_sources(spark, d):
    both = t(spark, d, "documents").select("source", "text").unionByName(t(spark, d, "benchmark").select(F.lit("benchmark").alias("source"), "text"))
    return both.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


DRAW = "('0x' || substr(md5('7:' || {k}), 1, 8))::BIGINT"


@query("seeded_sample", f"SELECT doc_id FROM documents WHERE {DRAW.format(k='doc_id')} < {int(0.1 * (1 << 32))}")
def seeded_sample(spark, d):
    """A tenth of the documents for evaluation, by a hash of seed and id: the same rows on any cluster."""
    return conversation.sampled(t(spark, d, "documents"), "doc_id", 0.1, 7)[1].select("doc_id")


@query("shuffle_order", f"SELECT item_id, row_number() OVER (ORDER BY {DRAW.format(k='item_id')}, item_id) AS place FROM benchmark")
def shuffle_order(spark, d):
    """The place of each item in a seeded shuffle."""
    drawn = t(spark, d, "benchmark").select("item_id", conversation.draw(F.col("item_id"), 7).alias("draw"))
    return ranks.ranked(drawn, [], ["draw", "item_id"], "place").select("item_id", "place")


@query("next_subject", Q + ", o AS (SELECT doc_id, s, lead(s) OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) AS nx FROM v) SELECT doc_id, nx AS next_subject FROM o WHERE nx IS NOT NULL AND nx <> s")
def next_subject(spark, d):
    w = Window.partitionBy(F.floor(F.col("doc_id") / 100)).orderBy("doc_id")
    return parsed(spark, d).select("doc_id", "s", F.lead("s").over(w).alias("next_subject")).where("next_subject <> s").select("doc_id", "next_subject")


_F = Q.replace("WITH", "WITH RECURSIVE", 1) + ", " + _alias_sql("m")
SQL["fuzzy_pairs"] = _F + " SELECT label, other, round(score, 6) AS score FROM fm"
SQL["fuzzy_alias"] = _F + " SELECT * FROM alm"
SQL["counts_after_alias"] = _F + " SELECT label, cnt FROM ncm"

# labels as arrays, articles, large files, one group, literals, templates, groups of blocks


@query("combo_arrays", Q + f" SELECT s, types, g, modifiers, count(*) AS cnt, min(doc_id) AS first_pos FROM (SELECT doc_id, trim(s) AS s, list_aggregate({SPLIT.format(c='t')}, 'string_agg', '|') AS types, trim(g) AS g, list_aggregate({SPLIT.format(c='m')}, 'string_agg', '|') AS modifiers FROM v) GROUP BY ALL")
def combo_arrays(spark, d):
    return labels.combinations(parsed(spark, d)).withColumns({"types": F.array_join("types", "|"), "modifiers": F.array_join("modifiers", "|")})


_WORDS = ", ".join(f"({i}, '{w}', '{a}')" for i, (w, a) in enumerate(feeds.ARTICLES.items()))


@query("articles", f"WITH w(i, word, article) AS (VALUES {_WORDS}) SELECT p_partkey, article || ' ' || word || ' ' || p_name AS text FROM part JOIN w ON p_partkey % {len(feeds.ARTICLES)} = i")
def articles(spark, d):
    words = F.array(*map(F.lit, feeds.ARTICLES))
    phrase = F.concat_ws(" ", F.element_at(words, (F.col("p_partkey") % len(feeds.ARTICLES) + 1).cast("int")), "p_name")
    return t(spark, d, "part").select("p_partkey", instruct.with_article(phrase).alias("text"))


SOURCES = Q + ", sl AS (SELECT source, doc_id, unnest(string_split(r, chr(10))) AS line, generate_subscripts(string_split(r, chr(10)), 1) AS i FROM (SELECT source, q.doc_id, header || chr(10) || coalesce(body, '') || chr(10) AS r FROM q JOIN documents ON q.doc_id = documents.doc_id)), l AS (SELECT source, line, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) AS line_no FROM sl)"


def source_lines(spark, d):
    """Lines of one large file a source, whose parts are documents."""
    documents = t(spark, d, "documents").select("source", "doc_id", "text")
    q = feeds.feed(spark, feeds.QUESTIONS.replace("SELECT doc_id,", "SELECT source, doc_id,"), documents=documents)
    return segments.lines(q.select("source", "doc_id", F.concat("header", F.lit("\n"), F.coalesce("body", F.lit("")), F.lit("\n")).alias("r")), "r", "source", part="doc_id")


@query("source_segments", SOURCES + f", s AS (SELECT *, sum(CASE WHEN line_no > 1 AND regexp_matches(line, '{RECORD_SQL}') THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY line_no) AS record FROM l) SELECT source, record::BIGINT AS record, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text_md5 FROM s GROUP BY source, record")
def source_segments(spark, d):
    return _digest(segments.records(source_lines(spark, d), "source"), "source", "record")


@query("source_chunks", SOURCES + " SELECT source, (line_no - 1) // 100 AS chunk, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text_md5 FROM l GROUP BY source, chunk")
def source_chunks(spark, d):
    return _digest(segments.chunks(source_lines(spark, d), "source", 100), "source", "chunk")


@query("token_pack_one", PACK.replace("PARTITION BY source ORDER BY doc_id", "ORDER BY doc_id").replace("x.source = r.source AND ", "") + " SELECT doc_id, tokens, batch_id FROM r")
def token_pack_one(spark, d):
    """All requests are one group."""
    return requests.pack(_tokens(spark, d).withColumn("every", F.lit(1)), "every", "doc_id", "tokens", 5000).select("doc_id", "tokens", "batch_id")


_TWO = "turn % 3 = 0"
_SETS = {
    "n": f"CASE WHEN {_TWO} THEN 2 ELSE 1 END",
    "subjects_md5": f"md5('None of ' || text || CASE WHEN {_TWO} THEN '|' || text ELSE '' END)",
    "types": f"'''R'': False, None' || CASE WHEN {_TWO} THEN '|True: {{{{(),' ELSE '' END".replace("{{", "{"),
    "grades": f"(turn + 1)::VARCHAR || CASE WHEN {_TWO} THEN '|4' ELSE '' END",
    "modifiers": f"CASE WHEN {_TWO} THEN 'it''s é' ELSE '' END",
    "ready": f"{_TWO} OR turn % 2 = 1",
}
_READ = "SELECT conv_id, turn, " + ", ".join(f"CASE WHEN text IS NOT NULL THEN {sql} END AS {name}" for name, sql in _SETS.items()) + " FROM conversations"


@query("conv_literals", _READ)
def conv_literals(spark, d):
    """Parameter sets from literals with quotes, constants and keys inside their values."""
    read = feeds.feed(spark, feeds.LITERALS, conversations=t(spark, d, "conversations"))
    sets = read.select("conv_id", "turn", conversation.parameters(F.col("literal")).alias("p"))
    joined = lambda k: F.array_join(F.transform("p", lambda x: x[k]), "|")
    return sets.select("conv_id", "turn", F.size("p").alias("n"), F.md5(joined("S")).alias("subjects_md5"), joined("T").alias("types"), joined("G").alias("grades"), joined("M").alias("modifiers"), F.element_at("p", -1)["R"].alias("ready"))


_ROLE, _SAID, _ORDERED = "coalesce(role, '')", "coalesce(text, '')", "ORDER BY turn, role, text"


def _messages(spark, d, *more):
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "conv_id")))
    message = lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"), *[m(x) for m in more])
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.transform(listed, message).alias("messages"))


@query("chat_template_tagged", f"SELECT conv_id, md5(string_agg('<|' || {_ROLE} || '|>' || chr(10) || {_SAID} || chr(10), '' {_ORDERED})) AS text_md5 FROM conversations GROUP BY conv_id")
def chat_template_tagged(spark, d):
    return _messages(spark, d).select("conv_id", F.md5(templates.compiled(templates.TAGGED)(messages=F.col("messages"))).alias("text_md5"))


_TRIMMED = "regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')"


@query("chat_template_instruct", f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id {_ORDERED}) AS i FROM conversations) SELECT conv_id, md5(string_agg(CASE WHEN role = 'system' THEN '<<SYS>>' || {_TRIMMED} || '<</SYS>>' WHEN role = 'user' THEN CASE WHEN i > 1 THEN ' ' ELSE '' END || '[INST] ' || {_TRIMMED} || ' [/INST]' ELSE ' ' || {_TRIMMED} || '</s>' END, '' ORDER BY i)) AS text_md5 FROM n GROUP BY conv_id")
def chat_template_instruct(spark, d):
    return _messages(spark, d).select("conv_id", F.md5(templates.compiled(templates.INSTRUCT)(messages=F.col("messages"))).alias("text_md5"))


_CALL = """'generate_exercise {"subjects":["Math","S' || conv_id || '"],"ready":' || CASE WHEN turn % 4 = 1 THEN 'true' ELSE 'false' END || '}'"""


@query("chat_template_tools", f"SELECT conv_id, md5('<begin>' || string_agg('[' || upper({_ROLE}) || ']' || chr(10) || CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN {_CALL} || '; ' || {_CALL} WHEN role = 'assistant' AND turn % 4 = 3 THEN {_CALL} ELSE coalesce(text, '-') END || '<end>' || chr(10), '' {_ORDERED}) || '[ASSISTANT]' || chr(10)) AS text_md5 FROM conversations GROUP BY conv_id")
def chat_template_tools(spark, d):
    """Tool calls of assistants, one or two a message, and a prompt for the next one."""

    def calls(x):
        subjects = F.array(F.lit("Math"), F.concat(F.lit("S"), x["conv_id"].cast("string")))
        call = F.struct(F.struct(F.lit("generate_exercise").alias("name"), F.struct(subjects.alias("subjects"), (x["turn"] % 4 == 1).alias("ready")).alias("arguments")).alias("function"))
        return F.when(x["role"] == "assistant", F.when(x["turn"] % 4 == 1, F.array(call, call)).when(x["turn"] % 4 == 3, F.array(call))).alias("tool_calls")

    return _messages(spark, d, calls).select("conv_id", F.md5(templates.compiled(templates.HEADERS)(messages=F.col("messages"), prompt=F.lit(True))).alias("text_md5"))


_REACH = f""", e AS (SELECT b1.page_id, b1.block_no AS a, b2.block_no AS b FROM b b1 JOIN b b2 ON b1.page_id = b2.page_id AND b1.block_no <> b2.block_no WHERE {CLOSE}),
 both_ways AS (SELECT page_id, a, b FROM e UNION SELECT page_id, b, a FROM e), reach AS (SELECT page_id, block_no AS a, block_no AS b FROM b UNION SELECT r.page_id, r.a, x.b FROM reach r JOIN both_ways x ON r.page_id = x.page_id AND r.b = x.a),
 low AS (SELECT page_id, a, min(b) AS group_no FROM reach GROUP BY ALL)
 SELECT b.page_id, group_no, count(*) AS n_blocks, string_agg(text, chr(10) ORDER BY block_no, text) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b JOIN low ON b.page_id = low.page_id AND block_no = a GROUP BY b.page_id, group_no"""


@query("blocks_grouped", B.replace("WITH", "WITH RECURSIVE", 1) + _REACH)
def blocks_grouped(spark, d):
    return layout.groups(_blocks(spark, d))


_MORE_TURNS = """WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role,
 CASE WHEN role = 'assistant' THEN NULL ELSE text || CASE conv_id % 4 WHEN 0 THEN ' Two more, please.' WHEN 1 THEN ' and 3  additional ones' WHEN 2 THEN ' some MORE' ELSE ' no moretwo' END END AS content,
 CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN conv_id % 3 + 1 END AS n FROM {conversations})"""


@query("more_checked", _MORE_TURNS.format(conversations="conversations") + ", a AS (SELECT *, CASE WHEN role = 'user' AND content IS NOT NULL THEN CASE conv_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 0 END END AS asked, coalesce(first_value(n IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS given FROM c) SELECT conv_id, turn, asked, given, CASE WHEN asked > 0 THEN given = asked ELSE given >= 2 END AS fits FROM a WHERE asked IS NOT NULL")
def more_checked(spark, d):
    """Turns that ask for more, against the parameter sets of the next call."""
    t(spark, d, "conversations").createOrReplaceTempView("feed_conversations")
    turns = spark.sql(_MORE_TURNS.format(conversations="feed_conversations") + " SELECT conv_id, turn, role, content, n FROM c")
    return conversation.more_checked(turns.withColumn("params", F.when(F.col("n").isNotNull(), F.array_repeat(F.lit("x"), F.col("n").cast("int")))))


@query("pixels_stacked", "SELECT l_suppkey, count(*) AS n, 2 AS width, 2 * count(*) AS height, md5(string_agg(repeat(printf('%02X%02X%02X', (l_partkey % 256)::INTEGER, (l_orderkey % 256)::INTEGER, l_linenumber::INTEGER), 4), '' ORDER BY l_orderkey, l_linenumber, l_partkey)) AS pixels_md5 FROM lineitem GROUP BY l_suppkey")
def pixels_stacked(spark, d):
    """An image of two by two pixels an item, those of a supplier below each other."""
    pair = lambda c: F.lpad(F.hex((F.col(c) % 256).cast("long")), 2, "0")
    content = F.concat(F.encode(F.lit("P6\n2 2\n255\n"), "us-ascii"), F.unhex(F.repeat(F.concat(pair("l_partkey"), pair("l_orderkey"), pair("l_linenumber")), 4)))
    place = (F.col("l_orderkey").cast("decimal(38,0)") * 1000 + F.col("l_linenumber")) * 1_000_000_000 + F.col("l_partkey")
    images = t(spark, d, "lineitem").select("l_suppkey", F.lpad(place.cast("string"), 38, "0").alias("place"), content.alias("content"))
    stacked = pixels.stacked(images, "l_suppkey", "place", "content").withColumn("x", pixels.decoded(F.col("png")))
    return stacked.select("l_suppkey", "n", "width", "height", F.md5(F.hex("x.pixels")).alias("pixels_md5"))
