"""The queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, graph_dedup, lexical_search, license_scan, near_dedup, nearest, packing, pieces, quality, spelling, token_counts, toxicity, url_filter
from tessera.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~quality.held_out("doc_id"))
    model = quality.fit(documents, labels, "doc_id", "text", "quality")
    scored = quality.score(documents, model, "doc_id", "text")
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), keep_text=True))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), (F.col("decoded") == F.col("text")).alias("round_trip"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~quality.held_out("doc_id"))
    model = toxicity.fit(documents, labels, "doc_id", "text", "toxic")
    return toxicity.severity(documents, model, "doc_id", "text").withColumn("held_out", quality.held_out("doc_id"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_pieces": op2_pieces,
        "op3_toxicity": op3_toxicity,
        "op4_near_dedup": op4_near_dedup,
        "op5_token_counts": op5_token_counts,
        "op6_url_filter": op6_url_filter,
        "op7_graph_dedup": op7_graph_dedup,
        "op8_license_scan": op8_license_scan,
        "op9_packing": op9_packing,
        "op10_nearest": op10_nearest,
        "op11_exact_dedup": op11_exact_dedup,
        "op12_ranked_search": op12_ranked_search,
        "op13_spelling_variants": op13_spelling_variants,
    }


#: Nearest rows by inner product in double precision, ties to the smaller id.
NEAREST_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def _rule_sql(host: str, path: str, what: int) -> str:
    """The longest fitting rule (``what``: 0 its verdict, 1 its text) as one CASE, longest first."""
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r[1]) - len(r[2]), r[0] != "allow", r))
    cases = [f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{(v, h + p)[what]}'" for v, h, p in rules]
    return f"CASE {' '.join(cases)} END"


def _host_sql(url: str) -> str:
    return f"translate(regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _key_sql(url: str) -> str:
    return f"CASE WHEN contains({url}, '://') THEN {_host_sql(url)} || regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1) END"


_quoted = lambda x: x.replace("'", "''")
_PATH = "regexp_extract(coalesce({u}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
URL_SQL = f"""
WITH RECURSIVE links AS (
  SELECT url, regexp_extract(regexp_extract(html, '{_quoted(url_filter.LINK)}', 0), '{_quoted(url_filter.HREF)}', 1) AS target FROM pages WHERE contains(url, '://')
  UNION ALL SELECT url, regexp_extract(regexp_extract(html, '{_quoted(url_filter.REFRESH)}', 0), '{_quoted(url_filter.CONTENT)}', 1) FROM pages WHERE contains(url, '://')
), folders AS (
  SELECT *, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS top, regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1) AS folder FROM links WHERE target <> ''
), absolute AS (
  SELECT url, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target WHEN starts_with(target, '//') THEN 'http:' || target WHEN starts_with(target, '/') THEN top || target
    WHEN starts_with(target, '#') OR regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL ELSE CASE WHEN folder = top THEN top || '/' ELSE folder END || target END AS target FROM folders
), e AS (
  SELECT {_key_sql('url')} AS a, {_key_sql('target')} AS b FROM absolute WHERE target IS NOT NULL
), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (
  SELECT a, a AS b FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a
), said AS (
  SELECT a, {_rule_sql(_host_sql("('x://' || b)"), _PATH.format(u="('x://' || b)"), 0)} AS v FROM reach
), classes AS (
  SELECT a, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS v FROM said GROUP BY a
), p AS (
  SELECT page_id, {_host_sql('url')} AS host, {_PATH.format(u='url')} AS path, {_key_sql('url')} AS k FROM pages
)
SELECT page_id, host, path, {_rule_sql('host', 'path', 1)} AS rule, coalesce({_rule_sql('host', 'path', 0)}, classes.v, 'allow') AS verdict
FROM p LEFT JOIN classes ON p.k = classes.a
"""


def _license_sql() -> str:
    words = ", ".join(f"({t}, {i}, '{w}')" for t, (_, text, _) in enumerate(license_scan.TEMPLATES) for i, w in enumerate(text.split()))
    names = ", ".join(f"({t}, '{label}', '{key}', {license_scan.key_at(text, key)}, {len(key.split())})" for t, (label, text, key) in enumerate(license_scan.TEMPLATES))
    base = []
    for phrase, label in license_scan.BASE.items():
        parts = phrase.split()
        same = " AND ".join(f"words[i + {k}] = '{p}'" for k, p in enumerate(parts, 1))
        base.append(f"SELECT rid, '{label}' AS label, unnest(list_filter(range(len(words)), lambda i: {same})) AS pos FROM d")
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), b AS ({' UNION ALL '.join(base)}), bs AS (
  SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS base FROM b GROUP BY rid
), tw(t, i, word) AS (VALUES {words}), tn(t, label, k, ko, kn) AS (VALUES {names}), w AS (
  SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM d
), f AS (
  SELECT word, count(DISTINCT rid) AS n FROM w WHERE word IN (SELECT word FROM tw) GROUP BY word
), idf AS (
  SELECT v.word, ln(((SELECT count(*) FROM d) + 1) / (coalesce(n, 0) + 1)) + 1e-9 AS weight FROM (SELECT DISTINCT word FROM tw) v LEFT JOIN f ON v.word = f.word
), ranked AS (
  SELECT t, i, tw.word, weight, row_number() OVER (PARTITION BY t ORDER BY weight DESC, i) AS place FROM tw JOIN idf ON tw.word = idf.word
), posting AS (
  SELECT r.t, i, word, weight, i < ko OR i >= ko + kn AS outside FROM ranked r JOIN tn ON r.t = tn.t WHERE place <= {license_scan.INDEXED}
), total AS (SELECT t, sum(weight) AS every, least(count(*), {license_scan.AGREE}) AS least_words, bool_or(outside) AS outer_words FROM posting GROUP BY t), placed AS (
  SELECT w.rid, p.t, w.pos - p.i AS start, sum(p.weight) AS weight, count(DISTINCT p.i) AS agree, bool_or(outside) AS beyond FROM w JOIN posting p ON w.word = p.word GROUP BY ALL
), found AS (
  SELECT placed.rid, max(least(1.0, round(weight / every, 9))) AS score, list_distinct(list(label)) AS more
  FROM placed JOIN total USING (t) JOIN tn USING (t) JOIN d ON d.rid = placed.rid
  WHERE agree >= least_words AND (beyond OR NOT outer_words) AND weight / every >= {license_scan.SHARE} AND start + ko >= 0 AND array_to_string(words[start + ko + 1:start + ko + kn], ' ') = k GROUP BY placed.rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN bs ON d.rid = bs.rid LEFT JOIN found ON d.rid = found.rid
"""


#: Sets of four-word shingles, all pairs that share one, exact similarity, and the smallest id reachable.
NEAR_DEDUP_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingles FROM w
), x AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_have FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM o WHERE 100 * both_have >= 80 * (na + nb - both_have)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT doc_id, len(shingles) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM s LEFT JOIN c ON s.doc_id = c.a
"""


#: Counts and components of links by brute force over all pairs of equal labels.
GRAPH_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a, min(b) AS low FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a
"""


#: Groups of normalised texts.
EXACT_SQL = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS s FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY s) AS kept, sha256(s) AS text_sha256 FROM t
"""


#: Every posting of every item's terms, whole numbers throughout.
RANKED_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents
), d AS (SELECT row_number() OVER () AS rid, doc_id, words, len(words)::BIGINT AS n FROM w WHERE len(words) > 0),
g AS (SELECT count(*)::BIGINT AS every_doc, sum(n)::BIGINT AS every_term FROM d),
p AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(words) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * every_doc + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), g),
i AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), s AS (
  SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * every_doc) // every_term))))::BIGINT AS score
  FROM i JOIN f USING (term) JOIN p USING (term) JOIN d USING (rid), g GROUP BY item_id, rid, doc_id
), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""


#: Words, misspelled by their checksums (a table of remainders and a fold over bytes), their near words by deletions, and forms to the last.
SPELLING_SQL = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS remainders
), found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents
), counted AS (SELECT doc_id, run, count(*) AS times FROM found GROUP BY doc_id, run), bytes AS (
  SELECT run, times, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64]::BIGINT[] END)) AS b FROM counted
), summed AS (
  SELECT run, times, xor(list_reduce(b, lambda c, x: xor(c // 256, remainders[xor(c % 256, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM bytes, crc
), spelled AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, times FROM summed
), w AS (
  SELECT word, sum(times)::BIGINT AS n FROM spelled WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), d AS (
  SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INTEGER AS i FROM w)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word
), best AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM near
), f AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM w LEFT JOIN best ON w.word = best.word AND place = 1
), r AS (
  SELECT word, word AS root FROM w UNION ALL SELECT r.word, f.form FROM r JOIN f ON r.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON f.word = r.word JOIN f last ON r.root = last.word WHERE last.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_near_dedup": NEAR_DEDUP_SQL,
        "op6_url_filter": URL_SQL,
        "op7_graph_dedup": GRAPH_SQL,
        "op8_license_scan": _license_sql(),
        "op10_nearest": NEAREST_SQL,
        "op11_exact_dedup": EXACT_SQL,
        "op12_ranked_search": RANKED_SQL,
        "op13_spelling_variants": SPELLING_SQL,
    }
