"""Feeds derived from the driver's tables, in SQL that Spark and DuckDB both read.

``{documents}`` and the like stand for tables. Whole numbers only, so both give the same strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The subject domain.
SUBJECTS = ("Computer Science", "Science", "Mathematics", "Social Studies", "History", "Geography", "Spanish", "French", "German", "Dutch", "English")
_S = " ".join(f"WHEN {i} THEN '({s})'" for i, s in enumerate(SUBJECTS))

#: A question corpus: header ``S T D G M`` and body; every 17th header is broken, every 23rd has a trailing word.
QUESTIONS = f"""
SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN concat(s, ' Quiz D ', g, ' ', m) ELSE concat(s, ' ', t, ' D ', g, ' ', m, CASE WHEN doc_id % 23 = 0 THEN ' extra' ELSE '' END) END AS header, text AS body
FROM (SELECT doc_id, text,
  CASE WHEN doc_id % 19 = 0 THEN 'S' ELSE CASE doc_id % 11 {_S} END END AS s,
  CASE doc_id % 7 WHEN 0 THEN 'T' WHEN 1 THEN '(Word Problem)' WHEN 2 THEN '(Short Answer)' WHEN 3 THEN '(Word Problem, Short Answer)' WHEN 4 THEN '(Essay)' WHEN 5 THEN '(Reading Exercise, Essay)' ELSE '(Reading Exercises, Word Problems, Essay)' END AS t,
  CASE WHEN doc_id % 13 = 0 THEN 'G' ELSE CAST(doc_id % 12 + 1 AS VARCHAR(10)) END AS g,
  CASE doc_id % 9 WHEN 0 THEN 'M' WHEN 1 THEN '(With Answer)' WHEN 2 THEN '(With Hint, With Answer)' WHEN 3 THEN '(Multi-part)' WHEN 4 THEN '(With Illustration, With Marks)' WHEN 5 THEN '(Exercise about fractions)' WHEN 6 THEN '(Exercise about fraction, With Hint)' WHEN 7 THEN '(Question with reasoning)' ELSE '(With Prerequisites, With Context, With Material)' END AS m
  FROM {{documents}}) x
"""

#: Tagged conversations: expert parameters on every 5th turn of an assistant, some broken ones.
CONVERSATIONS = """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'human' WHEN role = 'assistant' THEN 'gpt' ELSE 'human' END AS sender,
  CASE WHEN conv_id % 29 = 7 AND turn = 1 THEN text
       WHEN role <> 'assistant' AND turn % 4 = 3 THEN '<E>' || text || '</E>'
       WHEN role <> 'assistant' THEN '<U>' || text || '</U>'
       WHEN conv_id % 31 = 5 THEN '<U>' || text || '</U> <E>{{''S'' None}}</E>'
       WHEN turn % 5 = 1 THEN '<U>' || text || '</U> <E>{{''S'': ''Math'', ''T'': ''Essay'', ''G'': ' || CAST(conv_id % 12 + 1 AS VARCHAR(10)) || ', ''M'': None, ''R'': ' || CASE WHEN turn % 2 = 1 THEN 'True' ELSE 'False' END || '}}</E>'
       WHEN turn % 5 = 3 AND conv_id % 3 = 0 THEN '<U>' || text || '</U> <E>({{''S'': ''Math'', ''T'': ''Essay'', ''G'': 4, ''M'': None, ''R'': True}}, {{''S'': ''Biology'', ''T'': ''Quiz'', ''G'': 5, ''M'': ''Hint'', ''R'': True}})</E>'
       WHEN turn % 7 = 5 THEN '<E>' || text
       ELSE '<U>' || text || '<' || chr(92) || '/U>' END AS message
FROM {conversations}"""

#: Parameter sets as Python literals, one or two a turn, whose values look like constants, keys and brackets, and hold quotes and line breaks.
LITERALS = """
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '(' || one || ', ' || two || ')' ELSE one END AS literal
FROM (SELECT conv_id, turn,
  '{{''S'': ''None of ' || replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(39), chr(92) || chr(39)), chr(10), chr(92) || 'n') || ''', "T": "''R'': False, None", ''G'': ' || CAST(turn + 1 AS VARCHAR(10)) || ', ''M'': None, ''R'': ' || CASE WHEN turn % 2 = 1 THEN 'True' ELSE 'False' END || '}}' AS one,
  '{{"S": "' || replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') || '", ''T'': ''True: {{(),'', ''G'': ''4'', ''M'': "it''s ' || chr(92) || 'u00e9", ''R'': true, }}' AS two
  FROM {conversations}) x"""

#: Words whose article goes by sound, with it.
ARTICLES = {
    "unimportant": "an", "uninteresting": "an", "unit": "a", "university": "a", "unidentified": "an", "unidirectional": "a", "umbrella": "an", "usual": "a", "unusual": "an", "usher": "an", "urine": "a", "urgent": "an",
    "one-day": "a", "onerous": "an", "onion": "an", "once": "a", "hour": "an", "hotel": "a", "honest": "an", "history": "a", "heir": "an", "hero": "a", "euro": "a", "eel": "an", "ewe": "a", "year": "a", "yttrium": "an",
    "X-ray": "an", "T-shirt": "a", "U-turn": "a", "8": "an", "80": "an", "11th": "an", "18,000": "an", "100": "a", "1": "a", "180": "a", "MCQ": "an", "FAQ": "an", "USB": "a", "PDF": "a", "SQL": "an", "NASA": "a", "EU": "an", "essay": "an", "quiz": "a", "école": "an", "word": "a",
}

#: Questions with some hundred modifier labels, many of them a letter or two apart, so that aliases chain.
MANY_LABELS = """
SELECT doc_id, '(Science)' AS s, CASE doc_id % 5 WHEN 0 THEN '(Essay, Essays)' WHEN 1 THEN '(Reading Exercise)' WHEN 2 THEN '(Reading Exercises, Short Answer)' WHEN 3 THEN '(Short Answers)' ELSE 'T' END AS t, CAST(doc_id % 12 + 1 AS VARCHAR(10)) AS g,
  '(Topic ' || substr('badofugilekoranimuposetivaxy', CAST(1 + 2 * (doc_id % 11) AS INTEGER), 6) || substr('cuhemiroqazy', CAST(1 + 2 * (doc_id % 3) AS INTEGER), 4) || repeat('s', CAST((doc_id * 7) % 5 AS INTEGER)) || CASE WHEN doc_id % 3 = 0 THEN ', With Hint' ELSE '' END || ')' AS m
FROM {documents}
"""

#: Layout blocks: a page an order, a block a line item.
BLOCKS = """
SELECT l_orderkey AS page_id, l_linenumber AS block_no, concat('block ', CAST(l_partkey AS VARCHAR(20))) AS text,
  CAST((l_partkey % 5) * 60 AS DOUBLE) AS x0, CAST((l_linenumber - 1) * 40 + l_suppkey % 30 AS DOUBLE) AS y0,
  CAST((l_partkey % 5) * 60 + 50 AS DOUBLE) AS x1, CAST((l_linenumber - 1) * 40 + l_suppkey % 30 + 20 AS DOUBLE) AS y1, CAST(400 AS DOUBLE) AS page_height
FROM {lineitem}
"""


def feed(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """A feed in Spark, from the tables that its braces name."""
    names = {}
    for name, df in tables.items():
        names[name] = f"feed_{name}"
        df.createOrReplaceTempView(names[name])
    return spark.sql(sql.format(**names))
