"""Mark-up over a table that is read in one task."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import markup
from tessera.plans import queries


def test_mark_up_is_dealt_out(spark, tmp_path):
    parts = spark.range(200).select(F.col("id").alias("p_partkey"), F.format_string("name %d x", "id").alias("p_name"), F.lit("SMALL TIN").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size"))
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for name in ("latex_document", "lists_to_latex", "latex_format", "latex_sections"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        assert got.rdd.getNumPartitions() >= 4, name
        assert got.count() == 200 and got.select("p_partkey").distinct().count() == 200
    texts = {r["p_partkey"]: r["text"] for r in queries.QUERIES["latex_document"](spark, str(tmp_path)).collect()}
    assert texts[8] == "(Science) (Essay) D 9 (With Hint, With Answer)\n\\begin{enumerate}\n\\item name  x\n\\item SMALL TIN\n\\end{enumerate}\n\n\\section{Answers}\n\nx \\emph{y} z"


def test_headers_are_taken_apart_once(spark):
    plan = spark.range(1).select(markup.to_latex(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
