"""Queries that write what they work out and read it back, and those of plugged functions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import grammar
from tessera.operators import conversation, requests
from tessera.plans.registry import query, t
from tessera.sources import text
from tessera.streaming import results


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one of spark.checkpoint.dir; only a local session may do without that."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{where or 'file://' + tempfile.gettempdir() + '/checkpoints'}/{name}-{uuid.uuid4().hex}"


def _pairs(spark, d):
    """A null text counts as empty."""
    return t(spark, d, "documents").select(F.concat(F.lit('Say "'), F.col("doc_id").cast("string"), F.lit('", please')).alias("instruction"), F.coalesce("text", F.lit("")).alias("response"))


_PAIRS = "SELECT 'Say \"' || doc_id || '\", please' AS instruction, md5({text}) AS response_md5 FROM documents"


@query("pairs_csv", _PAIRS.format(text="coalesce(text, '')"))
def pairs_csv(spark, d):
    """Pairs through the csv sink, line breaks and quotes included."""
    path = folder(spark, "pairs")
    text.write_pairs(_pairs(spark, d), path, "csv")
    return spark.read.csv(path, header=True, multiLine=True, escape='"', schema="Input string, Output string", lineSep="\n").select(F.col("Input").alias("instruction"), F.md5("Output").alias("response_md5"))


@query("pairs_jsonl", _PAIRS.format(text="coalesce(text, '')"))
def pairs_jsonl(spark, d):
    path = folder(spark, "pairs")
    text.write_pairs(_pairs(spark, d), path, "json")
    return text.read_jsonl(spark, path).select("instruction", F.md5("response").alias("response_md5"))


@query("pairs_txt", _PAIRS.format(text="replace(coalesce(text, ''), chr(10), '|')"))
def pairs_txt(spark, d):
    """Pairs as text records, parted by two blank lines."""
    path = folder(spark, "pairs")
    text.write_pairs(_pairs(spark, d).withColumn("response", F.replace("response", F.lit("\n"), F.lit("|"))), path, "txt")
    lines = F.split("value", "\n", 2)
    return text.read_records(spark, path).select(lines[0].alias("instruction"), F.md5(lines[1]).alias("response_md5"))


@query("json_documents", "SELECT item_id, md5(text) AS text_md5 FROM benchmark")
def json_documents(spark, d):
    """Files that hold one JSON array each."""
    path = folder(spark, "arrays")
    rows = t(spark, d, "benchmark").select((F.col("item_id") % 5).alias("file"), F.struct("item_id", "text").alias("r"))
    rows.groupBy("file").agg(F.to_json(F.collect_list("r")).alias("value")).select("value", "file").write.partitionBy("file").text(path)
    return text.read_json_document(spark, path, "item_id long, text string").select("item_id", F.md5("text").alias("text_md5"))


@query("splits_written", "SELECT CASE WHEN doc_id % 10 < 7 THEN 0 WHEN doc_id % 10 < 9 THEN 1 ELSE 2 END AS split, md5(doc_id || ' ' || replace(coalesce(text, ''), chr(10), '|')) AS record_md5 FROM documents")
def splits_written(spark, d):
    path, k = folder(spark, "splits"), F.col("doc_id") % 10
    rows = t(spark, d, "documents").select(F.concat_ws(" ", F.col("doc_id").cast("string"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("|"))).alias("text"), F.when(k < 7, 0).when(k < 9, 1).otherwise(2).alias("split"))
    text.write_splits(rows, path)
    return spark.read.option("lineSep", text.BREAK).text(path).select(F.col("split").cast("int").alias("split"), F.md5("value").alias("record_md5"))


@query("conversations_written", "SELECT conv_id, md5(string_agg(coalesce(role, '-') || ':' || coalesce(text, '-'), chr(10) ORDER BY turn)) AS said_md5 FROM conversations GROUP BY conv_id")
def conversations_written(spark, d):
    """Conversations as JSON lines, mixed with a seed, and read again."""
    path = folder(spark, "conversations")
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "conv_id")))
    message = lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"), F.when(x["turn"] == 0, x["conv_id"].cast("string")).alias("name"))
    made = t(spark, d, "conversations").groupBy("conv_id").agg(F.transform(listed, message).alias("messages"), F.min("turn").alias("first")).select("messages", "conv_id")
    parts = [made.where(F.col("conv_id") % 2 == k) for k in (0, 1)]
    text.write_conversations(conversation.mixed(*parts, seed=5).withColumn("messages", F.transform("messages", lambda m: m.withField("name", F.col("conv_id").cast("string")))), path)
    read = text.read_jsonl(spark, path, "messages array<struct<role:string,content:string,name:string>>")
    said = F.transform("messages", lambda m: F.concat_ws(":", F.coalesce(m["role"], F.lit("-")), F.coalesce(m["content"], F.lit("-"))))
    return read.select(F.col("messages")[0]["name"].cast("long").alias("conv_id"), F.md5(F.array_join(said, "\n")).alias("said_md5"))


@query("results_combined", "SELECT 'r' || doc_id AS custom_id, md5(text) AS content_md5 FROM documents")
def results_combined(spark, d):
    """Result lines of seven jobs, each delivered twice, as one table of JSON lines."""
    path = folder(spark, "results")
    body = F.struct(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")).alias("body"))
    raw = F.to_json(F.struct(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("custom_id"), body.alias("response")))
    lines = t(spark, d, "documents").select(F.concat(F.lit("job"), (F.col("doc_id") % 7).cast("string")).alias("job_id"), raw.alias("raw"))
    results.combine(lines.unionAll(lines), path)
    one = spark.read.text(path)
    return one.select(F.get_json_object("value", "$.custom_id").alias("custom_id"), F.md5(requests.response_content(F.col("value"))).alias("content_md5"))


# plugged functions


@query("imperatives", "SELECT doc_id, coalesce(length(string_split(text, ' ')[1]) % 2 = 0 AND NOT coalesce(length(string_split(text, ' ')[2]) % 3 = 0, false), false) AND coalesce(text, '') <> '' AS imperative FROM documents")
def imperatives(spark, d):
    """A tagger of the caller's: the first word is the root, a verb if its length is even; the second may be its subject."""

    def make():
        def tag(sentence):
            words = sentence.split(" ")[:2]
            return [("VB" if len(words[0]) % 2 == 0 else "NN", "ROOT", 0), *[("PRP", "nsubj" if len(w) % 3 == 0 else "obj", 0) for w in words[1:]]]

        return tag

    return t(spark, d, "documents").select("doc_id", grammar.has_imperative(make)(F.col("text")).alias("imperative"))


@query("token_count_plugged", "SELECT doc_id, 3 + 3 + 4 + length(coalesce(text, '')) AS tokens FROM documents")
def token_count_plugged(spark, d):
    """A tokenizer of the caller's, here one token a character."""
    lengths = requests.counted_by(lambda texts: [len(x) for x in texts])
    messages = F.array(requests.message("user", F.col("text")))
    return t(spark, d, "documents").select("doc_id", requests.message_tokens(messages, all_tokens=lengths).alias("tokens"))


@query("calls_balanced", "SELECT p_partkey, p_size % 3 = 1 AS balanced FROM part")
def calls_balanced(spark, d):
    """Whether the four lists of a tool call have equal length; one of them has as many elements as the size leaves."""
    some = F.array_repeat(F.lit("x"), (F.col("p_size") % 3).cast("int"))
    one = F.array(F.lit("y"))
    call = F.to_json(F.struct(F.lit(conversation.TOOL).alias("name"), F.struct(one.alias("subjects"), some.alias("exercise_types"), one.alias("grade_levels"), one.alias("modifications"), F.lit(True).alias("ready")).alias("parameters")))
    reply = F.concat(F.lit("Here:\n"), F.replace(call, F.lit('"name":'), F.lit('"name": ')))
    return t(spark, d, "part").select("p_partkey", conversation.balanced(conversation.call_parameters(reply)).alias("balanced"))


def _bleu_sql() -> str:
    """Corpus BLEU of two cuts of each text: clipped n-grams and brevity, written out."""
    grams = "SELECT k, doc_id, gram, count(*) AS n FROM (SELECT k, doc_id, unnest(list_transform(range(1, len({c}) - k + 2), lambda i: array_to_string({c}[i:i + k - 1], ' '))) AS gram FROM w, range(1, 5) x(k)) GROUP BY ALL"
    words = "list_filter(string_split_regex({x}, '\\s+'), lambda x: x <> '')"
    return f"""WITH w AS (SELECT doc_id, {words.format(x="coalesce(left(text, 300), '')")} AS h, {words.format(x="coalesce(substr(text, 20, 300), '')")} AS r FROM documents),
 gh AS ({grams.format(c='h')}), gr AS ({grams.format(c='r')}),
 p AS (SELECT gh.k, sum(least(gh.n, coalesce(gr.n, 0)))::DOUBLE / sum(gh.n) AS share FROM gh LEFT JOIN gr ON gh.k = gr.k AND gh.doc_id = gr.doc_id AND gh.gram = gr.gram GROUP BY gh.k),
 s AS (SELECT sum(len(h)) AS hl, sum(len(r)) AS rl FROM w)
 SELECT round(CASE WHEN hl >= rl THEN 1 ELSE exp(1 - rl::DOUBLE / hl) END * exp((SELECT sum(ln(share)) / 4 FROM p)), 9) AS bleu FROM s"""


@query("corpus_bleu", _bleu_sql())
def corpus_bleu(spark, d):
    cuts = t(spark, d, "documents").select(F.substr("text", F.lit(1), F.lit(300)).alias("h"), F.substr("text", F.lit(20), F.lit(300)).alias("r"))
    return requests.corpus_bleu(cuts, "h", "r").select(F.round("bleu", 9).alias("bleu"))
