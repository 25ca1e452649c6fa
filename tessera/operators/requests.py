"""Model requests and responses: building, patching, token budgets, flattening."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessera.operators.packs import packed

#: Fixed values of a request.
TEMPERATURE, MAX_TOKENS, BUDGET = 0.3, 3000, 420_000
#: Jobs whose ids are broadcast at most.
LISTED = 10_000
RESPONSE = "struct<custom_id:string,response:struct<body:struct<choices:array<struct<message:struct<content:string>>>>>>"


def message(role: Column | str, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def request(custom_id: Column, system: str, content: Column, model: str = "gpt-4o") -> Column:
    """A chat request as a struct."""
    body = F.struct(F.lit(model).alias("model"), F.lit(TEMPERATURE).alias("temperature"), F.lit(MAX_TOKENS).alias("max_tokens"), F.array(message("system", F.lit(system)), message("user", content)).alias("messages"))
    return F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))


def image_part(url: Column) -> Column:
    """The content of a user message that shows an image."""
    return F.array(F.struct(F.lit("image_url").alias("type"), F.struct(url.alias("url")).alias("image_url")))


def patched(req: Column, prompt: str) -> Column:
    """A request whose first message has new content."""
    messages = F.transform(req["body"]["messages"], lambda m, i: F.when(i == 0, message(m["role"], F.lit(prompt))).otherwise(m))
    return req.withField("body.messages", messages)


def fan_out(examples: DataFrame, repeats: int, batch: int, prompt: str, example_id: str, content: str) -> DataFrame:
    """(custom_id, content): every example ``repeats`` times. Repeats are generated in each row, not joined."""
    many = examples.select(example_id, content, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    name = F.concat(F.lit(f"synthetic{batch}_from_example"), F.col(example_id).cast("string"))
    return many.select(name.alias("custom_id"), "repeat", F.concat(F.lit(prompt), F.col(content)).alias("content"))


def count_tokens(text: Column) -> Column:
    """A fixed approximation without a vocabulary: words and single marks, long words by six characters."""
    parts = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9]{1,6}|[^\sA-Za-z0-9]"), F.lit(0))
    return F.size(parts).cast("long")


def counted_by(encode_all: Callable[[list[str]], list[int]]) -> Callable[[Column], Column]:
    """A column function (array of strings -> tokens of all of them) from a tokenizer: a function of many texts to their token counts."""

    @F.pandas_udf(LongType())
    def count(lists: pd.Series) -> pd.Series:
        sizes = [0 if x is None else len(x) for x in lists]
        flat = [t or "" for x in lists if x is not None for t in x]
        tokens = iter(encode_all(flat))
        return pd.Series([sum(next(tokens) for _ in range(n)) for n in sizes], dtype="int64")

    return count


def message_tokens(messages: Column, count=count_tokens, named: bool = False, parts: bool = False, all_tokens: Callable[[Column], Column] | None = None) -> Column:
    """3 a message, the tokens of its values (role, content, name), 1 a name, and 3 at the end; null values count nothing.

    ``count`` is a column function of one text. A tokenizer in Python can't run
    within an array function; it goes in as ``all_tokens`` (see :func:`counted_by`).
    ``named``: messages have a ``name``. ``parts``: content is an array of typed
    parts, of which texts count and images do not.
    """
    content = (lambda m: F.transform(m["content"], lambda p: p["text"])) if parts else (lambda m: F.array(m["content"]))
    values = lambda m: F.array_compact(F.concat(F.array(m["role"]), F.array(m["name"]) if named else F.array().cast("array<string>"), F.coalesce(content(m), F.array().cast("array<string>"))))
    names = F.size(F.filter(messages, lambda m: m["name"].isNotNull())) if named else F.lit(0)
    fixed = (F.lit(3) + 3 * F.size(messages) + names).cast("long")
    every = F.flatten(F.transform(messages, values))
    return fixed + (all_tokens(every) if all_tokens else F.aggregate(F.transform(every, count), F.lit(0).cast("long"), lambda a, x: a + x))


def pack(df: DataFrame, group: str, order: str, tokens: str, budget: int = BUDGET, compat: bool = False) -> DataFrame:
    """``df`` with ``batch_id`` (from 1 in each group): a batch closes before the item that would make it reach the budget.

    See :func:`tessera.operators.packs.packed`; one group of any size is packed by many tasks.
    """
    return packed(df, group, order, tokens, budget, compat)


def request_lines(requests: DataFrame, prompt: str, custom_id: str = "custom_id", content: str = "content", model: str = "gpt-4o") -> DataFrame:
    """(custom_id, value): each row's request as a JSON line, ready to be written."""
    return requests.select(custom_id, F.to_json(request(F.col(custom_id), prompt, F.col(content), model)).alias("value"))


def results_of(jobs: DataFrame, results: DataFrame, job: str = "job_id") -> DataFrame:
    """(job, custom_id, content) of the result lines (job, raw) of listed jobs; lines that are no response have null content."""
    listed = jobs.select(job).distinct()
    few = listed.limit(LISTED + 1).count() <= LISTED  # lines of one job then need not meet in a task
    known = results.join(F.broadcast(listed) if few else listed, job, "left_semi")
    return known.select(job, F.get_json_object("raw", "$.custom_id").alias("custom_id"), response_content(F.col("raw")).alias("content"))


def batch_summary(packed: DataFrame, group: str, tokens: str) -> DataFrame:
    return packed.groupBy(group, "batch_id").agg(F.count("*").alias("items"), F.sum(tokens).alias("tokens"))


def response_content(raw: Column) -> Column:
    """Content of the first choice of a response line, null if there is none; never evaluated as code."""
    return F.from_json(raw, RESPONSE)["response"]["body"]["choices"][0]["message"]["content"]


def without_fence(content: Column, compat: bool = False) -> Column:
    """JSON out of its code fence. ``compat``: its nulls become Python's."""
    bare = F.replace(F.replace(content, F.lit("```json\n"), F.lit("")), F.lit("\n```"), F.lit(""))
    return F.replace(bare, F.lit("null"), F.lit("None")) if compat else bare


def id_parts(custom_id: Column, n: int) -> Column:
    """The parts of an id between underscores, null unless there are ``n``."""
    parts = F.split(custom_id, "_")
    return F.when(F.size(parts) == n, parts)


def ocr_records(df: DataFrame, custom_id: str, content: str) -> DataFrame:
    """(custom_id, place from 1, record): what follows each ``*NEW*`` mark, under a header from the id's subject and grade."""
    parts = id_parts(F.col(custom_id), 3)
    rows = df.where(parts.isNotNull()).select(custom_id, parts.alias("p"), F.posexplode(F.split(content, r"\*NEW\*")).alias("place", "body")).where("place > 0")
    return rows.select(custom_id, "place", F.concat(F.lit("("), F.col("p")[0], F.lit(") T D "), F.col("p")[1], F.lit(" M\n"), F.col("body")).alias("record"))


def corpus_bleu(pairs: DataFrame, hypothesis: str, reference: str, n: int = 4) -> DataFrame:
    """One row: corpus BLEU on white-space words, with clipped n-gram precision and brevity penalty."""
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    rows = pairs.select(words(F.col(hypothesis)).alias("h"), words(F.col(reference)).alias("r"))
    names = ["hl", "rl", *[f"{c}{k}" for k in range(1, n + 1) for c in "xy"]]

    def grams(ws: list[str], k: int) -> Counter:
        return Counter(zip(*[ws[i:] for i in range(k)], strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = dict.fromkeys(names, 0)
            for h, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total["hl"] += len(h)
                total["rl"] += len(r)
                for k in range(1, n + 1):
                    theirs = grams(r, k)
                    total[f"x{k}"] += max(0, len(h) - k + 1)
                    total[f"y{k}"] += sum(min(m, theirs[g]) for g, m in grams(h, k).items() if g in theirs)
            yield pa.RecordBatch.from_pydict({c: [v] for c, v in total.items()})

    # a pair is counted where it is read; a row a batch leaves
    out = rows.mapInArrow(run, ", ".join(f"{c} long" for c in names)).agg(*[F.sum(c).alias(c) for c in names])
    out = out.select("hl", "rl", *[F.when(F.col(f"x{k}") > 0, F.col(f"y{k}") / F.nullif(F.col(f"x{k}"), F.lit(0))).alias(f"p{k}") for k in range(1, n + 1)])
    precision = sum((F.log(F.col(f"p{k}")) for k in range(1, n + 1)), F.lit(0.0)) / n
    brevity = F.when(F.col("hl") >= F.col("rl"), 1.0).otherwise(F.exp(1 - F.col("rl") / F.col("hl")))
    zero = F.coalesce(F.least(*[F.col(f"p{k}") for k in range(1, n + 1)]) <= 0, F.lit(True)) if n > 1 else F.coalesce(F.col("p1") <= 0, F.lit(True))
    return out.select(F.when(zero, 0.0).otherwise(brevity * F.exp(precision)).alias("bleu"))


