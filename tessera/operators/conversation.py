"""Tagged conversations to clean tool-call training data.

Turns carry ``<U>`` text for the user and ``<E>`` parameters for the expert.
Parameters are Python literals; they are read token by token
(:mod:`tessera.functions.literals`), never evaluated.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from tessera.functions import literals

#: The keys of a parameter set, the tool's name, and what JSON shows of values that Python takes as false.
KEYS = ("S", "T", "G", "M", "R")
EMPTY = ("false", "0", "0.0", "-0.0", "", "[]", "{}")
TOOL = "generate_exercise"
#: The arguments of a tool call, all of them required.
ARGUMENTS = StructType([*(StructField(x, ArrayType(StringType())) for x in ("subjects", "exercise_types", "grade_levels", "modifications")), StructField("ready", BooleanType())])
NESTED = "array<struct<`from`:string,value:string>>"


def tool_schema(description: str = "") -> dict:
    """The tool as models are told of it, from :data:`ARGUMENTS`."""
    kinds = {"array": {"type": "array", "items": {"type": "string"}}, "boolean": {"type": "boolean"}}
    properties = {f.name: kinds[f.dataType.typeName()] for f in ARGUMENTS.fields}
    return {"type": "function", "function": {"name": TOOL, "description": description, "parameters": {"type": "object", "properties": properties, "required": list(properties)}}}


def exploded(df: DataFrame, conv: str = "conv_id", nested: str = "conversations") -> DataFrame:
    """Nested conversations (arrays of (from, value)) as a row a turn: other columns, turn from 0, sender, message. Empty ones give none."""
    others = [c for c in df.columns if c != nested]
    return df.select(*others, F.posexplode(nested).alias("turn", "_turn")).select(*others, "turn", F.col("_turn")["from"].alias("sender"), F.col("_turn")["value"].alias("message"))


def corpora(df: DataFrame, file: str, single: list[int], multi: list[int], conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(kind, conv, messages): conversations with single parameter sets of some files, and those with several of others, cleaned."""
    parts = []
    for kind, files in (("single", single), ("multi", multi)):
        some = clean(df.where(F.col(file).isin(files)), conv, turn, only=kind)
        parts.append(tool_conversations(some, conv, turn).select(F.lit(kind).alias("kind"), conv, "messages"))
    return parts[0].unionByName(parts[1])


def expert_parts(message: Column) -> Column:
    """What stands between ``<E>`` and ``</E>``, each; without a closing tag, all to the end."""
    closed = F.regexp_extract_all(message, F.lit("(?s)<E>(.*?)</E>"), F.lit(1))
    rest = F.regexp_extract_all(message, F.lit("(?s)<E>(.*)"), F.lit(1))
    return F.when(F.size(closed) > 0, closed).otherwise(rest)


def user_text(message: Column) -> Column:
    """The first text for the user, null if there is none."""
    normal = F.replace(message, F.lit("<\\/U>"), F.lit("</U>"))
    return F.when(normal.rlike("(?s)<U>.*?</U>"), F.regexp_extract(normal, "(?s)<U>(.*?)</U>", 1))


def parameters(literal: Column) -> Column:
    """Parameter sets of a dict or tuple of dicts, as texts and whether they are ready; null if it is none or lacks a key.

    Values that are no text are what JSON shows of them; a set is ready unless
    its ``R`` is what Python takes as false.
    """
    return parameter_sets(literals.literal(literal))


def parameter_sets(value: Column) -> Column:
    """:func:`parameters` of a literal that is read already."""
    listed = F.when(value["kind"] == literals.DICT, F.concat(F.lit("["), value["json"], F.lit("]"))).when(value["kind"] == literals.TUPLE, value["json"])
    sets = F.from_json(listed, "array<map<string,string>>")
    whole = F.forall(sets, lambda p: F.coalesce(reduce(and_, [F.map_contains_key(p, k) for k in KEYS]), F.lit(False)))
    ready = lambda p: F.coalesce(~F.trim(p["R"]).isin(*EMPTY), F.lit(False))
    return F.when((F.size(sets) > 0) & whole, F.transform(sets, lambda p: F.struct(*[p[k].alias(k) for k in KEYS[:4]], ready(p).alias("R"))))


def turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", sender: str = "sender", message: str = "message") -> DataFrame:
    """One row a turn: role, content, tool parameters, and why its conversation must go (null if it need not)."""
    text, expert = user_text(F.col(message)), expert_parts(F.col(message))
    first = F.get(expert, F.lit(0))
    base = df.select(conv, turn, F.col(sender).alias("sender"), text.alias("text"), first.alias("expert"), literals.literal(first).alias("literal"))
    base = base.withColumns({"params": parameter_sets(F.col("literal")), "tuple": F.col("literal.kind") == literals.TUPLE})
    gpt, human = F.col("sender") == "gpt", F.col("sender") == "human"
    called = gpt & F.col("text").isNotNull() & F.col("expert").isNotNull()
    ready = called & F.element_at("params", -1)["R"]
    tool = (gpt & F.col("text").isNull() & F.col("expert").isNotNull()) | (human & F.col("expert").isNotNull())
    role = F.when(tool, "tool").when(gpt, "assistant").when(human, "user")
    content = F.when(tool, F.col("expert")).when(ready, None).otherwise(F.col("text"))
    why = (
        F.when(called & F.col("params").isNull(), "parameters")
        .when(gpt & F.col("text").isNull() & F.col("expert").isNull(), "nothing for user or expert")
        .when(human & F.col("text").isNull() & F.col("expert").isNull(), "no text")
    )
    return base.select(conv, turn, role.alias("role"), F.when(tool, TOOL).alias("name"), content.alias("content"), F.when(ready, F.col("params")).alias("params"), (called & F.col("tuple") & F.col("params").isNotNull()).alias("multi"), why.alias("reject"))


def arguments(params: Column) -> Column:
    """Parallel lists of a call; it is ready if its last set is."""
    each = lambda k: F.transform(params, lambda p: p[k])
    return F.struct(each("S").alias("subjects"), each("T").alias("exercise_types"), each("G").alias("grade_levels"), each("M").alias("modifications"), F.element_at(params, -1)["R"].alias("ready"))


def clean(df: DataFrame, conv: str = "conv_id", turn: str = "turn", only: str | None = None, **names: str) -> DataFrame:
    """Turns of conversations without a dirty turn. ``only``: "multi" or "single" parameter sets."""
    every = turns(df, conv, turn, **names)
    state = every.groupBy(conv).agg(F.count("reject").alias("bad"), F.max("multi").alias("some"))
    good = state.where((F.col("bad") == 0) & {None: F.lit(True), "multi": F.col("some"), "single": ~F.col("some")}[only])
    return every.join(good.select(conv), conv, "left_semi").drop("reject", "multi")


def tool_conversations(cleaned: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, messages): one row a conversation, messages in order, ready to be written as JSON without nulls."""
    calls = F.when(F.col("params").isNotNull(), F.array(F.struct(F.lit("function").alias("type"), F.struct(F.lit(TOOL).alias("name"), arguments(F.col("params")).alias("arguments")).alias("function"))))
    rows = cleaned.select(conv, F.struct(F.col(turn).alias("_turn"), F.struct("role", "name", "content", calls.alias("tool_calls")).alias("m")).alias("x"))
    return rows.groupBy(conv).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["m"]).alias("messages"))


def role_mapped(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("human"), F.lit("user")), F.lit("gpt"), F.lit("assistant"))


def rendered(df: DataFrame, conv: str, turn: str, role: Column, content: Column, system: str | None = None) -> DataFrame:
    """(conv, text): turns in a plain chat template, after a system message if given; nulls show as nothing."""
    shown = lambda x: F.coalesce(x, F.lit(""))
    piece = F.concat(F.lit("<|"), shown(role), F.lit("|>\n"), shown(content), F.lit("\n"))
    rows = df.select(conv, F.struct(F.col(turn).alias("t"), piece.alias("p")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"]), "")
    head = F.lit(f"<|system|>\n{system}\n" if system else "")
    return rows.groupBy(conv).agg(F.concat(head, body).alias("text"))


def tool_call_of(reply: Column) -> Column:
    """The JSON of a tool call in a reply, null if there is none."""
    return F.when(reply.contains(f'"name": "{TOOL}"'), F.regexp_extract(reply, r"(?s)\{.*\}", 0))


def call_parameters(reply: Column) -> Column:
    """The parameters of a tool call in a reply, as :data:`ARGUMENTS`; null if there is none or it is no JSON. Never evaluated."""
    return F.from_json(tool_call_of(reply), StructType([StructField("name", StringType()), StructField("parameters", ARGUMENTS)]))["parameters"]


def balanced(arguments: Column) -> Column:
    """Whether the four lists of a call have equal length."""
    sizes = [F.size(arguments[f.name]) for f in ARGUMENTS.fields[:4]]
    return F.greatest(*sizes) == F.least(*sizes)


def mock_exercise(subjects: Column, sizes: list[Column], ready: Column, items: dict[str, str]) -> Column:
    """The stand-in generator: the item of the first subject that occurs, once for each of the longest list's elements."""
    out = F.lit(None).cast("array<string>")
    for name, item in reversed(items.items()):
        out = F.when(F.array_join(subjects, ",").contains(name), F.array_repeat(F.lit(item), F.greatest(*sizes))).otherwise(out)
    return F.when(~ready, F.array(F.lit("More parameters are needed."))).otherwise(out)


#: Numbers in words, and what follows them where a user asks for more of something.
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
MORE = r"(?i)\b(" + "|".join([*NUMBERS, "some", "a few", "[0-9]{1,2}"]) + r")\s+(?:more|additional|extra|further|other)\b"


def asked_more(text: Column) -> Column:
    """How many more a text asks for ("two more", "3 additional"); 0 for an unnamed number ("some more"), null if it asks for none."""
    word = F.lower(F.regexp_extract(text, MORE, 1))
    known = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    return F.when(text.rlike(MORE), F.when(word.rlike("^[0-9]+$"), word.cast("int")).otherwise(F.coalesce(F.try_element_at(known, word), F.lit(0))))


def more_checked(cleaned: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, turn, asked, given, fits) for each turn of a user that asks for more: whether the next call of the conversation has as many parameter sets.

    An unnamed number fits two or more; where no call follows, nothing was given.
    """
    called = F.when(F.col("params").isNotNull(), F.size("params"))
    after = Window.partitionBy(conv).orderBy(turn).rowsBetween(1, Window.unboundedFollowing)
    rows = cleaned.select(conv, turn, F.when(F.col("role") == "user", asked_more(F.col("content"))).alias("asked"), F.first(called, ignorenulls=True).over(after).alias("given"))
    given = F.coalesce("given", F.lit(0))
    return rows.where("asked IS NOT NULL").select(conv, turn, "asked", given.alias("given"), F.when(F.col("asked") > 0, given == F.col("asked")).otherwise(given >= 2).alias("fits"))


def tidy_grades(message: Column) -> Column:
    """Grades in quotes from 1 to 11 become numbers, and a user tag without text goes."""
    return F.regexp_replace(F.regexp_replace(message, """(['"]G['"]\\s*:\\s*)['"](1[01]|[1-9])['"]""", "$1$2"), r"<U>\s*$", "")


def mixed(*parts: DataFrame, seed: int = 0) -> DataFrame:
    """The union of corpora in an order that depends on the seed and the rows alone.

    Rows are dealt out by their hash, so the driver samples numbers and no texts; rows of equal hash meet in one partition.
    """
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    whole = F.to_json(F.struct(*out.columns))
    place = F.xxhash64(F.lit(seed), whole)
    return out.repartitionByRange(place).sortWithinPartitions(place, whole)


def draw(key: Column, seed: int = 0) -> Column:
    """A whole number under 2^32 that depends on the seed and the key alone, for shuffles and samples that any engine can repeat."""
    return F.conv(F.substr(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), F.lit(1), F.lit(8)), 16, 10).cast("long")


def sampled(df: DataFrame, key: str, share: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(the rest, about ``share`` of the rows): the same rows on any cluster; rows without a key are not drawn."""
    chosen = F.coalesce(draw(F.col(key), seed) < int(share * (1 << 32)), F.lit(False))
    return df.where(~chosen), df.where(chosen)
