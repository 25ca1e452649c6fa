"""Literals against Python's own reader, and parameter sets whose values look like keys and constants."""

from __future__ import annotations

import ast
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import literals
from tessera.operators import conversation

PIECES = ["None", "True", "False", "'S':", '"R": ', "\\", "'", '"', "\n", "\t", "é", "漢", "\U0001f600", "{", "}", "(", ")", "[", "]", ",", ":", " ", "x", "\x00", "\x7f", "None of these", "null", "#", "'''"]


def made(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 6)
    if kind < 3:
        return "".join(rng.choice(PIECES) for _ in range(rng.randrange(7)))
    if kind == 3:
        return rng.choice([0, 1, -7, 10**20, -(10**30), 2.5, -0.125, 1e300, 3e-9])
    if kind < 6:
        return rng.choice([None, True, False])
    inner = [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind == 6:
        return tuple(inner)
    return inner if kind == 7 else {rng.choice(["S", "T", "'S'", 'a"b', "None", 3, True, None]): x for x in inner}


def written(rng, value, gaps=("", " ", "\t ")):
    """A literal in a random style of quotes, blanks and trailing commas; ``gaps`` within brackets."""
    gap = lambda: rng.choice(gaps)
    if isinstance(value, str):
        style = rng.randrange(4)
        if style == 0:
            return repr(value)
        if style == 1:
            return '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\0", "\\x00") + '"'
        if style == 2:
            return "u'" + "".join(f"\\U{ord(c):08x}" if ord(c) > 0xFFFF else f"\\u{ord(c):04X}" if ord(c) > 0xFF else rng.choice([f"\\x{ord(c):02x}", f"\\{ord(c):03o}"]) for c in value) + "'"
        at = rng.randrange(len(value) + 1)
        return f"{value[:at]!r}{gap()} {value[at:]!r}"
    if isinstance(value, dict):
        body = f"{gap()},{gap()}".join(f"{written(rng, k, gaps)}{gap()}:{gap()}{written(rng, v, gaps)}" for k, v in value.items())
        return f"{{{gap()}{body}{rng.choice(['', ',']) if value else ''}{gap()}}}"
    if isinstance(value, (tuple, list)):
        body = f"{gap()},{gap()}".join(written(rng, v, gaps) for v in value)
        comma = "," if isinstance(value, tuple) and len(value) == 1 else rng.choice(["", ","]) if value else ""
        return "([" [isinstance(value, list)] + gap() + body + gap() + comma + gap() + ")]"[isinstance(value, list)]
    return repr(value)


def as_lists(x):
    if isinstance(x, dict):
        return {k: as_lists(v) for k, v in x.items()}
    return [as_lists(v) for v in x] if isinstance(x, (tuple, list)) else x


def test_equal_to_pythons_reader():
    rng = random.Random(3)
    for _ in range(10_000):
        value = made(rng)
        text = written(rng, value, ("", " ", "\n", "\t ") if isinstance(value, (dict, list, tuple)) else ("", " "))
        assert ast.literal_eval(text.strip(" \t\n")) == value
        got = literals.as_json(text)
        assert got["kind"] == {dict: "dict", tuple: "tuple", list: "list"}.get(type(value), "scalar")
        assert got["json"] == json.dumps(as_lists(value)), text


def test_broken_ones_are_refused():
    """What Python refuses is refused, and nothing is run."""
    rng = random.Random(4)
    refused = 0
    for _ in range(10_000):
        text = list(written(rng, made(rng)))
        for _ in range(rng.randrange(1, 3)):
            i = rng.randrange(len(text) + 1)
            text[i : i + rng.randrange(2)] = rng.choice(["'", '"', ",", ":", "{", "}", "(", ")", "1", "None", "\\", " ", ""])
        text = "".join(text).strip(" \t\n")
        try:
            want = as_lists(ast.literal_eval(text))
        except Exception:
            want = None
            refused += 1
            assert literals.as_json(text) is None, text
            continue
        got = literals.as_json(text)
        if got is not None:
            assert got["json"] == json.dumps(want), text
        else:  # kinds that are no literal here
            assert "#" in text or "Infinity" in json.dumps(want, default=str) or any(isinstance(n, (ast.Set, ast.BinOp)) or isinstance(n, ast.Constant) and isinstance(n.value, (bytes, complex)) or isinstance(n, ast.Dict) and any(not isinstance(k, (ast.Constant, ast.UnaryOp)) for k in n.keys) for n in ast.walk(ast.parse(text, mode="eval"))), text
    assert refused > 3000
    for text in ("__import__('os')", "{'S' None}", "1 + 1", "[" * 60 + "]" * 60, "b'x'", "{1, 2}", "04", "", "'a\nb'", None):
        assert literals.as_json(text) is None


SETS = [
    ("{'S': 'None of these', 'T': 'True story', 'G': 4, 'M': None, 'R': True}", [("None of these", "True story", "4", None, True)]),
    ("""{"S": "it's 'S': 1", "T": 'say "R": False', 'G': '4', 'M': 'null', 'R': false}""", [("it's 'S': 1", 'say "R": False', "4", "null", False)]),
    ("({'S': 'a', 'T': 'b', 'G': 'c', 'M': 'd', 'R': 1,}, {'R': 0, 'M': None, 'G': None, 'T': None, 'S': None, 'extra': 2})", [("a", "b", "c", "d", True), (None, None, None, None, False)]),
    ("{'S': 'a', 'T': 'b', 'G': 'c', 'M': \"'R': True\"}", None),
    ("[{'S': 'a', 'T': 'b', 'G': 'c', 'M': 'd', 'R': True}]", None),
    ("({'S': 'a', 'T': 'b', 'G': 'c', 'M': 'd', 'R': True}, 3)", None),
    ("()", None), ("'text'", None), ("", None), (None, None),
    ("{'S': ['a', 'b'], 'T': 'caf\\u00e9\\n', 'G': 1.5, 'M': 'x' 'y', 'R': None}", [('["a","b"]', "café\n", "1.5", "xy", False)]),
]


def test_parameter_sets(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(SETS)], "i int, x string")
    got = {r["i"]: r["p"] for r in df.select("i", conversation.parameters(F.col("x")).alias("p")).collect()}
    for i, (text, want) in enumerate(SETS):
        assert (got[i] and [tuple(p) for p in got[i]]) == want, text


def test_conversations_keep_such_values(spark):
    rows = [(i, 0, "gpt", f"<U>ok</U><E>{x}</E>") for i, (x, _) in enumerate(SETS) if x]
    df = spark.createDataFrame(rows, "conv_id int, turn int, sender string, message string")
    assert {r["conv_id"] for r in conversation.clean(df).collect()} == {i for i, (_, want) in enumerate(SETS) if want}
    assert {r["conv_id"] for r in conversation.clean(df, only="multi").collect()} == {2}


@pytest.mark.parametrize("text, want", [("{'a': 1}", "dict"), ("1, 2", "tuple"), ("('a')", "scalar"), ("[]", "list")])
def test_kinds(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(literals.literal(F.col("x")).alias("y")).first()["y"]["kind"] == want
