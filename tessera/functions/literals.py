"""Reading Python literals (dicts, tuples, lists, strings, numbers, constants) as JSON, without evaluating anything.

A text is cut into tokens by one pattern whose alternatives take whole strings
first, so nothing within a string is ever read as a constant, key or bracket.
A small machine puts tokens together; what it can't put together is no literal.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Kinds of results, and constants with what they stand for; the lower-case ones are JSON's and are read as Python's.
DICT, TUPLE, LIST, SCALAR = "dict", "tuple", "list", "scalar"
CONSTANTS = {"None": None, "True": True, "False": False, "true": True, "false": False}
#: Literals nested more deeply are not read.
DEPTH = 50
#: The kind of a literal and its value as JSON; tuples become arrays.
LITERAL = StructType([StructField("kind", StringType()), StructField("json", StringType())])

_TOKEN = re.compile(
    r"""\s*(?:
    (?P<prefix>[rRuU]?)(?P<string>'''(?:[^\\]|\\.)*?'''|\"\"\"(?:[^\\]|\\.)*?\"\"\"|'(?!'')(?:[^'\\\n]|\\.)*'|"(?!"")(?:[^"\\\n]|\\.)*")
    |(?P<number>(?:[-+]\s*)*(?:0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:[0-9][0-9_]*)?\.[0-9][0-9_]*(?:[eE][-+]?[0-9]+)?|[0-9][0-9_]*\.?(?:[eE][-+]?[0-9]+)?))(?![\w.])
    |(?P<name>[A-Za-z]+)(?!\w)
    |(?P<mark>[{}\[\](),:])
    |(?P<end>\Z))""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(\n|[\\'\"abfnrtv]|[0-7]{1,3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|N\{[^}]*\}|[xuUN])", re.S)
_PLAIN = {"\n": "", "\\": "\\", "'": "'", '"': '"', "a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
_CLOSES = {"{": "}", "[": "]", "(": ")"}


def _escaped(m: re.Match) -> str:
    what = m[1]
    if what in _PLAIN:
        return _PLAIN[what]
    if what[0] == "N" and len(what) > 1:
        return unicodedata.lookup(what[2:-1])
    return chr(int(what, 8) if what.isdigit() else int(what[1:], 16))


def _string(prefix: str, quoted: str) -> str:
    inside = quoted[3:-3] if quoted[:3] in ("'''", '\"\"\"') and len(quoted) >= 6 else quoted[1:-1]
    return inside if prefix in ("r", "R") else _ESCAPE.sub(_escaped, inside)


def _number(text: str) -> int | float:
    signs, digits = re.fullmatch(r"([-+\s]*)(.*)", text, re.S).groups()
    value = float(digits) if re.search(r"[.]|^[0-9_]+[eE]", digits) else int(digits, 0)
    return -value if signs.count("-") % 2 else value


def _tokens(text: str) -> Iterator[tuple[str, object]]:
    """(kind, value): "value" with what it stands for, "string" with its text, or a bracket, comma or colon as both."""
    at = 0
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError("no literal")
        at = m.end()
        if m["string"] is not None:
            yield "string", _string(m["prefix"], m["string"])
        elif m["number"] is not None:
            yield "value", _number(m["number"])
        elif m["name"] is not None:
            if m["name"] not in CONSTANTS:
                raise ValueError("a name")
            yield "value", CONSTANTS[m["name"]]
        elif m["mark"] is not None:
            yield m["mark"], m["mark"]
        else:
            yield "end", None
            return


def parse(text: str) -> object:
    """The value of a literal; ValueError if it is none. Tuples stay tuples."""
    stack: list[tuple[str, list]] = []  # open brackets with what they hold: values, and in dicts keys and colons too
    opened, held = "", []
    for kind, value in _tokens(text):
        if kind in _CLOSES:
            if held and held[-1] not in (_COMMA, _COLON):
                raise ValueError("two values without a comma")
            if len(stack) >= DEPTH:
                raise ValueError("too deep")
            stack.append((opened, held))
            opened, held = kind, []
        elif kind in ("}", "]", ")"):
            if not opened or _CLOSES[opened] != kind:
                raise ValueError("brackets do not match")
            value = _closed(opened, held)
            opened, held = stack.pop()
            held.append(value)
        elif kind == ",":
            if not held or held[-1] in (_COMMA, _COLON):
                raise ValueError("a comma after nothing")
            held.append(_COMMA)
        elif kind == ":":
            if opened != "{" or not held or held[-1] in (_COMMA, _COLON):
                raise ValueError("a colon out of place")
            held.append(_COLON)
        elif kind == "end":
            break
        elif kind == "string" and held and isinstance(held[-1], _Text):
            held[-1] = _Text(held[-1] + value)  # strings beside each other are one
        else:
            if held and held[-1] not in (_COMMA, _COLON):
                raise ValueError("two values without a comma")
            held.append(_Text(value) if kind == "string" else value)
    if opened:
        raise ValueError("brackets stay open")
    if _COMMA in held:
        return tuple(_values(held))
    if len(held) != 1:
        raise ValueError("no literal")
    return held[0]


class _Text(str):
    """A string that one beside it may join."""


class _Mark:
    """Stands for a comma or colon among values; equal to nothing else."""


_COMMA, _COLON = _Mark(), _Mark()


def _values(held: list) -> list:
    parts: list = []
    for i, x in enumerate(held):
        if i % 2 == (x is not _COMMA):
            raise ValueError("commas out of place")
        if x is not _COMMA:
            parts.append(x)
    return parts


def _closed(opened: str, held: list) -> object:
    if opened == "{":
        out = {}
        for i in range(0, len(held), 4):
            key, *rest = held[i : i + 4]
            if len(rest) < 2 or rest[0] is not _COLON or isinstance(rest[1], _Mark) or rest[2:] not in ([], [_COMMA]):
                raise ValueError("no dict")
            if isinstance(key, (dict, list, tuple, _Mark)):
                raise ValueError("a key that is no string, number or constant")
            out[key] = rest[1]
        return out
    if _COLON in held:
        raise ValueError("a colon out of place")
    parts = _values(held)
    if opened == "(" and len(held) == 1:
        return parts[0] if not isinstance(parts[0], _Text) else str(parts[0])  # brackets around one value
    return parts if opened == "[" else tuple(parts)


def as_json(text: str | None) -> dict[str, str] | None:
    """(kind, json) of one text, None if it is no literal or JSON can't hold it."""
    if text is None:
        return None
    try:
        value = parse(text)
        kind = {dict: DICT, tuple: TUPLE, list: LIST}.get(type(value), SCALAR)
        return {"kind": kind, "json": json.dumps(value, allow_nan=False)}
    except (ValueError, KeyError, OverflowError):
        return None


@F.arrow_udf(LITERAL)
def read(texts: pa.Array) -> pa.Array:
    """(kind, json) of each text: ``dict``, ``tuple``, ``list`` or ``scalar``, and the value as JSON; null where a text is no literal.

    As Python reads literals, but for sets, bytes, complex numbers and comments,
    which are none here; keys are strings, numbers or constants; JSON's
    ``true`` and ``false`` are constants too; at most ``DEPTH`` brackets are open at once.
    """
    return pa.array([as_json(x) for x in texts.to_pylist()], pa.struct([("kind", pa.string()), ("json", pa.string())]))


def literal(text: Column) -> Column:
    """:func:`read` as a column of :data:`LITERAL`."""
    return read(text)
