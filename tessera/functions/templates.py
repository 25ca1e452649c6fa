"""Chat templates compiled to columns.

A template is text with ``{{ expression }}`` and the tags ``{% for x in path %}``
``{% endfor %}``, ``{% if %}`` ``{% elif %}`` ``{% else %}`` ``{% endif %}``;
a dash inside a tag (``{%-``, ``-%}``) takes away white space beside it.
Expressions know paths (``m.role``), texts, numbers, ``true false none``,
``== != > <``, ``in`` (a text in a text), ``and or not``, ``+`` (texts),
``is defined``, ``is none`` (and ``is not``), brackets, and the filters
``trim upper lower chars`` of texts, ``length tojson`` of lists. In a loop ``loop.first``, ``loop.last``,
``loop.index`` and ``loop.index0`` tell the place.

A template is read once, where the query is built, and becomes one column:
loops are ``transform``, conditions are ``when``, so rendering is left to Spark.
A null shows as nothing, and is false; so are empty texts and lists, 0 and false.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Environment = dict[str, "Column | dict[str, Column]"]
Make = Callable[[Environment], Column]

_TAG = re.compile(r"(\{%-?.*?-?%\}|\{\{-?.*?-?\}\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<mark>==|!=|[|.()+<>]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
FILTERS: dict[str, Callable[[Column], Column]] = {
    "trim": lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""),
    "upper": F.upper,
    "lower": F.lower,
    "length": lambda x: F.coalesce(F.size(x), F.lit(0)),
    "chars": lambda x: F.coalesce(F.length(x), F.lit(0)),
    "tojson": F.to_json,
}


def truth(x: Column) -> Column:
    """Whether a value of any kind counts as true."""
    kind, shown = F.typeof(x), x.cast("string")
    some = F.when(kind == "string", shown != "").when(kind.startswith("array"), shown != "[]").when(kind.startswith("map"), shown != "{}").otherwise(~shown.isin("false", "0", "0.0"))
    return F.coalesce(some, F.lit(False))


def shown(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.source, self.tokens, at = source, [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if m is None:
                raise ValueError(f"can't read {source[at:]!r} in a template")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def take(self, *values: str) -> str | None:
        """The next token if it is one of these names or marks."""
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("name", "mark") and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self) -> Make:
        out = self.either()
        if self.at < len(self.tokens):
            raise ValueError(f"too much in the template's expression {self.source!r}")
        return out

    def either(self) -> Make:
        out = self.both()
        while self.take("or"):
            a, b = out, self.both()
            out = lambda env, a=a, b=b: truth(a(env)) | truth(b(env))
        return out

    def both(self) -> Make:
        out = self.negated()
        while self.take("and"):
            a, b = out, self.negated()
            out = lambda env, a=a, b=b: truth(a(env)) & truth(b(env))
        return out

    def negated(self) -> Make:
        if self.take("not"):
            a = self.negated()
            return lambda env: ~truth(a(env))
        return self.compared()

    def compared(self) -> Make:
        a = self.joined()
        if mark := self.take("==", "!=", "<", ">"):
            b = self.joined()
            each = {"==": Column.eqNullSafe, "!=": lambda x, y: ~x.eqNullSafe(y), "<": lambda x, y: F.coalesce(x < y, F.lit(False)), ">": lambda x, y: F.coalesce(x > y, F.lit(False))}[mark]
            return lambda env: each(a(env), b(env))
        if self.take("in"):
            b = self.joined()
            return lambda env: F.coalesce(F.contains(b(env), a(env)), F.lit(False))
        if self.take("is"):
            no, what = self.take("not"), self.take("defined", "none")
            if what is None:
                raise ValueError(f"after 'is' a template knows 'defined' and 'none': {self.source!r}")
            return (lambda env: a(env).isNotNull()) if (what == "defined") != bool(no) else (lambda env: a(env).isNull())
        return a

    def joined(self) -> Make:
        out = self.filtered()
        while self.take("+"):
            a, b = out, self.filtered()
            out = lambda env, a=a, b=b: F.concat(shown(a(env)), shown(b(env)))
        return out

    def filtered(self) -> Make:
        out = self.atom()
        while self.take("|"):
            name = self.take(*FILTERS)
            if name is None:
                raise ValueError(f"unknown filter in {self.source!r}")
            out = lambda env, a=out, f=FILTERS[name]: f(a(env))
        return out

    def atom(self) -> Make:
        if self.take("("):
            out = self.either()
            if not self.take(")"):
                raise ValueError(f"a bracket stays open in {self.source!r}")
            return out
        if self.at >= len(self.tokens):
            raise ValueError(f"a value is missing in {self.source!r}")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            text = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S)
            return lambda env: F.lit(text)
        if kind == "number":
            return lambda env: F.lit(int(value))
        if kind != "name":
            raise ValueError(f"{value!r} out of place in {self.source!r}")
        if value in ("true", "false", "none"):
            return lambda env: F.lit({"true": True, "false": False, "none": None}[value])
        fields = []
        while self.take("."):
            if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
                raise ValueError(f"a name must follow the dot in {self.source!r}")
            fields.append(self.tokens[self.at][1])
            self.at += 1

        def path(env: Environment) -> Column:
            if value not in env:
                raise ValueError(f"the template's {value!r} is not known")
            out = env[value]
            for f in fields:
                out = out[f]
            return out

        return path


class _Blocks:
    """The tags of a template as nested parts."""

    def __init__(self, template: str):
        pieces = _TAG.split(template)
        for i in range(1, len(pieces), 2):
            if pieces[i][2] == "-":
                pieces[i - 1] = pieces[i - 1].rstrip()
            if pieces[i][-3] == "-":
                pieces[i + 1] = pieces[i + 1].lstrip()
        self.pieces, self.at = pieces, 0

    def until(self, *ends: str) -> tuple[Make, str]:
        """The parts up to a tag that begins with one of ``ends``, and that tag."""
        parts: list[Make] = []
        while self.at < len(self.pieces):
            piece = self.pieces[self.at]
            self.at += 1
            if self.at % 2:  # plain text
                if piece:
                    parts.append(lambda env, text=piece: F.lit(text))
                continue
            inside = piece[2:-2].strip("-").strip()
            if piece.startswith("{{"):
                parts.append(lambda env, make=_Expression(inside).whole(): shown(make(env)))
                continue
            word = inside.split(None, 1)[0] if inside else ""
            if word in ends:
                return _concat(parts), inside
            if word == "for":
                parts.append(self.loop(inside))
            elif word == "if":
                parts.append(self.condition(inside))
            else:
                raise ValueError(f"tag {piece!r} out of place in a template")
        if ends:
            raise ValueError(f"a template ends before {ends[-1]!r}")
        return _concat(parts), ""

    def loop(self, tag: str) -> Make:
        m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", tag, re.S)
        if m is None:
            raise ValueError(f"can't read the tag {tag!r}")
        name, over = m[1], _Expression(m[2]).whole()
        body, _ = self.until("endfor")

        def make(env: Environment) -> Column:
            every = over(env)

            def one(x: Column, i: Column) -> Column:
                place = {"index0": i, "index": i + 1, "first": i == 0, "last": i == F.size(every) - 1}
                return body(env | {name: x, "loop": place})

            return F.coalesce(F.array_join(F.transform(every, one), ""), F.lit(""))

        return make

    def condition(self, tag: str) -> Make:
        cases: list[tuple[Make, Make]] = []
        test = _Expression(tag[2:]).whole()
        while True:
            body, end = self.until("elif", "else", "endif")
            cases.append((test, body))
            if not end.startswith("elif"):
                break
            test = _Expression(end[4:]).whole()
        other = self.until("endif")[0] if end == "else" else (lambda env: F.lit(""))

        def make(env: Environment) -> Column:
            out = F
            for when, then in cases:
                out = out.when(truth(when(env)), then(env))
            return out.otherwise(other(env))

        return make


def _concat(parts: list[Make]) -> Make:
    return lambda env: F.concat(*[p(env) for p in parts]) if parts else F.lit("")


def compiled(template: str) -> Callable[..., Column]:
    """A function from named columns (``messages=F.col("messages")``) to the rendered text. A template that can't be read raises ValueError here."""
    body, _ = _Blocks(template).until()
    return lambda **columns: body(dict(columns))


#: Templates of different shape: a tag a message, turns between instruction marks, and headers with tool calls.
TAGGED = "{% for m in messages %}<|{{ m.role }}|>\n{{ m.content }}\n{% endfor %}"
INSTRUCT = (
    "{%- for m in messages -%}"
    "{%- if m.role == 'system' -%}<<SYS>>{{ m.content | trim }}<</SYS>>"
    "{%- elif m.role == 'user' -%}{% if not loop.first %} {% endif %}[INST] {{ m.content | trim }} [/INST]"
    "{%- else -%}{{ ' ' + (m.content | trim) }}</s>{%- endif -%}"
    "{%- endfor -%}"
)
HEADERS = (
    "<begin>{% for m in messages %}[{{ m.role | upper }}]\n"
    "{% if m.tool_calls %}{% for c in m.tool_calls %}{% if loop.index > 1 %}; {% endif %}{{ c.function.name }} {{ c.function.arguments | tojson }}{% endfor %}"
    "{% elif m.content is none %}-{% else %}{{ m.content }}{% endif %}<end>\n{% endfor %}"
    "{% if prompt %}[ASSISTANT]\n{% endif %}"
)
