"""Rewriting of marked-up text, and reconciliation of header tags with what a body shows."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.headers import strip

#: Markers in bodies and the tags that go with them.
ANSWERS, FIGURE = "\\subsection{Answers}", "[STRDGM]"
TOP_LEVEL_BLANK = r"\s+(?=(?:[^()]*\([^()]*\))*[^()]*$)"


def first_number(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, r"\d+", 0), F.lit(""))


def to_latex_words(s: Column) -> Column:
    """``**w**``, ``*w*`` and ``_w_`` around single words between white space become bold, emphasis and underline."""
    for mark, name in ((r"\*\*", "textbf"), (r"\*", "emph"), ("_", "underline")):
        s = F.regexp_replace(s, rf"(?U)(?<=\s){mark}(\w+){mark}(?=\s)", rf"\\{name}{{$1}}")
    return s


def replaced_all(s: Column, old: str, new: str) -> Column:
    """Every occurrence of a literal text replaced, from the left; an empty one changes nothing."""
    return F.replace(s, F.lit(old), F.lit(new)) if old else s


def to_latex(text: Column) -> Column:
    """A section (header line and body) as LaTeX: blank lines emptied, lists, sections and marked words rewritten, the header rebuilt.

    A header of five parts (bracketed or words) gets the modifier tags that the
    body's sections call for, and brackets around each part of more than one
    character; any other header stays as it is.
    """
    at = lambda x: F.instr(x, "\n")
    head_of = lambda x: F.when(at(x) > 0, F.substring_index(x, "\n", 1)).otherwise(x)
    body_of = lambda x: F.when(at(x) > 0, F.substr(x, at(x))).otherwise(F.lit(""))
    emptied = _once(text, lambda x: F.array_join(F.transform(F.split(body_of(x), "\n"), lambda line: F.when(line.rlike(r"\S"), line).otherwise("")), "\n"))
    head = _once(text, lambda x: _once(head_of(x), lambda h: _rebuilt(h, body_of(x))))
    return F.concat(head, to_latex_words(sections_to_latex(lists_to_latex(emptied))))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once a row, however often it is used: columns are expressions, and each use would repeat them."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _rebuilt(head: Column, body: Column) -> Column:
    """A header of five parts with the tags that a body calls for; any other stays."""

    def tagged(parts: Column, own: Column, tags: Column) -> Column:
        new = F.filter(tags, lambda tag: ~F.array_contains(own, tag) & ~F.array_contains(own, F.concat(tag, F.lit("s"))))
        # the placeholder gives way to a tag
        modifier = _once(new, lambda n: F.array_join(F.concat(F.when((F.size(n) > 0) & (F.array_join(own, ",") == "M"), F.array().cast("array<string>")).otherwise(own), n), ", "))
        every = F.concat(F.slice(parts, 1, 4), F.array(modifier))
        return F.array_join(F.transform(every, lambda p: F.when(F.length(p) > 1, F.concat(F.lit("("), p, F.lit(")"))).otherwise(p)), " ")

    def of_parts(parts: Column) -> Column:
        own = F.filter(F.split(F.get(parts, F.lit(4)), ", "), lambda x: x != "")
        return F.when(F.size(parts) == 5, _once(own, lambda o: _once(section_tags(body), lambda tags: tagged(parts, o, tags)))).otherwise(head)

    return _once(F.transform(F.regexp_extract_all(head, F.lit(r"(?U)\(.*?\)|\w+"), F.lit(0)), lambda p: F.regexp_replace(p, r"^[()]+|[()]+$", "")), of_parts)


def sections_to_latex(body: Column, compat: bool = False) -> Column:
    """Lines that begin with Answers, Hints or Solution become sections. ``compat``: Solution stays."""
    for name in ("Answers", "Hints") if compat else ("Answers", "Hints", "Solution"):
        body = F.regexp_replace(body, rf"(?<=\n){name}", rf"\\section{{{name}}}")
    return body


def section_tags(body: Column) -> Column:
    """Modifier tags that the sections of a body call for."""
    pairs = (("\nAnswers", "With Answer"), ("\nHints", "With Hint"), ("\nSolution", "With Solution"))
    return F.array_compact(F.array(*[F.when(F.instr(body, mark) > 0, F.lit(tag)) for mark, tag in pairs]))


def without_brackets(s: Column, compat: bool = False) -> Column:
    """Brackets deleted. ``compat``: the closing round one stays."""
    return F.translate(s, "([]{}" if compat else "()[]{}", "")


def detected_type(header: Column, body: Column) -> tuple[Column, Column]:
    """(header, body): a bare ``T`` becomes the body's first line that is not blank, at most 40 characters, unwrapped; that line goes."""
    lines = F.split(body, "\n")
    first = F.get(F.filter(lines, lambda x: x.rlike(r"\S")), F.lit(0))
    text = strip(first)
    open_ = F.substr(text, F.lit(1), F.lit(1)).isin("(", "[", "{")
    name = F.substr(F.when(open_, F.substr(text, F.lit(2), F.length(text) - 2)).otherwise(text), F.lit(1), F.lit(40))
    at = F.instr(header, " T ")
    fits = (at > 0) & first.isNotNull()
    place = F.array_position(lines, first).cast("int")
    rest = F.concat(F.slice(lines, F.lit(1), place - 1), F.slice(lines, place + 1, F.size(lines)))
    new_header = F.concat(F.substr(header, F.lit(1), at), F.lit("("), name, F.lit(")"), F.substr(header, at + 2))
    return F.when(fits, new_header).otherwise(header), F.when(fits, F.array_join(rest, "\n")).otherwise(body)


def formatted_list(s: Column) -> Column:
    """The lines as an enumeration; if all begin with a mark of a list, the marks go."""
    lines = F.split(s, "\n")
    mark = r"^(\w|\d+)[.)]? "
    bare = F.when(F.forall(lines, lambda x: x.rlike(mark)), F.transform(lines, lambda x: F.regexp_replace(x, mark, ""))).otherwise(lines)
    return F.concat(F.lit("\\begin{enumerate}\n\\item "), F.array_join(bare, "\n\\item "), F.lit("\n\\end{enumerate}"))


def wrapped(s: Column, command: str) -> Column:
    """``\\command{s}``, for textbf, textit, underline."""
    return F.concat(F.lit(f"\\{command}{{"), s, F.lit("}"))


@F.pandas_udf(StringType())
def lists_to_latex(s: pd.Series) -> pd.Series:
    """In each part between blank lines, what follows the first number becomes an enumeration, an item a number; items end at digits.

    The replacement depends on each match, which no SQL function can say.
    """
    mark = re.compile(r"\d+\.?\s")

    def listed(part: str) -> str:
        first = mark.search(part.removesuffix("\n"))
        if first is None:
            return part
        end = "\n" if part.endswith("\n") else ""
        items = re.findall(r"\d+\.?\s([^\d]+)", part[first.start() : len(part) - len(end)])
        return "".join([part[: first.start()], "\\begin{enumerate}\n", *(f"\\item {x.strip()}\n" for x in items), "\\end{enumerate}", end])

    return s.map(lambda x: x if x is None else "\n\n".join(map(listed, x.split("\n\n"))))


def _tag_changed(part: Column, tag: str, shown: Column, placeholder: str) -> Column:
    """A modifier part with a tag added or removed so that it says what is shown."""
    names = F.transform(F.split(F.translate(part, "()", ""), ","), strip)
    known = F.array(F.lit(tag), F.lit(f"{tag}s"))
    has = F.arrays_overlap(names, known)
    left = F.filter(names, lambda x: ~x.isin(tag, f"{tag}s"))
    removed = F.when(F.size(left) == 0, placeholder).otherwise(F.concat(F.lit("("), F.array_join(left, ", "), F.lit(")")))
    added = F.when(part == placeholder, f"({tag})").otherwise(F.concat(F.lit("("), F.array_join(names, ", "), F.lit(f", {tag})")))
    return F.when(has & ~shown, removed).when(~has & shown, added).otherwise(part)


def reconciled(header: Column, body: Column, compat: bool = False) -> Column:
    """The header with its modifiers set right for answers and figures in the body; headers of other than five parts stay.

    A type that holds the illustration tag is edited in place of the modifiers;
    if it was its only name, ``T`` stays (``compat``: ``E``).
    """
    parts = F.split(header, TOP_LEVEL_BLANK)
    shown = F.instr(body, F.lit(FIGURE)) > 0
    typed = F.instr(parts[1], "With Illustration") > 0
    t = F.when(typed, _tag_changed(parts[1], "With Illustration", shown, "E" if compat else "T")).otherwise(parts[1])
    m = _tag_changed(parts[4], "With Answer", F.instr(body, F.lit(ANSWERS)) > 0, "M")
    m = F.when(typed, m).otherwise(_tag_changed(m, "With Illustration", shown, "M"))
    return F.when(F.size(parts) == 5, F.concat_ws(" ", parts[0], t, parts[2], parts[3], m)).otherwise(header)
