"""Templates against renderings by hand in Python."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import templates

CALL = "array<struct<type:string,function:struct<name:string,arguments:struct<subjects:array<string>,ready:boolean>>>>"
SCHEMA = f"i int, messages array<struct<role:string,content:string,tool_calls:{CALL}>>"


def conversations():
    rng = random.Random(2)
    out = []
    for i in range(40):
        messages = [("system", " be brief \n", None)] if i % 3 == 0 else []
        for k in range(rng.randrange(5)):
            messages.append(("user", rng.choice(["hi", " two\nlines ", "", None, "é\"'{{ x }}"]), None))
            calls = [("function", (f"tool{j}", (["a", 'b"c'][: k % 3], bool(j)))) for j in range(rng.randrange(3))]
            messages.append(("assistant", None if calls else rng.choice(["ok", " yes "]), calls or None))
        out.append((i, messages))
    return [*out, (40, []), (41, None)]


def tagged(messages):
    return "".join(f"<|{r}|>\n{c or ''}\n" for r, c, _ in messages)


def instruct(messages):
    out = ""
    for i, (r, c, _) in enumerate(messages):
        c = (c or "").strip()
        out += f"<<SYS>>{c}<</SYS>>" if r == "system" else f"{' ' if i else ''}[INST] {c} [/INST]" if r == "user" else f" {c}</s>"
    return out


def headers(messages):
    out = "<begin>"
    for r, c, calls in messages:
        made = "; ".join(n + " " + json.dumps({"subjects": a, "ready": ready}, separators=(",", ":")) for _, (n, (a, ready)) in calls or [])
        out += f"[{r.upper()}]\n{made or ('-' if c is None else c)}<end>\n"
    return out + "[ASSISTANT]\n"


def test_three_templates(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA)
    each = {n: templates.compiled(t) for n, t in (("tagged", templates.TAGGED), ("instruct", templates.INSTRUCT), ("headers", templates.HEADERS))}
    got = {r["i"]: r for r in df.select("i", *[f(messages=F.col("messages"), prompt=F.lit(True)).alias(n) for n, f in each.items()]).collect()}
    for i, messages in rows:
        for name, by_hand in (("tagged", tagged), ("instruct", instruct), ("headers", headers)):
            assert got[i][name] == by_hand(messages or []), (i, name)


@pytest.mark.parametrize("template, want", [
    ("{% if a > 1 and not (b == 'x' or c is defined) %}yes{% else %}no{% endif %}", "yes"),
    ("{{ 'a' + b | upper }}|{{ n }}|{{ list | length }}|{{ b | chars }}", "aY||2|1"),
    ("{% if 'y' in b %}in{% endif %}{% if n is not none %}x{% elif list %}list{% endif %}", "inlist"),
    ("x {%- if true -%} y {%- endif -%} z", "xyz"),
    ("{{ 'it\\'s\\n' }}{{ \"{%\" }}", "it's\n{%"),
    ("{% for x in list %}{{ loop.index0 }}{{ x }}{% if not loop.last %},{% endif %}{% for y in list %}{{ y }}{% endfor %}{% endfor %}", "0p,pq1qpq"),
    ("", ""),
])
def test_expressions(spark, template, want):
    df = spark.createDataFrame([(2, "y", None, None, ["p", "q"])], "a int, b string, c string, n int, list array<string>")
    assert df.select(templates.compiled(template)(**{c: F.col(c) for c in df.columns}).alias("x")).first()["x"] == want


@pytest.mark.parametrize("template", ["{% if a %}", "{% endfor %}", "{{ a b }}", "{{ a | shout }}", "{{ }}", "{% for x y %}{% endfor %}", "{{ a. }}", "{{ (a }}", "{{ a is odd }}", "{% set x = 1 %}", "{{ ? }}"])
def test_broken_templates(template):
    with pytest.raises(ValueError):
        templates.compiled(template)


def test_unknown_names(spark):
    with pytest.raises(ValueError):
        templates.compiled("{{ a }}")(b=F.lit(1))
