"""Operator 6: URL rules with redirect equivalence, in DataFrame operations only.

A rule names a host and a path; it fits that host and its subdomains where the
URL's path starts with the rule's. The longest fitting rule decides. Pages
without a rule take part in *redirect equivalence*: canonical links and refresh
redirects in their HTML, and edges that the caller adds, join URLs to classes
(distributed connected components). In a class

    own rule > an allow rule on any alias > a block rule on any alias > default

so a block spreads to all aliases, unless an alias is allowed explicitly.
Aliases that are no pages themselves are judged by the rules, too. A URL's key
in a class is host, path and query: schemes and fragments are left out.

Defined cases: a null URL, or one without ``://``, has empty host and path, no
rule, and no part in classes; null HTML has no edges; relative targets count
from the page's host and folder; repeated rows are judged each; an empty table
gives an empty one; other columns of the input are left out.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import scratch
from tessera.llm.components import components

#: (verdict, host, path), fixed by the contract of the query.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
CONTENT = r"(?is)\bcontent\s*=\s*[\"']?\s*\d*\s*;\s*url\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_of(url: Column) -> Column:
    """Host, path and query; null for what is no URL."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), rest))


def absolute(target: Column, url: Column) -> Column:
    """A link's target as a URL, seen from the page at ``url``."""
    top = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder == top, F.concat(top, F.lit("/"))).otherwise(folder)
    return (
        F.when(target == "", None)
        .when(target.rlike("(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(~url.contains("://"), None)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(top, target))
        .when(target.startswith("#") | target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(folder, target))
    )


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as text, its verdict), null where none fits; among rules of one length an allow rule is first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow", r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def page_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(source, target) keys from canonical links and refresh redirects."""
    url, html = F.col(url_col), F.col(html_col)
    targets = F.array(
        absolute(F.regexp_extract(F.regexp_extract(html, LINK, 0), HREF, 1), url),
        absolute(F.regexp_extract(F.regexp_extract(html, REFRESH, 0), CONTENT, 1), url),
    )
    has = html.rlike("(?i)canonical|http-equiv")
    found = pages.where(url.contains("://") & has).select(key_of(url).alias("source"), F.explode(targets).alias("t"))
    return found.select("source", key_of(F.col("t")).alias("target")).where("target is not null")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: list[tuple[str, str, str]] | None = None, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict, class_verdict) for each row. ``redirects``: more edges, as URLs (source, target)."""
    rules = RULES if rules is None else rules
    edges = page_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(key_of(F.col("source")).alias("source"), key_of(F.col("target")).alias("target")).where("source is not null and target is not null"))
    with scratch(pages.sparkSession) as result:
        classes = components(edges, "source", "target")
        part = F.concat(F.lit("x://"), F.col("vertex"))
        _, said = rule_of(host_of(part), path_of(part), rules)
        judged = classes.withColumn("said", said)
        by_class = judged.groupBy("label").agg(F.max(F.col("said") == "allow").alias("a"), F.max(F.col("said") == "block").alias("b"))
        by_class = by_class.select("label", F.when(F.col("a"), "allow").when(F.col("b"), "block").alias("class_verdict")).where("class_verdict is not null")
        aliases = result(classes.join(by_class, "label").select(F.col("vertex").alias("key"), "class_verdict"), "aliases")
    url = F.col(url_col)
    own = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), key_of(url).alias("key"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": rule, "said": verdict})
    # pages without a key are no alias of any, and must not meet in one task
    joined = own.where("key IS NOT NULL").join(aliases, "key", "left").unionByName(own.where("key IS NULL").withColumn("class_verdict", F.lit(None).cast("string")))
    return joined.select(id_col, "host", "path", "rule", F.coalesce("said", "class_verdict", F.lit(default)).alias("verdict"), "class_verdict")
