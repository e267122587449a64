"""Links, table rows and text out of HTML columns, by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entities that are decoded (fixed values of the format), "&amp;" last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def decoded(text: Column) -> Column:
    for name, value in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def plain(text: Column) -> Column:
    """Text without scripts, styles, comments and tags; white space becomes one space."""
    out = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(out, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def links(pages: DataFrame, id: str, html: str) -> DataFrame:
    """id, href and label of every anchor."""
    found = F.regexp_extract_all(html, F.lit(r'(?s)<a [^>]*href="[^"]*"(?:[^>]*>(?:(?!</a>).)*)?'), F.lit(0))
    one = pages.select(id, F.explode(found).alias("_a"))
    return one.select(id, F.regexp_extract("_a", r'href="([^"]*)"', 1).alias("href"), plain(F.regexp_replace("_a", r'(?s)^<a [^>]*>', "")).alias("label"))


def rows(pages: DataFrame, id: str, html: str) -> DataFrame:
    """id, row (from 0) and cells of every table row."""
    cell = lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), plain)
    return pages.select(id, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "_r")).select(id, "row", cell(F.col("_r")).alias("cells"))
