"""Line-first quality rules. [native]

Every line with a word is tested by itself: punctuation (mostly symbols, shouting, ellipsis), navigation
(separators between short labels) and boilerplate (notices about cookies, rights, scripts, sign-in, and lines
that repeat an earlier one). Failing lines go; a document that loses too much of its text is rejected. Base
counts over words and lines stand beside it.

All of it is one projection of built-in functions, row by row: no shuffle, and no limit on a text's length.
Repeated 5-word windows are found by sorting one long per window: the high bits are a hash, the low bits the
position; equal neighbours are confirmed by the full 64-bit hash of the five words.

Nulls: a null text has no words and fails. Empty and blank texts too. Empty tables give empty results,
repeated rows are judged alike, and other input columns are kept unless a result column has their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r" \x09-\x0D"
SYMBOLS = "#*$%&|<>"
#: A line of at most this share of symbols, or of capitals among its letters, passes.
MAX_SYMBOL_SHARE, MAX_CAPITAL_SHARE = 0.08, 0.6
#: Lines with so many separators are navigation.
NAV_SEPARATORS = 3
#: A document is rejected if its kept lines have less than this share of the characters in its lines.
MIN_KEPT_SHARE = 0.5
_PAD = "__pad_of_quality_rules"
BOILERPLATE = r"(?i)\b(all rights reserved|cookie policy|accept cookies|we use cookies|privacy policy|terms of (use|service)|enable javascript|javascript is (required|disabled)|sign (in|up) to|log ?in to continue|subscribe to our|click here to|share this (page|article)|powered by)\b"


def spaced(text: Column) -> Column:
    """The words of a text: runs without ASCII white space."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def line_fails(line: Column) -> Column:
    """Why a line goes: "symbols", "capitals", "navigation" or "boilerplate"; null if it stays."""
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace(line, r"[^\p{Lu}]+", ""))
    return (
        F.when(F.size(F.split(line, r"\s[|»›>·]\s")) > NAV_SEPARATORS, "navigation")
        .when(count_of(line, SYMBOLS + "{}~^=\\") > MAX_SYMBOL_SHARE * F.length(line), "symbols")
        .when((letters >= 12) & (capitals > MAX_CAPITAL_SHARE * letters), "capitals")
        .when(line.rlike(r"(\.\.\.|…)\s*$") & (F.length(line) < 60), "symbols")
        .when(line.rlike(BOILERPLATE), "boilerplate")
    )


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` with clean_text (kept lines), n_lines, n_removed, removed_reasons, kept_share, the base counts, base_failed and kept."""
    made = ["clean_text", "n_lines", "n_removed", "removed_reasons", "kept_share", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    keep = [c for c in docs.columns if c not in made]
    whole = F.coalesce(F.col(text), F.lit(""))
    # The input's columns travel as one struct, so that no name clashes. Arrays that a lambda reads stand in columns of their own, used twice, so that they are made once a row.
    a = docs.select(F.struct(F.lit(0).alias(_PAD), *[F.col(c) for c in keep]).alias("_row"), whole.alias("_t"), spaced(whole).alias("_w"), F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("_lines"))
    a = a.withColumn("n_words", F.size("_w").cast("long"))
    a = a.withColumn("_p", F.expr("CASE WHEN n_words <= 1024 THEN 10 WHEN n_words <= 65536 THEN 16 WHEN n_words <= 16777216 THEN 24 ELSE 31 END"))
    a = a.withColumn("_h", F.expr("CASE WHEN n_words >= 5 THEN transform(sequence(1, CAST(n_words AS INT) - 4), i -> xxhash64(slice(_w, i, 5))) ELSE CAST(array() AS ARRAY<BIGINT>) END"))
    a = a.withColumn("_s", F.expr("sort_array(transform(_h, (h, i) -> shiftleft(shiftrightunsigned(h, _p), _p) | CAST(i AS BIGINT)))"))
    same = "shiftright(x, _p) = shiftright(get(_s, {k}), _p) AND get(_h, CAST(x & (shiftleft(1L, _p) - 1) AS INT)) = get(_h, CAST(get(_s, {k}) & (shiftleft(1L, _p) - 1) AS INT))"
    a = a.withColumn("_d", F.expr(f"sort_array(transform(filter(_s, (x, k) -> coalesce({same.format(k='k - 1')}, false) OR coalesce({same.format(k='k + 1')}, false)), x -> x & (shiftleft(1L, _p) - 1)))"))
    a = a.withColumn("n_repeat_words", F.expr("aggregate(_d, named_struct('last', -5L, 'n', 0L), (s, x) -> named_struct('last', x, 'n', s.n + least(5L, x - s.last)), s -> s.n)"))
    a = a.withColumn("_judged", F.transform("_lines", lambda x: F.struct(x.alias("line"), line_fails(x).alias("why"))))
    a = a.withColumn("_distinct", F.array_distinct("_lines"))
    a = a.withColumn("_kept", F.array_distinct(F.transform(F.filter("_judged", lambda x: x["why"].isNull()), lambda x: x["line"])))
    chars = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = F.struct(
        F.array_join("_kept", "\n").alias("clean_text"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_kept")).cast("long").alias("n_removed"),
        F.array_sort(F.array_distinct(F.transform(F.filter("_judged", lambda x: x["why"].isNotNull()), lambda x: x["why"]))).alias("removed_reasons"),
        F.coalesce(F.try_divide(chars(F.col("_kept")), chars(F.col("_lines"))), F.lit(0.0)).alias("kept_share"),
        F.col("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        count_of(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size("_distinct")).cast("long").alias("n_dup_lines"),
        F.col("n_repeat_words"),
        base.alias("base_failed"),
    )
    # Through a generator of one row: a filter on the results is not pushed below it, where it would repeat all this.
    b = a.select("_row", F.explode(F.array(found)).alias("_r")).select("_row.*", "_r.*").drop(_PAD)
    return b.withColumn("kept", ~F.col("base_failed") & (F.col("kept_share") >= MIN_KEPT_SHARE))


#: The same counts and rules in SQL, for a check.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \x09-\x0D]+'), lambda w: w <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, w[i : i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM a WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY 1),
k AS (SELECT doc_id, list_distinct(list_filter(lines, lambda x: NOT (
   len(regexp_split_to_array(x, '[\t\n\x0B\f\r ][|»›>·][\t\n\x0B\f\r ]')) > 3
   OR length(x) - length(translate(x, '#*$%&|<>{}~^=\', '')) > 0.08::DOUBLE * length(x)
   OR (length(regexp_replace(x, '[^\p{L}]+', '', 'g')) >= 12 AND length(regexp_replace(x, '[^\p{Lu}]+', '', 'g')) > 0.6::DOUBLE * length(regexp_replace(x, '[^\p{L}]+', '', 'g')))
   OR (regexp_matches(x, '(\.\.\.|…)[\t\n\x0B\f\r ]*$') AND length(x) < 60)
   OR regexp_matches(x, '""" + BOILERPLATE + r"""')))) AS kept FROM a),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(translate(t, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_removed,
 CASE WHEN len(lines) = 0 THEN 0.0::DOUBLE ELSE coalesce(list_sum(list_transform(kept, lambda x: length(x))), 0)::DOUBLE / list_sum(list_transform(lines, lambda x: length(x)))::DOUBLE END AS kept_share FROM a JOIN k USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND kept_share >= 0.5 AS kept FROM c
"""
