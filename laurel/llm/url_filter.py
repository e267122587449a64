"""URL filtering by pattern rules that are indexed by their rarest literal token. [native]

Every rule has literal tokens (runs of ASCII letters and digits). Those that are closed on both sides, so that a URL that matches must hold them as
tokens of its own, can be keys. A count over all URLs gives each such token's frequency; a rule is filed under its rarest one. The index is a hash table, a constant
of the plan: a URL's own tokens look up their slots, and only the regular expressions of the rules found there run. Work per URL does not grow with the list.

The list is configuration and not data; its size is checked (INDEX_BYTES), as every task holds the index.

Nulls: a null URL, or one without "://", has an empty host and path, fetches no rule and is allowed.
Empty tables give empty results; repeated rows are judged alike; input columns other than the id and
the URL are dropped, so clashing names cannot arise; very long URLs are judged whole. Of several site rules that fit the longest wins, of equally long ones the
smallest; of several patterns the first in the list is reported.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (action, host/path): a rule fits its host and all subdomains if the path starts with the rule's.
SITE_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: Literal or wildcard patterns that block an address for which no site rule stands: hosts and paths of advertising, tracking, counters and pop-ups.
PATTERNS = tuple(
    """ads-track.* ://ads.* .ads.* /ads/* /banner/* doubleclick.* /track/* /pixel/* /popup/*
    ://ad.* .ad.* ://adserver.* .adserver.* /adserver/* /adframe/* /advert/* /adverts/* /banners/* /sponsor/*ad= ://banner.* ://banners.*
    ://tracker.* ://tracking.* .tracking.* /tracker/* /tracking/* /beacon/* ://beacon.* ://pixel.* ://counter.* /popunder/* /interstitial/*
    googlesyndication.* googletagmanager.* adnxs.* adsafeprotected.* taboola.* outbrain.* criteo.* scorecardresearch.* quantserve.*
    /affiliate/* /clickthrough/* /redirect/*url= &utm_source= ?utm_source=""".split()
)

#: Bytes of the index at most, and rules to a slot of its table on average.
INDEX_BYTES, LOAD = 32 << 20, 0.5
_ENTRY = "array<array<struct<t: string, i: int, site: boolean, action: string, name: string, regex: string>>>"


@dataclass(frozen=True)
class Rule:
    """`regex` runs on "host/path" for site rules and on the lower-cased URL for patterns."""

    name: str
    action: str
    regex: str
    site: bool
    tokens: tuple[str, ...]


def site_rule(action: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(text, action, rf"^([^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", True, tuple(re.findall("[a-z0-9]+", host)) + whole_tokens(path))


def whole_tokens(path: str) -> tuple[str, ...]:
    """Lower-cased tokens of a path prefix that are closed on both sides, so that a matching URL must have them."""
    return tuple(re.findall("[a-z0-9]+(?=[^a-z0-9])", path.lower()))


def pattern_rule(text: str) -> Rule:
    """A pattern found anywhere in the lower-cased URL; "*" stands for anything. One that begins with a letter or digit begins a token there; its last token may go on."""
    pieces = text.translate(str.maketrans(UPPER, LOWER)).split("*")
    edge = r"(?<![a-z0-9])" if re.match("[a-z0-9]", pieces[0]) else ""
    closed = []
    for k, piece in enumerate(pieces):
        for token in re.finditer("[a-z0-9]+", piece):
            if (token.start() > 0 or (k == 0 and edge)) and token.end() < len(piece):
                closed.append(token.group())
    regex = edge + ".*".join(re.escape(x) for x in pieces)
    return Rule(text, "block", "(?s)" + re.sub(r"^(\.\*)+|(\.\*)+$", "", regex), False, tuple(closed))


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9]+"))


def token_counts(pages: DataFrame, url: str, tokens: list[str]) -> dict[str, int]:
    """How many of all URLs hold each of the rules' tokens; as many rows as the rules have tokens reach the driver."""
    if not tokens:
        return {}
    wanted = F.broadcast(pages.sparkSession.createDataFrame([(t,) for t in tokens], "t string"))
    seen = pages.select(F.explode(tokens_of(F.coalesce(F.col(url), F.lit("")))).alias("t"))
    return {r.t: r["count"] for r in seen.join(wanted, "t", "left_semi").groupBy("t").count().collect()}


def index_of(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rule numbers by the rarest token; ties go to the longer, then the smaller token. "" holds rules without a token."""
    index: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        key = min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default="")
        index.setdefault(key, []).append(i)
    return index


def slots_of(pages: DataFrame, index: dict[str, list[int]], rules: list[Rule]) -> tuple[Column, int]:
    """The index as a constant table of slots, and their number; a token's slot is its hash modulo that number."""
    number = max(1, int(len(rules) / LOAD))
    spark = pages.sparkSession
    keys = sorted(k for k in index if k)
    hashes = spark.createDataFrame([(k,) for k in keys], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(number)).alias("slot")).collect() if keys else []
    slots: list[list[dict]] = [[] for _ in range(number)]
    for row in hashes:
        slots[row.slot] += [{"t": row.t, **entry(i, rules[i])} for i in index[row.t]]
    table = json.dumps(slots)
    if len(table) > INDEX_BYTES:
        raise ValueError(f"the rules take {len(table)} bytes, more than {INDEX_BYTES}")
    return F.from_json(F.lit(table), _ENTRY), number


def entry(i: int, rule: Rule) -> dict:
    return {"i": i, "site": rule.site, "action": rule.action, "name": rule.name, "regex": rule.regex}


def judge(pages: DataFrame, id: str = "page_id", url: str = "url", site_rules=SITE_RULES, patterns=PATTERNS) -> DataFrame:
    """Per row: id, host, path, rule, verdict, n_candidates (rules whose expression ran) and pattern (the first that matched)."""
    rules = [site_rule(a, t) for a, t in site_rules] + [pattern_rule(t) for t in patterns]
    counts = token_counts(pages, url, sorted({t for r in rules for t in r.tokens}))
    index = index_of(rules, counts)
    slots, number = slots_of(pages, index, rules)
    always = F.from_json(F.lit(json.dumps([[{"t": "", **entry(i, rules[i])} for i in index.get("", [])]])), _ENTRY)
    address = F.coalesce(F.col(url), F.lit(""))
    parts = pages.select(F.col(id), host_of(address).alias("host"), path_of(address).alias("path"), F.translate(address, UPPER, LOWER).alias("_url"))
    parts = parts.withColumn("_site", F.concat("host", "path"))
    found = F.flatten(F.transform(tokens_of(F.col("_url")), lambda t: F.filter(F.get(slots, F.pmod(F.xxhash64(t), F.lit(number)).cast("int")), lambda e: e["t"] == t)))
    fetched = F.when(F.col("_url").contains("://"), F.concat(found, F.get(always, F.lit(0)))).otherwise(F.array().cast(_ENTRY[6:-1]))
    parts = parts.withColumn("_rules", fetched)
    hits = F.filter("_rules", lambda e: F.rlike(F.when(e["site"], F.col("_site")).otherwise(F.col("_url")), e["regex"]))
    parts = parts.select(id, "host", "path", F.size("_rules").alias("n_candidates"), hits.alias("_hits"))
    site = F.array_min(F.transform(F.filter("_hits", lambda e: e["site"]), lambda e: F.struct((-F.length(e["name"])).alias("n"), e["name"].alias("name"), e["action"].alias("action"))))
    pattern = F.array_min(F.transform(F.filter("_hits", lambda e: ~e["site"]), lambda e: F.struct(e["i"].alias("i"), e["name"].alias("name"))))
    judged = parts.select(id, "host", "path", site.alias("_s"), pattern.alias("_p"), "n_candidates")
    verdict = F.coalesce(F.col("_s.action"), F.when(F.col("_p.name").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(id, "host", "path", F.col("_s.name").alias("rule"), F.col("_p.name").alias("pattern"), "n_candidates", verdict.alias("verdict"))


#: The same verdicts without the index, for a check.
_HITS = "|".join(pattern_rule(p).regex.removeprefix("(?s)").replace("(?<![a-z0-9])", "(^|[^a-z0-9])") for p in PATTERNS)
ORACLE = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, url, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
  translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM u),
r AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN contains(low, '://') AND regexp_matches(low, '{HITS}', 's') THEN 'block' ELSE 'allow' END AS verdict FROM r
""".replace("{HITS}", _HITS)
