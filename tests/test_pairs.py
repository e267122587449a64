"""Operators on pairs: what they give, and that pairs are not exchanged or listed on the way."""

import random
import re

import pytest
from pyspark.sql import functions as F

from laurel.operators import aliases, dedup, graph, match, shared
from laurel.plans import catalog


def exchanged_by_ends(df) -> bool:
    """Whether the plan deals rows by an end of a pair (a or b)."""
    return re.search(r"Exchange hashpartitioning\([ab]#", df._jdf.queryExecution().executedPlan().toString()) is not None


def most_rows(df, of: str = "Join") -> int:
    """The most rows that a node of the plan with `of` in its name gives out."""
    df.collect()

    def most(plan) -> int:
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            below = [plan.executedPlan()]
        elif name.endswith("QueryStage"):
            below = [plan.plan()]
        else:
            below = [plan.children().apply(i) for i in range(plan.children().size())]
        own = plan.metrics().get("numOutputRows").get().value() if of in name and plan.metrics().contains("numOutputRows") else 0
        return max([own, *map(most, below)])

    return most(df._jdf.queryExecution().executedPlan())


def test_keys_of_many_rows_meet_in_parts(spark):
    rows = spark.createDataFrame([(i, i % 3 if i < 50 else None) for i in range(60)], "id long, k long")
    left, right = shared.met(rows, ["k"], "id", most=4)
    got = [(r.a, r.b) for r in left.join(right, ["k", "_part"]).collect()]
    assert sorted(got) == sorted((a, b) for a in range(50) for b in range(50) if a % 3 == b % 3)
    assert left.groupBy("k", "_part").count().count() > 3


def test_events_within_a_block_are_judged_by_all_their_places(spark):
    # 100 frequent places of which 64 are bits, others beyond them, unknown ones, and an event that never occurs.
    names = {1: "Relay Relay", 2: "Relay", 3: "Relay", 4: "Relay", 5: "Relay", 6: "Relay", 7: None}
    events = spark.createDataFrame([(i, n, i % 2 if i < 7 else 1) for i, n in names.items()], "id long, name string, size long")
    seen = [(1, 1, e) for e in range(70)] + [(3, 1, e) for e in range(70, 100)] + [(5, 1, e) for e in (69, 99, 99)] + [(2, 2, 7), (4, 2, 7), (6, None, 7), (2, None, 7), (7, 1, None)]
    occurrences = spark.createDataFrame(seen, "id long, source long, edition long")
    known = {i: {(s, e) for j, s, e in seen if j == i and s is not None and e is not None} for i in names}
    want = {}
    for a in names:
        for b in names:
            if a < b and (a % 2 if a < 7 else 1) == (b % 2 if b < 7 else 1):
                loss = names[a] != names[b] and names[b] is not None
                want[a, b] = "CONFLICT_ALIAS" if known[a] & known[b] else "REVIEW_ALIAS" if loss else "SAFE_ALIAS"
    within = aliases.refined_events_within(events, occurrences, ["size"]).collect()
    assert {(r.a, r.b): r["class"] for r in within} == want and len(within) == len(want)
    assert set(want.values()) == {"CONFLICT_ALIAS", "REVIEW_ALIAS", "SAFE_ALIAS"}
    pairs = spark.createDataFrame(list(want), "a long, b long")
    assert {(r.a, r.b): r["class"] for r in aliases.refined_events(pairs, events, occurrences).collect()} == want


def test_alias_events_are_not_exchanged_as_pairs(spark, sf):
    assert not exchanged_by_ends(catalog.QUERIES["alias_events_coexistence"](spark, sf))


def test_identity_equals_brute_force(spark):
    # Entities of several aliases, rows of several aliases, nulls (an unknown size is compatible), and rows and entities that are repeated.
    rows = [(i % 40, f"n{i % 7}" if i % 11 else None, i % 9 if i % 13 else None, [f"c{i % 3}"] if i % 17 else None) for i in range(150)] + [(500, "only", 1, None)]
    known = [(i % 60 if i % 19 else None, f"n{i * i % 9}", i % 23, [f"c{i % 4}", None]) for i in range(70)] + [(900, "only", 1, ["c1"]), (900, "only", 3, ["c2"])]
    schema = "id long, name string, size long, near array<string>"
    r, k = spark.createDataFrame(rows, schema), spark.createDataFrame(known, schema.replace("id ", "e "))
    want = {}
    for id in {x[0] for x in rows}:
        met = [(e, bool(x[3]) and x[3][0] == near[0]) for x in rows if x[0] == id for e, name, size, near in known if e is not None and x[1] == name and (x[2] is None or abs(x[2] - size) <= 2)]
        every, shared_too = {e for e, _ in met}, {e for e, n in met if n}
        want[id] = ("STRONG", *every) if len(every) == 1 else ("CONTEXTUAL", *shared_too) if len(shared_too) == 1 else ("AMBIGUOUS" if every else "NEW", None)
    got = match.identity(r, k, ["name"], F.abs(F.col("k.size") - F.col("r.size")) <= 2, ["near"], "id", "e")
    assert {x.id: (x["class"], x.entity) for x in got.collect()} == want
    assert {c for c, _ in want.values()} == {"STRONG", "CONTEXTUAL", "AMBIGUOUS", "NEW"}


def test_identity_does_not_list_pairs_of_copies(spark):
    rows = spark.range(300).select("id", F.lit("n").alias("name"), F.array(F.lit("c")).alias("near"))
    got = match.identity(rows, rows.withColumnRenamed("id", "e"), ["name"], F.lit(True), ["near"], "id", "e")
    assert most_rows(got) <= 300
    assert {(x["class"], x.entity) for x in got.collect()} == {("AMBIGUOUS", None)}


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("least", [0.5, 0.8, 0.93, 0.99])
def test_roster_equals_brute_force(spark, least):
    draw = random.Random(3)
    word = lambda n: "".join(draw.choice("abc") for _ in range(n))

    def changed(name: str) -> str:
        for _ in range(draw.randrange(5)):
            i = draw.randrange(len(name) + 1)
            name = name[:i] + draw.choice(["", "a", "b"]) + name[i + draw.randrange(2) :]
        return name

    listed = [(i % 2, word(draw.randrange(12, 40))) for i in range(60)] + [(0, "a"), (1, ""), (0, None)]
    rows = [(i, b, i % 70, changed(name) if name is not None else None) for i, (b, name) in enumerate(listed * 3)]
    at = spark.createDataFrame(rows, "id long, block long, person long, name string")
    on = {(b, p) for _, b, p, name in rows for x, r in listed if name is not None and r is not None and x == b and abs(len(name) - len(r)) <= 2 and (name == r or 1 - edits(name, r) / max(len(name), len(r)) >= least)}
    first = {}
    for id, b, p, _ in rows:
        first.setdefault((b, p), id)
    want = {id: "NOT_IN_ROSTER" if (b, p) not in on else "ROSTER_MATCH" if first[b, p] == id else "DUPLICATE_ROW" for id, b, p, _ in rows}
    got = aliases.on_roster(at, spark.createDataFrame(listed, "block long, name string"), ["block"], "id", "person", "name", least=least).collect()
    assert {r.id: r["class"] for r in got} == want and len(got) == len(rows)
    assert len(set(want.values())) > 1


def test_roster_looks_for_a_name_once(spark):
    rows = spark.createDataFrame([(i, i % 2, i, "Customer number 00008") for i in range(300)], "id long, block long, person long, name string")
    roster = spark.createDataFrame([(i % 2, f"Customer number 0000{i // 2}") for i in range(10)], "block long, name string")
    got = aliases.on_roster(rows, roster, ["block"], "id", "person", "name", least=0.95)
    assert most_rows(got, "Generate") < 300
    assert {r["class"] for r in got.collect()} == {"ROSTER_MATCH"}


@pytest.mark.parametrize("most_frequent", [None, 9])
def test_token_pairs_equal_brute_force(spark, monkeypatch, most_frequent):
    # Copies beyond what is measured together, empty and unknown words, unknown blocks, and pairs whose first shared word is a frequent one.
    monkeypatch.setattr(dedup, "MEMBERS", 4)
    draw = random.Random(5)
    rows = [(i, i % 3 if i % 29 else None, draw.sample("abcdefgh", draw.randrange(4))) for i in range(60)] + [(100 + i, 1, ["x", "a"]) for i in range(15)] + [(200, 1, None)]
    often = {(g, t): sum(h == g and t in (v or []) for _, h, v in rows) for _, g, w in rows for t in w or []}
    want = {}
    for a, g, v in rows:
        for b, h, w in rows:
            shared_words = set(v or []) & set(w or [])
            if a < b and g is not None and g == h and any(not most_frequent or often[g, t] <= most_frequent for t in shared_words):
                want[a, b] = (len(shared_words), len(shared_words) == min(len(v), len(w)), len(shared_words) / len(set(v) | set(w)))
    at = spark.createDataFrame(rows, "id long, block long, w array<string>")
    got = dedup.token_pairs(at, "id", "w", ["block"], most_frequent=most_frequent).collect()
    assert {(r.a, r.b): (r.common, r.containment, r.jaccard) for r in got} == want and len(got) == len(want)
    half = dedup.token_pairs(at, "id", "w", ["block"], 0.5, most_frequent).collect()
    assert {(r.a, r.b) for r in half} == {k for k, v in want.items() if v[2] >= 0.5}


def test_token_pairs_are_not_exchanged_as_pairs(spark, sf):
    assert not exchanged_by_ends(catalog.QUERIES["token_pairs_jaccard_all"](spark, sf))
    copies = spark.range(300).select("id", F.lit(1).alias("block"), F.array(F.lit("a"), F.lit("b")).alias("w"))
    got = dedup.token_pairs(copies, "id", "w", ["block"])
    assert most_rows(got) <= 300 and got.count() == 300 * 299 // 2


def test_components_within_groups_equal_those_of_listed_links(spark):
    # Two keys that overlap, unknown values of both, rows that are repeated, and groups of copies.
    draw = random.Random(8)
    rows = [(i, draw.choice([None, *range(40)]), draw.choice([None, *range(30)]), draw.randrange(3), draw.choice([None, "u", "v"])) for i in range(120)] + [(500 + i, 99, 99, 1, "u") for i in range(12)]
    rows += rows[:20]
    at = spark.createDataFrame(rows, "id long, k long, l long, m long, kind string")
    keys = [["m", "k"], ["m", "l"]]
    links = [(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[3] == y[3] and ((x[1] is not None and x[1] == y[1]) or (x[2] is not None and x[2] == y[2]))]
    listed = spark.createDataFrame(links, "a long, b long")
    attributes = at.select(F.col("id").alias("node"), "kind").distinct()
    for most in (100, 11):
        want = sorted(map(tuple, graph.safe_components(listed, attributes, ["kind"], most).collect()))
        assert sorted(map(tuple, graph.safe_components_within(at, "id", keys, ["kind"], most).collect())) == want
        assert len({w[3] for w in want}) == 3 + (most < 100)


def test_safe_components_lists_no_links(spark, sf, tmp_path, monkeypatch):
    part = spark.read.parquet(f"{sf}/part.parquet")
    keys = part.count()
    copies = part.crossJoin(spark.range(30).select((F.col("id") * keys).alias("_shift"))).withColumn("p_partkey", F.col("p_partkey") + F.col("_shift")).drop("_shift")
    copies.write.parquet(f"{tmp_path}/part.parquet")
    seen = []
    plain = graph.components
    monkeypatch.setattr(graph, "components", lambda links: seen.append(links.count()) or plain(links))
    got = catalog.QUERIES["safe_components"](spark, str(tmp_path)).collect()
    assert seen[0] <= 2 * keys and sum(r.members for r in got) == 30 * keys and sum(r.pairs for r in got) >= keys * 30 * 29 // 2
