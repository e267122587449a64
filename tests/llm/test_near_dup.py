"""Groups against exact comparison of all pairs."""

from collections import defaultdict

import numpy as np
import pytest

from laurel.llm import near_dup, registry


def brute(rows, width, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + width]) for j in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()
    held, groups = defaultdict(list), near_dup.UnionFind()
    for i, s in sets.items():
        common = defaultdict(int)
        for e in s:
            for k in held[e]:
                common[k] += 1
            held[e].append(i)
        for k, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[k]) - n):
                groups.union(i, k)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("limits", [{}, {"family": 3, "block": 2}, {"bucket": 2}])
def test_all_paths_equal_brute_force(spark, sf, limits, monkeypatch):
    monkeypatch.setattr(near_dup, "BROADCAST", 0 if limits else 1000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 4, 80)
    assert found(near_dup.groups(docs, width=4, **limits)) == want


def chain(rng, n, length, change):
    """Texts that each differ a little from the one before."""
    words = [f"w{rng.integers(10_000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        words = list(words)
        for k in rng.choice(length, change, replace=False):
            words[k] = f"w{rng.integers(10_000)}"
        out.append(" ".join(words))
    return out


def test_chains_hubs_and_copies(spark):
    rng = np.random.default_rng(3)
    texts = chain(rng, 30, 120, 2) + ["same words here again and again"] * 40
    base = [f"b{i}" for i in range(100)]
    for i in range(40):  # each differs from the hub in two places, from the others in four
        own = list(base)
        own[2 * i], own[2 * i + 1] = f"x{i}", f"y{i}"
        texts.append(" ".join(own))
    texts.append(" ".join(base))
    rows = list(enumerate(texts))
    order = rng.permutation(len(rows))
    rows = [(int(order[i]), t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 5, 80)
    for limits in ({}, {"family": 4, "block": 8}, {"bucket": 3, "family": 4, "block": 3}):
        assert found(near_dup.groups(df, **limits)) == want


def test_odd_documents(odd, nothing):
    rows = odd.select("doc_id", "text").distinct().collect()
    got = near_dup.groups(odd, width=4)
    assert found(got) == brute([(r.doc_id, r.text) for r in rows], 4, 80)
    assert got.count() == odd.count()
    assert near_dup.groups(nothing).count() == 0
    kept = near_dup.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 9, 10]


def test_rows_are_grouped_by_their_own_text(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(5, a), (3, a + " end"), (5, b), (5, b), (7, c), (None, c + " end"), (None, "only this here and no id"), (None, "only this here and no id"), (None, None), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.groups(docs, width=4).collect()]))
    want = [(5, 57, 3, False), (3, 58, 3, True), (5, 57, 5, True), (5, 57, 5, True), (7, 57, 7, True), (None, 58, 7, False), (None, 3, None, True), (None, 3, None, True), (None, 0, None, True), (9, 0, 9, True)]
    assert got == sorted(map(str, want))
    left = sorted(map(str, [tuple(r) for r in near_dup.deduplicated(docs, width=4).collect()]))
    assert left == sorted(map(str, [rows[i] for i, w in enumerate(want) if w[3]]))
    named = docs.where("doc_id IS NOT NULL").selectExpr("concat('n', doc_id) AS doc_id", "text")
    assert {(r.doc_id, r.component_id) for r in near_dup.groups(named, width=4).collect()} == {("n5", "n3"), ("n3", "n3"), ("n5", "n5"), ("n7", "n7"), ("n9", "n9")}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 62, 200).astype(np.uint64)])
    few = a[:3]
    flat, bounds = np.concatenate([a, b, few]), np.array([0, 1000, 2000, 2003])
    s = near_dup.super_minhash(flat, bounds, 256)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.1
    assert (near_dup.super_minhash(few[::-1].copy(), np.array([0, 3]), 256)[0] == s[2]).all()


def test_query(spark, sf):
    got = registry.op6_near_dup(spark, sf).collect()
    assert all(r.kept == (r.doc_id == r.component_id) and r.component_id <= r.doc_id for r in got)
