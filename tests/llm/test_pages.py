"""Archives by round trip, URL rules by direct evaluation."""

import gzip
import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from laurel.llm import registry, url_filter, warc


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunks_round_trip(payload, size):
    assert warc.unchunked(warc.chunked(payload, size)) == payload


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000), st.integers(60, 500))
def test_records_round_trip(payload, segment):
    made = warc.records_of(7, "0.0", "http://x/\r\n", payload, "d", None, segment)
    found = list(warc.parsed(b"".join(made)))
    assert len(found) == len(made) and all(p is None for _, _, p in found)
    members = b"".join(warc.member(r) + b"\0" for r in made)
    assert gzip.decompress(members) == b"".join(made) and [x for x, _ in warc.unzipped(members)] == made
    block = b"".join(b for _, b, _ in found)
    assert warc.body_of(block)[0] == payload
    if len(found) > 1:
        assert found[-1][0]["warc-segment-total-length"] == str(len(block)) and all(len(b) <= segment for _, b, _ in found)


@pytest.mark.parametrize("broken", [b"5\r\nabc", b"zz\r\n", b"3\r\nabcX\r\n0\r\n\r\n", b""])
def test_broken_chunks(broken):
    with pytest.raises(ValueError):
        warc.unchunked(broken)


def rows(spark):
    big = "é<b>" * 40_000
    data = [(1, "http://a/1", "x" * 99), (2, "http://a/2", "x" * 99), (3, None, "y" * 100), (4, "http://a/4\nq", "y" * 100), (5, "u", None), (6, "u", ""), (7, "u", big), (8, "u", big), (9, "u", "WARC/1.1\r\n\r\n" * 9 + "\r\n0\r\n\r\n"), (10, "u", "z" * 300_000)]
    return spark.createDataFrame([(*r, "clash", "clash") for r in data], "page_id long, url string, html string, digest string, payload string")


@pytest.mark.parametrize("segment", [200, 5000, 64 << 10])
def test_archives_round_trip(spark, tmp_path, segment):
    pages = rows(spark)
    warc.write(pages, f"file://{tmp_path}/w", segment_bytes=segment)
    found = {r.page_id: r for r in warc.read(spark, f"file://{tmp_path}/w").collect()}
    texts = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    assert found.keys() == texts.keys()
    for k, r in found.items():
        assert r.problem is None and r.payload_bytes == len(texts[k]) and r.declared_digest == hashlib.sha256(texts[k]).hexdigest()
        assert (r.record_type, r.refers_to) == (("revisit", {4: 3, 8: 7}[k]) if k in (4, 8) else ("response", None))
        assert (r.payload is None) if k in (4, 8) else bytes(r.payload) == texts[k]


def test_missing_and_wrong_segments_are_reported(spark, tmp_path):
    warc.write(rows(spark).where("page_id = 10"), f"file://{tmp_path}/w", segment_bytes=50_000)
    segments = warc.records(spark, f"file://{tmp_path}/w")
    assert warc.reassembled(segments.where("segment <> 3")).first().problem == "segments are missing"
    assert warc.reassembled(segments.where("total_length IS NULL")).first().problem == "segments are missing"
    assert warc.reassembled(segments.withColumn("total_length", segments["total_length"] + 1)).first().problem == "total length differs"


def test_broken_archives_lose_only_what_is_broken(spark, tmp_path):
    made = [warc.records_of(k, f"0.{k}", f"http://x/{k}", f"payload {k} ".encode() * 99, "d", None, 1 << 16)[0] for k in range(5)]
    zipped = [warc.member(r) + b"\0" for r in made]
    damaged = zipped[1][:40] + b"\xff" * 20 + zipped[1][60:]
    no_length = [re.sub(rb"Content-Length: \d+\r\n(?=\r\nHTTP)", b"", made[1]), made[1].replace(b"WARC-Type", b"X-Type"), made[1].replace(b"chunked\r\n\r\n", b"chunked\r\n\r\nzz")]
    files = {
        "whole.txt": b"".join(zipped),
        "cut.txt": b"".join(zipped[:3]) + zipped[3][:50],
        "damaged.txt": zipped[0] + damaged + zipped[2],
        "plain.txt": made[0] + no_length[0] + made[2] + no_length[1] + made[3],
        "plain_cut.txt": made[0] + made[1][:-30],
        "empty.txt": b"",
        "other.txt": b"no archive at all",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        rows = warc.read(spark, f"file://{tmp_path}/{name}").collect()
        good = sorted(r.page_id for r in rows if r.problem is None)
        want, broken = {"whole.txt": (5, 0), "cut.txt": (3, 1), "damaged.txt": ([0, 2], 1), "plain.txt": ([0, 2, 3], 2), "plain_cut.txt": (1, 1), "empty.txt": (0, 0), "other.txt": (0, 1)}[name]
        assert good == (list(range(want)) if isinstance(want, int) else want)
        assert len(rows) - len(good) == broken and all(r.payload is None for r in rows if r.problem)
        assert all(bytes(r.payload) == f"payload {r.page_id} ".encode() * 99 for r in rows if r.problem is None)


def test_pages_without_an_id(spark, tmp_path):
    pages = spark.createDataFrame([(None, "u", "a" * 200), (None, None, "b"), (2, "u", "a" * 200), (2, "u", "a" * 200), (3, "v", "a" * 200)], "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/w", segment_bytes=120)
    rows = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to), r.payload_bytes, r.problem) for r in rows) == sorted([("None", "response", "None", 200, None), ("None", "response", "None", 1, None), ("2", "response", "None", 200, None), ("2", "response", "None", 200, None), ("3", "revisit", "2", 200, None)], key=str)


def test_no_pages(spark, tmp_path):
    warc.write(rows(spark).where("page_id < 0"), f"file://{tmp_path}/w")
    assert warc.read(spark, f"file://{tmp_path}/w").count() == 0


def site_verdict(host, path):
    fits = [(len(t), a, t) for a, t in url_filter.SITE_RULES for h, _, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def matches(pattern, low):
    """The pattern's meaning, character by character: its pieces one after the other, the first at a token's beginning if it begins with one."""
    pieces = pattern.lower().split("*")
    for at in range(len(low)):
        if not low.startswith(pieces[0], at) or (re.match("[a-z0-9]", pieces[0]) and at and re.match("[a-z0-9]", low[at - 1])):
            continue
        to = at + len(pieces[0])
        for piece in pieces[1:]:
            to = low.find(piece, to)
            if to < 0:
                break
            to += len(piece)
        if to >= 0:
            return True
    return False


def test_patterns_of_any_shape(spark):
    patterns = ["*foo/*", "/foo*bar/*", "abc", "x*", "*", "Q/R*s-t", "/a*b*c/", "-k-", "(z)+*$"]
    urls = [f"http://h.org/{p}" for p in ("barfoo/", "foox/xbar/", "foo/bar/", "foo", "abcd", "dabc", "x", "q/rrs-t/", "q/r/s-t", "a1b2c/", "a/b/c/", "m-k-n", "(z)+1$", "zz", "foo/abc/x-k-")] + ["nothing", "http://", None]
    for k in range(1, len(patterns) + 1):
        chosen = [p for i, p in enumerate(patterns) if p != "*" or k == len(patterns)][:k]
        pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        for r in url_filter.judge(pages, site_rules=(), patterns=chosen).collect():
            u = (urls[r.page_id] or "").lower()
            want = [p for p in chosen if "://" in u and matches(p, u)]
            assert r.pattern == (want[0] if want else None) and r.verdict == ("block" if want else "allow")


def test_long_lists(spark):
    rules = [("block", f"site{i}.org/") for i in range(20_000)]
    pages = spark.createDataFrame([(i, f"http://www.site{i * 7}.org/x") for i in range(5000)], "page_id long, url string")
    rows = url_filter.judge(pages, site_rules=rules, patterns=("/x/*",)).collect()
    assert all((r.rule, r.n_candidates) == ((f"site{r.page_id * 7}.org/", 2) if r.page_id * 7 < 20_000 else (None, 1)) for r in rows)


def test_url_rules(spark, sf):
    urls = [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    urls += [None, "", "no scheme/en/", "http://", "HTTP://WWW.Example.COM/en/x", "http://www.example.com/EN/x", "http://a.example.com/en/", "http://example.com/en", "http://notexample.com/en/", "http://x.net/es/?q", "http://x.net?/es/", "http://net/fr/#", "a://b://c.net/es/", "http://x.org/ads/1", "http://ads.x.org", "http://my.ads-track.org/", "http://x.com", "http://x.com/ads/", "http://x.org/" + "a/" * 20_000 + "track/", "http://x.net/es/\n", "http://u@x.net:80/fr/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for r in url_filter.judge(pages).collect():
        u = urls[r.page_id] or ""
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u)
        host, path = (re.sub("[A-Z]+", lambda x: x.group().lower(), m[1]), m[2]) if m else ("", "")
        action, rule = site_verdict(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if action:
            assert r.verdict == action
        else:
            low = re.sub("[A-Z]+", lambda x: x.group().lower(), u)
            hit = "://" in u and any(matches(p, low) for p in url_filter.PATTERNS)
            assert r.verdict == ("block" if hit else "allow")
    assert url_filter.judge(pages.where("page_id < 0")).count() == 0


def test_rules_are_filed_under_their_rarest_token():
    rules = [url_filter.site_rule("block", "example.com/en/"), url_filter.pattern_rule("/ads/*")]
    assert url_filter.index_of(rules, {"example": 9, "com": 99, "en": 5, "ads": 1}) == {"en": [0], "ads": [1]}


def test_query(spark, sf):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    first = {}
    for k in sorted(pages):
        if len(pages[k]) >= 100:
            first.setdefault(pages[k], k)
    got = registry.op8_warc(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        leader = first.get(pages[r.page_id], r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(pages[r.page_id]), hashlib.sha256(pages[r.page_id]).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if leader == r.page_id else ("revisit", leader))
