from datetime import date

import pytest
from pyspark.sql import functions as F

from laurel.functions import parse, text
from laurel.sources import html


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("raw", "kind", "want"), [("19.0", "int", 19), ("19.5", "int", None), ("", "int", None), (" 7\r", "bigint", 7), ("99999", "smallint", None), ("x", "int", None), ("true", "boolean", True), ("0", "boolean", False), ("2020-02-30", "date", None), ("24 June 1987", "date", date(1987, 6, 24)), ("1 Jan 1990", "date", date(1990, 1, 1)), ("1987/6/4", "date", None), ("1987/06/04", "date", date(1987, 6, 4))])
def test_safe_cast(spark, raw, kind, want):
    assert one(spark, raw, lambda x: parse.safe_cast(x, kind)) == want


def test_precision(spark):
    assert one(spark, "12.345", lambda x: parse.loses_precision(x, 5, 2)) is True
    assert one(spark, "12.340", lambda x: parse.loses_precision(x, 5, 2)) is False


@pytest.mark.parametrize(("raw", "want"), [("3", (3, False, None, "NUMERIC")), ("=5", (5, True, None, "TIE")), ("DNF", (None, False, "DNF", "STATUS")), ("dsq", (None, False, "DQ", "STATUS")), ("4 h2 r1/3", (None, False, None, "COMPLEX")), ("", (None, False, None, "NONE")), ("12.0", (12, False, None, "NUMERIC")), ("0", (None, False, None, "COMPLEX"))])
def test_position(spark, raw, want):
    assert tuple(one(spark, raw, parse.position)) == want


def test_life_event(spark):
    found = one(spark, "12 December 1886 in Bordeaux, Gironde (FRA)", parse.life_event)
    assert tuple(found) == (date(1886, 12, 12), "Bordeaux", "Gironde", "FRA")


@pytest.mark.parametrize(("raw", "want"), [("1992 Summer Olympics", (1992, "Summer")), ("2010 Summer Youth", (2010, "Summer Youth")), ("Games", (None, None))])
def test_games(spark, raw, want):
    assert tuple(one(spark, raw, parse.games)) == want


@pytest.mark.parametrize(("raw", "want"), [("1990", "YEAR"), ("1990-05", "YEAR_MONTH"), ("June 1990", "YEAR_MONTH"), ("1990-05-31", "FULL"), ("1990-13-01", "INVALID"), ("", "NONE")])
def test_partial_dates(spark, raw, want):
    assert one(spark, raw, parse.partial_date) == want


@pytest.mark.parametrize(("raw", "want"), [("Ærø•Łódź ß", "aero lodz ss"), ("É́te", "ete"), ("ÑANDÚ", "nandu")])
def test_fold(spark, raw, want):
    assert one(spark, raw, text.fold) == want
    assert text.fold_python(raw) == want


@pytest.mark.parametrize(("a", "b", "same"), [("4 × 100 metres Relay, Men", "Men 4 x 100 m Relay", True), ("500 m", "1,500 m", False), ("10 km", "10/15 km", False), ("Marathon Olympic", "Marathon", True)])
def test_event_signatures(spark, a, b, same):
    assert (one(spark, a, text.event_signature) == one(spark, b, text.event_signature)) is same


@pytest.mark.parametrize(("name", "want"), [("Women's 100 metres", "WOMEN"), ("Men's 100 metres", "MEN"), ("Mixed doubles", "MIXED"), ("Marathon", "UNKNOWN")])
def test_event_gender(spark, name, want):
    assert one(spark, name, text.event_gender) == want


def test_event_parts(spark):
    found = one(spark, "Wrestling Men's Freestyle ≤ 74 kilograms", text.event_parts)
    assert (found.gender, found.measures, found.words) == ("MEN", ["<=74kg"], "freestyle wrestling")
    assert one(spark, "5,000 metres", text.event_parts).measures != one(spark, "10,000 metres", text.event_parts).measures


@pytest.mark.parametrize(("name", "want"), [("200 metres (Olympic)", True), ("a (b) c", False), ("plain", False)])
def test_canonical(spark, name, want):
    assert one(spark, name, text.is_canonical) is want


def test_person_names(spark):
    assert one(spark, 'William "Bill" A. Smith (-Jones) Jr', text.person_name) == "william smith"


def test_html(spark):
    page = '<table><tr><th>A</th><td>x &amp;<b>y</b></td></tr></table><a class="c" href="/z">go <i>on</i></a><script>no</script>'
    pages = spark.createDataFrame([(1, page)], "id long, html string")
    assert [tuple(r) for r in html.links(pages, "id", "html").collect()] == [(1, "/z", "go on")]
    assert html.rows(pages, "id", "html").first().cells == ["A", "x & y"]
