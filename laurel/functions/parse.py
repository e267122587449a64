"""Cleaning and parsing expressions for untyped source columns. A value that does not parse becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings that mean "unknown" in some columns.
UNKNOWN = ("NA", "N/A", "null", "None")
MEDALS = ("Gold", "Silver", "Bronze")
SEASONS = ("Summer", "Winter", "Summer Youth", "Winter Youth", "Intercalated Games")
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "d MMMM yyyy", "d MMM yyyy")


def blank_to_null(text: Column, unknown: tuple[str, ...] = ()) -> Column:
    """Trimmed text without carriage returns; null if blank or one of the given spellings."""
    out = F.trim(F.replace(text, F.lit("\r"), F.lit("")))
    return F.when((out == "") | out.isin(*unknown) if unknown else out == "", F.lit(None)).otherwise(out)


def without_zero_fraction(text: Column) -> Column:
    """"19.0" becomes "19"; any other fraction, "19.00" too, stays and does not parse as an integer."""
    return F.regexp_replace(text, r"\.0$", "")


def safe_cast(text: Column, kind: str) -> Column:
    """The value of a type, or null; integers accept an exact ".0"."""
    out = blank_to_null(text)
    if kind in ("short", "smallint", "int", "integer", "long", "bigint"):
        out = without_zero_fraction(out)
    if kind == "boolean":
        return boolean(text)
    if kind == "date":
        return date(text)
    return out.try_cast(kind)


def loses_precision(text: Column, precision: int, scale: int) -> Column:
    """Whether a cast to decimal(precision, scale) would round."""
    wide = blank_to_null(text).try_cast("decimal(38, 18)")
    return F.coalesce(wide != wide.try_cast(f"decimal({precision}, {scale})"), F.lit(False))


def date(text: Column) -> Column:
    out = blank_to_null(text)
    return F.coalesce(*[F.try_to_date(out, f) for f in DATE_FORMATS])


def partial_date(text: Column) -> Column:
    """FULL, YEAR_MONTH, YEAR, NONE or INVALID."""
    out = blank_to_null(text)
    return (
        F.when(out.isNull(), "NONE")
        .when(date(text).isNotNull(), "FULL")
        .when(out.rlike(r"^\d{4}[-/](0?[1-9]|1[0-2])$") | out.rlike(r"^[A-Za-z]+ \d{4}$"), "YEAR_MONTH")
        .when(out.rlike(r"^\d{4}$"), "YEAR")
        .otherwise("INVALID")
    )


def life_event(text: Column) -> Column:
    """date, city, region and country of "12 December 1886 in Bordeaux, Gironde (FRA)"."""
    first = lambda p, i=1: F.nullif(F.trim(F.regexp_extract(text, p, i)), F.lit(""))
    return F.struct(
        date(first(r"^(.*?)(?: in |$)")).alias("date"),
        first(r" in ([^,(]+)").alias("city"),
        first(r" in [^,(]+,\s*([^(]+?)\s*(?:\(|$)").alias("region"),
        first(r"\(([A-Z]{3})\)\s*$").alias("country"),
    )


def measurement(text: Column, unit: str) -> Column:
    """The first number before a unit, as in "180 cm / 75 kg"."""
    return F.nullif(F.regexp_extract(F.lower(text), rf"(\d+(?:\.\d+)?)\s*{unit}\b", 1), F.lit("")).try_cast("double")


def games(text: Column) -> Column:
    """year and season of "1992 Summer Olympics"."""
    return F.struct(
        F.nullif(F.regexp_extract(text, r"^\s*(\d{4})\b", 1), F.lit("")).try_cast("int").alias("year"),
        F.nullif(F.regexp_extract(text, r"^\s*\d{4}\s+(Summer Youth|Winter Youth|Summer|Winter|Intercalated Games|Intercalated)", 1), F.lit("")).alias("season"),
    )


def position(text: Column) -> Column:
    """position, tied, status and kind (NUMERIC, TIE, STATUS, COMPLEX, NONE) of a place such as "=5", "3" or "DNF"."""
    out = blank_to_null(text)
    number = F.regexp_extract(out, r"^=?(\d+)(?:\.0+)?$", 1)
    value = F.nullif(number, F.lit("")).try_cast("int")
    status = F.upper(F.regexp_extract(out, r"(?i)^(DNS|DNF|DQ|DSQ|AC|NM|WD)\b", 1))
    return F.struct(
        F.when(value > 0, value).alias("position"),
        F.coalesce(out.rlike(r"^=\d+"), F.lit(False)).alias("tied"),
        F.nullif(F.when(status == "DSQ", "DQ").otherwise(status), F.lit("")).alias("status"),
        F.when(out.isNull(), "NONE").when(out.rlike(r"^=\d+"), "TIE").when(value > 0, "NUMERIC").when(status != "", "STATUS").otherwise("COMPLEX").alias("kind"),
    )


def medal(text: Column) -> Column:
    low = F.lower(blank_to_null(text))
    return F.when(low == "gold", "Gold").when(low == "silver", "Silver").when(low == "bronze", "Bronze")


def medal_rank(value: Column) -> Column:
    return F.when(value == "Gold", 1).when(value == "Silver", 2).when(value == "Bronze", 3).otherwise(4)


def boolean(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "1", "yes", "y", "t", "1.0"), True).when(low.isin("false", "0", "no", "n", "f", "0.0"), False)


def age_conflict(age: Column, event_year: Column, birth: Column) -> Column:
    """CONSISTENT, CONFLICT or UNKNOWN: the recorded age lies between the difference of years less one and that difference."""
    diff = event_year - F.year(birth)
    return F.when(age.isNull() | diff.isNull(), "UNKNOWN").when(age.between(diff - 1, diff), "CONSISTENT").otherwise("CONFLICT")


def result_label(medal_: Column, status: Column, place: Column, tied: Column) -> Column:
    """The medal, else the status, else the place ("=" if tied), else a remark that nothing is known."""
    lead = F.when(F.coalesce(tied, F.lit(False)), "=").otherwise("")
    return F.coalesce(medal_, status, F.concat(lead, place.cast("string"), F.lit(" lugar")), F.lit("(sin dato de resultado)"))


def first_known(*columns: Column) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*[blank_to_null(c) for c in columns])
