"""Results of the parameterized lookups: a status and named tables."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.functions.parse import MEDALS, SEASONS
from laurel.functions.text import fold_python


class Status(Enum):
    OK = "OK"
    NO_MATCH = "NO_MATCH"
    FILTERED_EMPTY = "FILTERED_EMPTY"
    AMBIGUOUS = "AMBIGUOUS"


@dataclass
class Answer:
    status: Status
    parameters: dict
    tables: OrderedDict[str, DataFrame] = field(default_factory=OrderedDict)


class ParameterError(ValueError):
    """A parameter is outside its domain."""


def one_of(value: str | None, allowed: tuple[str, ...], name: str) -> str | None:
    """The allowed spelling of a value, whatever its case and accents."""
    if value is None:
        return None
    for a in allowed:
        if fold_python(value).strip() == fold_python(a):
            return a
    raise ParameterError(f"{name} must be one of {', '.join(allowed)}, or None for all")


def medal(value: str | None) -> str | None:
    return one_of(value, MEDALS, "medal")


def season(value: str | None) -> str | None:
    return one_of(value, SEASONS, "season")


def clamped(value: int | None, default: int, most: int) -> int:
    """The default for nothing, zero and less; never over the most."""
    return default if value is None or value < 1 else min(value, most)


def where_all(rows: DataFrame, conditions: list[Column | None]) -> DataFrame:
    """rows under those conditions that are given: a parameter that is None leaves no predicate in the plan."""
    for c in conditions:
        if c is not None:
            rows = rows.where(c)
    return rows


def years(year: int | None, first: int | None, last: int | None) -> list[Column | None]:
    if first is not None and last is not None and first > last:
        raise ParameterError("the first year is after the last")
    at = F.col("anio")
    return [None if year is None else at == year, None if first is None else at >= first, None if last is None else at <= last]
