"""Wide and long forms, nesting, dimensions and tagged unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.operators.match import numbered


def melted(rows: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """Long form of wide columns; nulls are kept."""
    return rows.unpivot(ids, columns, name, value)


def nested(rows: DataFrame, by: list[str], fields: list[str], order: list[str], name: str) -> DataFrame:
    """One row per group with an array of structs in a fixed order; groups are entities of bounded size."""
    first = [*order, *(f for f in fields if f not in order)]
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*first))).alias(name))


def unnested(rows: DataFrame, array: str, keep: list[str]) -> DataFrame:
    return rows.select(*keep, F.explode(array).alias("_x")).select(*keep, "_x.*")


def with_matches(rows: DataFrame, array: str, predicate, name: str = "matches") -> DataFrame:
    """Rows of which an element of the array matches, with the matching elements."""
    return rows.where(F.exists(array, predicate)).withColumn(name, F.filter(array, predicate))


def dimension(rows: DataFrame, columns: list[str], id: str) -> DataFrame:
    """Distinct values with dense ids in their order, numbered by range partitions and offsets."""
    return numbered(rows.select(*columns).distinct(), columns, id)


def hashed_id(*columns: Column) -> Column:
    """A 64-bit id of a natural key, for facts."""
    return F.xxhash64(*columns)


def tagged(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of several tables under one tag column; columns that a table lacks are null."""
    out = None
    for tag, part in parts.items():
        part = part.withColumn("kind", F.lit(tag))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
