"""Data-quality gates: each gives rows (validation, expected, actual, status, detail), so that reports are unions of gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["validation", "expected", "actual", "status", "detail"]


class GateError(ValueError):
    """A gate failed."""


def _row(df: DataFrame, name: str, expected: int, actual: Column, detail: str = "") -> DataFrame:
    out = df.agg(actual.cast("long").alias("actual"))
    status = F.when(F.col("actual") == expected, "PASS").otherwise("FAIL")
    return out.select(F.lit(name).alias("validation"), F.lit(expected).cast("long").alias("expected"), "actual", status.alias("status"), F.lit(detail).alias("detail"))


def row_count(df: DataFrame, name: str, expected: int) -> DataFrame:
    return _row(df, name, expected, F.count("*"))


def unique(df: DataFrame, name: str, key: list[str]) -> DataFrame:
    """No two rows have one key."""
    groups = df.groupBy(*key).agg(F.count("*").alias("n"))
    return _row(groups, name, 0, F.coalesce(F.sum(F.col("n") - 1), F.lit(0)), ", ".join(key))


def no_orphans(df: DataFrame, name: str, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Every value that is not null is in the parent."""
    keys = parent.select(F.col(parent_column).alias(column))
    return _row(df.where(F.col(column).isNotNull()).join(keys, column, "left_anti"), name, 0, F.count("*"), column)


def holds(df: DataFrame, name: str, condition: Column) -> DataFrame:
    """The condition holds for every row; null counts as holding, as a CHECK does."""
    return _row(df, name, 0, F.count_if(F.coalesce(~condition, F.lit(False))))


def convertible(df: DataFrame, name: str, column: str, value: Column) -> DataFrame:
    """Every value that is not blank converts."""
    return _row(df, name, 0, F.count_if((F.trim(column) != "") & value.isNull()), column)


def not_null(df: DataFrame, name: str, column: str) -> DataFrame:
    return _row(df, name, 0, F.count_if(F.col(column).isNull()), column)


def within_length(df: DataFrame, name: str, column: str, most: int) -> DataFrame:
    return _row(df, name, 0, F.count_if(F.length(column) > most), f"{column} <= {most}")


def same_rows(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Both tables hold the same rows, repeats included."""
    b = b.select(a.columns)
    return _row(a.exceptAll(b).unionByName(b.exceptAll(a)), name, 0, F.count("*"))


def schema_matches(df: DataFrame, name: str, expected: dict[str, str]) -> DataFrame:
    """Columns and types are as registered."""
    found = dict(df.dtypes)
    wrong = sorted({k for k in expected.keys() | found.keys() if expected.get(k) != found.get(k)})
    spark = df.sparkSession
    return spark.sql(f"SELECT '{name}' AS validation, 0L AS expected, {len(wrong)}L AS actual, '{'FAIL' if wrong else 'PASS'}' AS status, '{', '.join(wrong)}' AS detail")


def document_size(df: DataFrame, name: str, most: int = 16 << 20) -> DataFrame:
    """No row is larger than `most` bytes as a JSON document."""
    return _row(df, name, 0, F.count_if(F.octet_length(F.to_json(F.struct("*"))) > most))


def row_wise(df: DataFrame, conditions: dict[str, tuple[Column, str]]) -> DataFrame:
    """Gates that count faulty rows of one table, all in one scan: name -> (what makes a row faulty, detail)."""
    rows = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(f"n{i}") for i, (bad, _) in enumerate(conditions.values())])
    found = [F.struct(F.lit(name).alias("validation"), F.lit(0).cast("long").alias("expected"), F.col(f"n{i}").alias("actual"), F.when(F.col(f"n{i}") == 0, "PASS").otherwise("FAIL").alias("status"), F.lit(detail).alias("detail")) for i, (name, (_, detail)) in enumerate(conditions.items())]
    return rows.select(F.inline(F.array(*found)))


def report(gates: list[DataFrame]) -> DataFrame:
    out = gates[0]
    for gate in gates[1:]:
        out = out.unionByName(gate)
    return out


def enforce(gates: DataFrame) -> DataFrame:
    """The report itself; GateError if a gate fails."""
    failed = gates.where("status = 'FAIL'").limit(20).collect()  # a few rows for the message
    if failed:
        raise GateError("; ".join(f"{r.validation}: expected {r.expected}, found {r.actual}" for r in failed))
    return gates
