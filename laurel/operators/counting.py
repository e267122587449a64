"""Counting outcomes: official, physical and real counts, rankings, duplicates and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laurel.functions.parse import MEDALS
from laurel.operators.match import numbered


def conditional_counts(rows: DataFrame, by: list[str], column: str, values: dict[str, str]) -> DataFrame:
    """One column of counts for each value: {value: name}. One pass, partial aggregation before the shuffle."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col(column) == v).alias(name) for v, name in values.items()])


def official(rows: DataFrame, key: list[str], medal: str) -> DataFrame:
    """One row for each outcome: a team's medal counts once however many members hold it."""
    return rows.where(F.col(medal).isNotNull()).select(*key, medal).distinct()


def official_counts(rows: DataFrame, by: list[str], key: list[str], medal: str, medals: tuple[str, ...] = MEDALS) -> DataFrame:
    """Per group: official counts of each medal, their total, and the physical count of rows with a medal.

    One aggregation by outcome (with its number of rows), then one by group: both numbers come from one scan.
    """
    per_outcome = rows.where(F.col(medal).isNotNull()).groupBy(*dict.fromkeys([*by, *key, medal])).agg(F.count("*").alias("_n"))
    sums = [F.count_if(F.col(medal) == m).alias(m.lower()) for m in medals]
    return per_outcome.groupBy(*by).agg(*sums, F.count("*").alias("official"), F.sum("_n").alias("physical"))


def real_counts(rows: DataFrame, by: list[str], group: list[str], canonical: Column) -> DataFrame:
    """Rows counted without the second naming of the same result.

    Within a group, rows of the canonical naming count if there are any, else those of the descriptive one. A group with
    more descriptive than canonical rows is undecided. Per `by`: real, source_rows and undecided.
    """
    families = rows.groupBy(*dict.fromkeys([*by, *group])).agg(F.count_if(canonical).alias("_c"), F.count_if(~canonical).alias("_d"))
    real = F.when(F.col("_c") > 0, F.col("_c")).otherwise(F.col("_d"))
    undecided = F.count_if((F.col("_c") > 0) & (F.col("_d") > F.col("_c")))
    return families.groupBy(*by).agg(F.sum(real).alias("real"), F.sum(F.col("_c") + F.col("_d")).alias("source_rows"), undecided.alias("undecided"))


def ranked(rows: DataFrame, order: list, partition: list[str] | None = None, name: str = "place") -> DataFrame:
    """row_number over a full order; without partitions the rows meet in one task, so aggregate before."""
    window = W.partitionBy(*partition) if partition else W.partitionBy(F.lit(0))
    return rows.withColumn(name, F.row_number().over(window.orderBy(*order)).cast("long"))


def top_per_group(rows: DataFrame, partition: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; Spark limits each task's groups before the shuffle."""
    return ranked(rows, order, partition).where(F.col("place") <= n)


def duplicate_excess(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row: groups with more than one row, and rows beyond the first of each."""
    groups = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess"))


def mode(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """The most frequent value of each group; ties go to the smaller value."""
    counted = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    best = F.min_by(column, F.struct((-F.col("n")).alias("n"), F.col(column)))
    return counted.groupBy(*by).agg(best.alias(column), F.max("n").alias("n"))


def iqr_outliers(rows: DataFrame, by: list[str], column: str, times: float = 1.5) -> DataFrame:
    """Per group of four values or more with a spread: quartiles and the number of values beyond `times` of it."""
    q = rows.groupBy(*by).agg(F.percentile(column, 0.25).alias("q1"), F.percentile(column, 0.75).alias("q3"), F.count(column).alias("n")).where("n >= 4 AND q3 > q1")
    spread = times * (F.col("q3") - F.col("q1"))
    joined = rows.join(q, by)
    out = (F.col(column) < F.col("q1") - spread) | (F.col(column) > F.col("q3") + spread)
    return joined.groupBy(*by).agg(F.first("q1").alias("q1"), F.first("q3").alias("q3"), F.count_if(out).alias("outliers"))


def profile(rows: DataFrame) -> DataFrame:
    """A row for each column: rows, nulls, distinct values, least and greatest length as text. One aggregation over all columns."""
    aggregates = []
    for c in rows.columns:
        text = F.length(F.col(c).cast("string"))
        aggregates.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_distinct(c).alias("distinct_values"), F.min(text).cast("long").alias("least_length"), F.max(text).cast("long").alias("greatest_length")))
    return rows.agg(F.array(*aggregates).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def numeric_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each numeric column: least, greatest and mean (rounded to 4 places)."""
    parts = [F.struct(F.lit(c).alias("column"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("greatest"), F.round(F.avg(c), 4).alias("mean")) for c in columns]
    return rows.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def value_frequencies(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The n most and the n least frequent values: value, n, common_place and rare_place."""
    counted = rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    both = numbered(numbered(counted, [F.desc("n"), "value"], "common_place"), ["n", "value"], "rare_place")
    return both.where((F.col("common_place") <= n) | (F.col("rare_place") <= n))


def shared_counts(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """The multiset intersection of two tables' keys: key and n, the lesser of its counts; each side is counted before they meet."""
    ones = a.groupBy(*key).agg(F.count("*").alias("_a")).join(b.groupBy(*key).agg(F.count("*").alias("_b")), key)
    return ones.select(*key, F.least("_a", "_b").alias("n"))


def remaining_counts(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """The multiset difference: key and n, how much more often it is in `a` than in `b`."""
    ones = a.groupBy(*key).agg(F.count("*").alias("_a")).join(b.groupBy(*key).agg(F.count("*").alias("_b")), key, "left")
    return ones.select(*key, (F.col("_a") - F.coalesce("_b", F.lit(0))).alias("n")).where("n > 0")


def stratified_sample(rows: DataFrame, strata: list[str], key: str, n: int, seed: int) -> DataFrame:
    """At most n rows of each stratum in the order of a hash of key and seed: the same rows at every run."""
    mixed = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string")))
    return top_per_group(rows.withColumn("_h", mixed), strata, ["_h", key], n).drop("_h")


def suspicious_groups(rows: DataFrame, by: list[str], entity: str, tied: Column) -> DataFrame:
    """Outcomes held by more than one entity, classified: TIE (all rows tied), MULTI_THIRD (the third place), SHARED (two entities) or REVIEW."""
    found = rows.groupBy(*by).agg(F.count_distinct(entity).alias("entities"), F.count("*").alias("n"), F.count_if(tied).alias("tied")).where("entities > 1")
    kind = F.when(F.col("tied") == F.col("n"), "TIE").when(F.col(by[-1]) == "Bronze", "MULTI_THIRD").when(F.col("entities") == 2, "SHARED").otherwise("REVIEW")
    return found.withColumn("kind", kind)
