"""Resolving entities: prioritized lookups, keyed matches with their cardinality, and identity across sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.operators import shared


def prioritized(rows: DataFrame, steps: list[Column], id: str) -> DataFrame:
    """Rows that match the first of `steps` that any row matches, with its number as step. One aggregate over one scan decides."""
    step = F.coalesce(*[F.when(F.coalesce(s, F.lit(False)), F.lit(i)) for i, s in enumerate(steps)], F.lit(None).cast("int"))
    found = rows.withColumn("step", step).where("step IS NOT NULL")
    best = found.agg(F.min("step").alias("_best"))
    return found.join(F.broadcast(best), F.col("step") == F.col("_best")).drop("_best")  # one row


def key_matches(rows: DataFrame, reference: DataFrame, key: list[str], id: str, reference_id: str) -> DataFrame:
    """id, matches and class of every row: MATCHED_EXACT (one reference row), AMBIGUOUS (more) or NOT_FOUND; the id of the one match."""
    counted = reference.groupBy(*key).agg(F.count("*").alias("matches"), F.min(reference_id).alias("match"))
    out = rows.select(id, *key).join(counted, key, "left").withColumn("matches", F.coalesce("matches", F.lit(0)).cast("long"))
    kind = F.when(F.col("matches") == 1, "MATCHED_EXACT").when(F.col("matches") > 1, "AMBIGUOUS").otherwise("NOT_FOUND")
    return out.select(id, "matches", kind.alias("class"), F.when(F.col("matches") == 1, F.col("match")).alias("match"))


def agreed_values(reference: DataFrame, key: list[str], targets: list[str]) -> DataFrame:
    """key and targets of the keys whose rows all agree in all targets (a null is a value of its own)."""
    grouped = reference.groupBy(*key).agg(F.count_distinct(F.struct(*targets)).alias("_n"), *[F.first(t).alias(t) for t in targets])
    return grouped.where("_n = 1").drop("_n")


def identity(rows: DataFrame, known: DataFrame, alias: list[str], compatible: Column, context: list[str], id: str, known_id: str) -> DataFrame:
    """Match each row with known entities: STRONG (one compatible entity of the same alias), CONTEXTUAL (one that shares the context too), AMBIGUOUS or NEW.

    Both sides carry `alias` and the array columns `context`; `compatible` may refer to the columns of rows ("r") and known ("k"). Sources are matched one after the other by
    the caller; within a source all rows are matched at once. Rows and entities that agree in all columns but their ids meet once, so give only columns that are compared;
    an entity is the only one if the least and the greatest are the same.
    """
    of, known_of = [c for c in rows.columns if c != id], [c for c in known.columns if c != known_id]
    r = rows.select(of).distinct().alias("r")
    k = known.groupBy(*known_of).agg(F.min(known_id).alias("_least"), F.max(known_id).alias("_most")).alias("k")
    same = F.lit(True)
    for a in alias:
        same = same & (F.col(f"r.{a}") == F.col(f"k.{a}"))
    shares = F.lit(True)
    for c in context:
        shares = shares & F.arrays_overlap(F.col(f"r.{c}"), F.col(f"k.{c}"))
    joined = r.join(k, same & F.coalesce(compatible, F.lit(True)), "left")
    joined = joined.select(*[F.col(f"r.{c}").alias(f"_c{i}") for i, c in enumerate(of)], F.col("_least").alias("one"), F.col("_most").alias("most"), F.coalesce(shares, F.lit(False)).alias("near"))
    joined = joined.select("*", F.when(F.col("near"), F.col("one")).alias("near_one"), F.when(F.col("near"), F.col("most")).alias("near_most"))
    ends = [F.min("one").alias("one"), F.max("most").alias("most"), F.min("near_one").alias("near_one"), F.max("near_most").alias("near_most")]
    found = joined.groupBy(*[f"_c{i}" for i in range(len(of))]).agg(*ends)
    equal = F.lit(True)
    for i, c in enumerate(of):
        equal = equal & F.col(f"_c{i}").eqNullSafe(rows[c])
    grouped = rows.join(found, equal).groupBy(rows[id].alias("id")).agg(*ends)
    only, near_only = F.col("one") == F.col("most"), F.col("near_one") == F.col("near_most")
    kind = F.when(only, "STRONG").when(near_only, "CONTEXTUAL").when(F.col("one").isNotNull(), "AMBIGUOUS").otherwise("NEW")
    return grouped.select(F.col("id").alias(id), kind.alias("class"), F.when(only, F.col("one")).when(near_only, F.col("near_one")).alias("entity"))


def inferred_from_companions(rows: DataFrame, context: list[str], value: str) -> DataFrame:
    """rows with `value` filled where it is null and the known values of the same context are one."""
    agreed = agreed_values(rows.where(F.col(value).isNotNull()), context, [value]).withColumnRenamed(value, "_agreed")
    return rows.join(agreed, context, "left").withColumn(value, F.coalesce(value, "_agreed")).select(rows.columns)


def mapped(rows: DataFrame, column: str, mapping: DataFrame, default: str | None = None) -> DataFrame:
    """rows with `column` replaced through a table (name, canonical) of aliases; a value not in it stays, or becomes the default."""
    m = mapping.select(F.col("name").alias("_name"), F.col("canonical").alias("_canonical")).dropDuplicates(["_name"])
    other = F.col(column) if default is None else F.lit(default)
    return rows.join(m, rows[column] == m["_name"], "left").withColumn(column, F.coalesce("_canonical", other)).select(rows.columns)


def homonyms(rows: DataFrame, name: Column, id: str) -> DataFrame:
    """name and n of normal names that several ids bear."""
    return rows.groupBy(name.alias("name")).agg(F.count_distinct(id).alias("n")).where("n > 1")


def edition_policy(rows: DataFrame, rules: DataFrame, year: str, season: str, field: str) -> DataFrame:
    """rows with seasons replaced by rules (year, season, field or null for any, new_season or null to drop the row).

    Of several rules that fit a row, one that names the row's field goes before one for any field, then that of the least new season; a row stays one row.
    """
    rule = F.struct(F.col("field").isNull().alias("any"), F.col("new_season").alias("new"), F.col("field").alias("f"))
    r = rules.groupBy(F.col("year").alias("_y"), F.col("season").alias("_s")).agg(F.sort_array(F.collect_list(rule)).alias("_rules"))
    out = rows.join(r, (rows[year] == r["_y"]) & r["_s"].eqNullSafe(rows[season]), "left")
    first = F.get(F.filter("_rules", lambda x: x["any"] | (x["f"] == F.col(field))), F.lit(0))
    out = out.withColumn("_rule", first).where("_rule IS NULL OR _rule.new IS NOT NULL")
    return out.withColumn(season, F.coalesce("_rule.new", season)).select(rows.columns)


def numbered(rows: DataFrame, order: list, name: str = "number") -> DataFrame:
    """rows with dense numbers from 1 in an order: range partitions are sorted by themselves, and each begins where the ones before end.

    Only the sizes of the partitions reach the driver. Rows that tie in the whole order get any of their numbers.
    """
    ordered = shared.cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}))
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("least")).orderBy("_p").collect()  # a row for each partition
    at, starts = 0, []
    for s in sizes:
        starts.append((s["_p"], at - s["least"] + 1))
        at += s["n"]
    offsets = rows.sparkSession.createDataFrame(starts, "_p int, _offset long")
    return ordered.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_m") + F.col("_offset")).select(*rows.columns, name)


def remapped(rows: DataFrame, editions: DataFrame, targets: DataFrame, row_id: str, edition_id: str) -> tuple[DataFrame, DataFrame]:
    """Editions merged into others, numbered anew by (year, season), and rows that follow them.

    `editions` has `edition_id`, year and season; `targets` (year, season, new_year, new_season) names those that go. Of rows whose edition changed and that then
    equal another row of a changed edition in all but `row_id`, the one of the smallest `row_id` stays. The rows that stay are numbered anew in the order of `row_id`. Gives both tables.
    """
    t = targets.select(F.col("year").alias("_y"), F.col("season").alias("_s"), "new_year", "new_season")
    mapped = editions.join(t, (editions["year"] == t["_y"]) & (editions["season"] == t["_s"]), "left")
    mapped = mapped.select(F.col(edition_id).alias("_old"), F.coalesce("new_year", "year").alias("year"), F.coalesce("new_season", "season").alias("season"), F.col("_y").isNotNull().alias("_went"))
    kept = numbered(mapped.select("year", "season").distinct(), ["year", "season"], "_new")
    moved = mapped.join(kept, ["year", "season"])
    changes = moved.select(F.col("_old").alias(edition_id), "_new", F.col("_went").alias("_changed"))
    followed = rows.join(changes, edition_id).withColumn(edition_id, F.col("_new").cast(rows.schema[edition_id].dataType)).drop("_new")
    rest = [c for c in rows.columns if c != row_id]
    # Rows of editions that keep theirs pass by the comparison.
    once = followed.where("_changed").groupBy(*rest).agg(F.min(row_id).alias(row_id)).select(rows.columns)
    out = followed.where("NOT _changed").select(rows.columns).unionByName(once)
    numbers = numbered(out, [row_id], "_row").withColumn(row_id, F.col("_row").cast(rows.schema[row_id].dataType)).select(rows.columns)
    return kept.select(F.col("_new").alias(edition_id), "year", "season"), numbers
