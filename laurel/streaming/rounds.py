"""Incremental rounds and windowed counts on streams. The windowed counts are an extension of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def round_counts(rows: DataFrame, round_: str, entity: str) -> DataFrame:
    """Per round: rows, and entities that no earlier round had; idempotent, since it looks at the first round of an entity only."""
    first = rows.groupBy(entity).agg(F.min(round_).alias(round_)).groupBy(round_).agg(F.count("*").alias("new_entities"))
    return rows.groupBy(round_).agg(F.count("*").alias("rows")).join(first, round_, "left").na.fill(0, ["new_entities"])


def appended(target: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """The rows of a batch that the target lacks: loading a batch twice adds nothing."""
    return batch.dropDuplicates(key).join(target.select(key), key, "left_anti")


def tumbling(events: DataFrame, time: str, size: str, by: list[str], late: str | None = None) -> DataFrame:
    """Counts of tumbling windows; on a stream, `late` is the watermark."""
    if late:
        events = events.withWatermark(time, late)
    out = events.groupBy(F.window(time, size), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), *by, "n")


def sliding(events: DataFrame, time: str, size: str, slide: str, by: list[str], late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark(time, late)
    out = events.groupBy(F.window(time, size, slide), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), *by, "n")


def sessions(events: DataFrame, time: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    """Sessions of events no further apart than the gap: start, n."""
    if late:
        events = events.withWatermark(time, late)
    out = events.groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), *by, "n")


def once_each(events: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def upserting(stream: DataFrame, path: str, key: list[str], checkpoint: str) -> DataStreamWriter:
    """A writer that appends only rows whose key the Parquet table at `path` lacks."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        known = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
        if not known:
            df.dropDuplicates(key).write.mode("append").parquet(path)
            return
        # Only row groups whose statistics meet the batch's span of the first key are read; sorted targets have few.
        low, high = df.agg(F.min(key[0]), F.max(key[0])).first()
        target = spark.read.parquet(path)
        near = target if low is None else target.where(F.col(key[0]).between(low, high) | F.col(key[0]).isNull())
        appended(near, df, key).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
