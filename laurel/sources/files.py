"""Files in and out: text CSV, encodings, manifests of hashes, slices and reports."""

from __future__ import annotations

import codecs

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD_BYTES = 2 << 20


def encoding_of(head: bytes) -> str:
    """UTF-8 with a mark, UTF-8, Windows-1252 or Latin-1, by the first that decodes the head of a file."""
    if head.startswith(codecs.BOM_UTF8):
        return "utf-8-sig"
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head)
        return "utf-8"
    except UnicodeDecodeError:
        pass
    try:
        head.decode("cp1252")
        return "cp1252"
    except UnicodeDecodeError:
        return "latin-1"


def detect_encoding(spark: SparkSession, path: str) -> str:
    """The encoding of a file of any store that Spark can read; only its head is read."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        head = bytes(stream.readNBytes(HEAD_BYTES))
    finally:
        stream.close()
    return encoding_of(head)


#: What Spark reads; Windows-1252 is read as Latin-1, whose control characters then become its letters and marks.
_CHARSETS = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp1252": "ISO-8859-1", "latin-1": "ISO-8859-1"}
_WINDOWS = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")}


def header_of(spark: SparkSession, path: str, encoding: str = "utf-8", line_breaks: bool = False) -> list[str]:
    """The column names of a CSV file; ValueError if one occurs twice or is empty."""
    first = spark.read.option("header", False).option("multiLine", line_breaks).option("escape", '"').option("encoding", _CHARSETS.get(encoding, encoding)).csv(path).first()
    names = [(x or "").lstrip("﻿").strip() for x in (first or [])]
    if not names or "" in names or len(set(names)) != len(names):
        raise ValueError(f"{path}: the header has empty or repeated names: {names}")
    return names


def read_text_csv(spark: SparkSession, path: str, encoding: str | None = None, strict: bool = True, line_breaks: bool = False) -> DataFrame:
    """A CSV file with all columns as text and empty fields as empty text; with `strict`, ragged rows fail.

    `line_breaks` allows for line breaks within quotes; one task then reads a whole file. Without, files are split.
    """
    encoding = encoding or detect_encoding(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in header_of(spark, path, encoding, line_breaks)])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", line_breaks).option("escape", '"').option("emptyValue", "")
    out = reader.option("encoding", _CHARSETS.get(encoding, encoding)).option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(path).na.fill("")
    if encoding == "cp1252":
        out = out.select(*[F.translate(F.col(c), "".join(_WINDOWS), "".join(_WINDOWS.values())).alias(c) for c in out.columns])
    return out


def read_csv_pair(spark: SparkSession, path: str, line_breaks: bool = False) -> tuple[DataFrame, DataFrame]:
    """A CSV file twice: with inferred types, and as text."""
    inferred = spark.read.option("header", True).option("inferSchema", True).option("multiLine", line_breaks).option("escape", '"').csv(path)
    return inferred, read_text_csv(spark, path, strict=False, line_breaks=line_breaks)


def write_csv(df: DataFrame, path: str, line_end: str = "\n", mark: bool = False) -> None:
    """CSV files with a header each; with `mark`, each begins with a byte order mark. Refuses a target that exists."""
    if mark:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.option("header", True).option("escape", '"').option("lineSep", line_end).option("encoding", "UTF-8").mode("errorifexists").csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, rows_per_file: int = 5_000_000) -> None:
    """A Parquet table with bounded files; refuses a target that exists."""
    writer = df.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def json_report(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON document."""
    return df.select(F.to_json(F.struct("*")).alias(name))


def hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """file, bytes and sha256 of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select(F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def compared(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """file and status: MATCH, MISMATCH, NOT_IN_MANIFEST or MISSING."""
    both = current.select("file", F.col("sha256").alias("now")).join(manifest.select("file", F.col("sha256").alias("then")), "file", "full")
    kind = F.when(F.col("then").isNull(), "NOT_IN_MANIFEST").when(F.col("now").isNull(), "MISSING").when(F.col("now") == F.col("then"), "MATCH").otherwise("MISMATCH")
    return both.select("file", kind.alias("status"))


def slices(rows: DataFrame, rounds: dict[str, str], entity: str, entities: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    """name -> (rows under the round's SQL condition, entities that no earlier round has brought)."""
    out: dict[str, tuple[DataFrame, DataFrame]] = {}
    seen: DataFrame | None = None
    for name, condition in rounds.items():
        part = rows.where(condition)
        ids = part.select(entity).distinct()
        fresh = ids if seen is None else ids.join(seen, entity, "left_anti")
        out[name] = (part, entities.join(fresh, entity, "left_semi"))
        seen = ids if seen is None else seen.union(fresh)
    return out


def file_report(spark: SparkSession, folder: str, small: int = 32 << 20) -> DataFrame:
    """files, bytes, small files and advice for a table's folder: compact if most files are small."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder).select("length")
    out = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count_if(F.col("length") < small).alias("small"))
    share = F.col("small") / F.greatest("files", F.lit(1))
    return out.withColumn("advice", F.when((F.col("files") < 8) | (share < 0.1), "NONE").when(share <= 0.3, "REORGANIZE").otherwise("COMPACT"))
