"""Snapshots of tables: full, differential, restored, kept by number, and switched atomically."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class SnapshotStore:
    """Snapshots of one table below a folder of any store that Spark can write. The newest name is in the file CURRENT."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str]):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    def full(self, df: DataFrame, name: str) -> None:
        df.write.mode("errorifexists").parquet(f"{self.folder}/{name}/rows")
        self._note(name, "FULL", None)

    def differential(self, df: DataFrame, name: str, base: str) -> None:
        """What differs from the full snapshot `base`: new and changed rows, and the keys of those that went."""
        then = self.read(base)
        changed = df.exceptAll(then.select(df.columns))
        gone = then.select(self.key).join(df.select(self.key), self.key, "left_anti")
        changed.write.mode("errorifexists").parquet(f"{self.folder}/{name}/rows")
        gone.write.mode("errorifexists").parquet(f"{self.folder}/{name}/gone")
        self._note(name, "DIFFERENTIAL", base)

    def read(self, name: str) -> DataFrame:
        """The table as of a snapshot; a differential one is put over its base."""
        note = self._read_json(f"{self.folder}/{name}/note.json")
        rows = self.spark.read.parquet(f"{self.folder}/{name}/rows")
        if note["kind"] == "FULL":
            return rows
        gone = self.spark.read.parquet(f"{self.folder}/{name}/gone")
        base = self.read(note["base"])
        kept = base.join(gone, self.key, "left_anti").join(rows.select(self.key), self.key, "left_anti")
        return kept.select(rows.columns).unionByName(rows)

    def verified(self, name: str, df: DataFrame) -> bool:
        """Whether a snapshot holds exactly the rows of `df`."""
        held = self.read(name).select(df.columns)
        return held.exceptAll(df).isEmpty() and df.exceptAll(held).isEmpty()

    def switch(self, name: str) -> str | None:
        """Make a snapshot the current one by a rename; gives the one before, for rolling back."""
        before = self.current()
        self._write_json(f"{self.folder}/CURRENT", {"name": name})
        return before

    def current(self) -> str | None:
        path = f"{self.folder}/CURRENT"
        return self._read_json(path)["name"] if self._exists(path) else None

    def inventory(self) -> DataFrame:
        """name, kind, base and time of all snapshots."""
        notes = self.spark.read.schema("name string, kind string, base string, time double").json(f"{self.folder}/*/note.json")
        return notes.orderBy("time", "name")

    def beyond(self, kept: int) -> DataFrame:
        """Snapshots older than the newest `kept`, but for those that a kept one is based on."""
        found = self.inventory()
        numbered = found.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("time"), F.desc("name"))))  # a row for each snapshot
        needed = numbered.where(F.col("place") <= kept).select(F.col("base").alias("name")).where("name IS NOT NULL")
        return numbered.where(F.col("place") > kept).drop("place").join(needed, "name", "left_anti")

    def _note(self, name: str, kind: str, base: str | None) -> None:
        self._write_json(f"{self.folder}/{name}/note.json", {"name": name, "kind": kind, "base": base, "time": time.time()})

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        where, fs = self._fs(path)
        return fs.exists(where)

    def _read_json(self, path: str) -> dict:
        where, fs = self._fs(path)
        stream = fs.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _write_json(self, path: str, value: dict) -> None:
        where, fs = self._fs(path)
        new, _ = self._fs(path + ".new")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        kind = getattr(jvm, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        # One rename that overwrites: a reader sees the old file or the new one, never none.
        jvm.FileContext.getFileContext(where.toUri(), self.spark._jsc.hadoopConfiguration()).rename(new, where, options)


def difference(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """key and change (ADDED, REMOVED, CHANGED) between two versions of a table with unique keys; equal rows are left out."""
    rest = [c for c in before.columns if c not in key]
    digest = F.xxhash64(F.struct(*rest)) if rest else F.lit(0)
    a, b = before.select(*key, digest.alias("_a")), after.select(*key, digest.alias("_b"))
    kind = F.when(F.col("_a").isNull(), "ADDED").when(F.col("_b").isNull(), "REMOVED").when(F.col("_a") != F.col("_b"), "CHANGED")
    return a.join(b, key, "full").select(*key, kind.alias("change")).where("change IS NOT NULL")
