"""Session defaults. Every operator also works with a session made elsewhere."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "laurel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; `conf` keys use double underscores for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": os.environ.get("LAUREL_SHUFFLE_PARTITIONS", "8"),
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder; works with any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
