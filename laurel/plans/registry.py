"""Where queries register: a function (spark, sf_dir) -> DataFrame and, where SQL can express it, its check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.functions import parse
from laurel.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star of results bound to the test tables: lines are participations, parts events, orders editions, suppliers delegations, customers people."""
    lines, orders, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    medal = F.when(F.col("l_returnflag") == "A", "Gold").when(F.col("l_returnflag") == "R", "Silver").when(F.col("l_linestatus") == "F", "Bronze")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(parts, lines["l_partkey"] == parts["p_partkey"])
    return joined.select(
        F.col("l_orderkey").alias("edition"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderpriority").alias("season"),
        F.col("l_partkey").alias("event"),
        F.col("p_name").alias("event_name"),
        F.col("p_type").alias("discipline"),
        F.col("p_brand").alias("sport"),
        F.col("l_suppkey").alias("delegation"),
        F.col("o_custkey").alias("person"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").cast("int").alias("position"),
        (F.col("p_size") % 2 == 0).alias("canonical"),
        medal.alias("medal"),
    )


#: The same star in SQL; queries begin with it.
FACTS = """WITH f AS (SELECT l_orderkey AS edition, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS season, l_partkey AS event, p_name AS event_name, p_type AS discipline,
 p_brand AS sport, l_suppkey AS delegation, o_custkey AS person, l_linenumber AS line, CAST(l_quantity AS INTEGER) AS position, p_size % 2 = 0 AS canonical,
 CASE WHEN l_returnflag = 'A' THEN 'Gold' WHEN l_returnflag = 'R' THEN 'Silver' WHEN l_linestatus = 'F' THEN 'Bronze' END AS medal
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) """

MEDALS = parse.MEDALS
