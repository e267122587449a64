"""Joins, aggregates, windows, sets and subqueries, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laurel.operators import counting, match, reshape
from laurel.plans.registry import FACTS, facts, query
from laurel.session import table


@query(
    "topn_per_group",
    """WITH c AS (SELECT p_brand, l_suppkey, CAST(count(*) AS BIGINT) AS outcomes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY outcomes DESC, l_suppkey) AS place FROM c) SELECT * FROM r WHERE place <= 10""",
)
def topn_per_group(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return counting.top_per_group(joined.groupBy("p_brand", "l_suppkey").agg(F.count("*").alias("outcomes")), ["p_brand"], [F.desc("outcomes"), "l_suppkey"], 10)


@query("inner_star_join", FACTS + "SELECT sport, discipline, year, count(*) AS n, count(DISTINCT person) AS people FROM f GROUP BY ALL")
def inner_star_join(spark, d):
    return facts(spark, d).groupBy("sport", "discipline", "year").agg(F.count("*").alias("n"), F.count_distinct("person").alias("people"))


@query("left_join_keep_unmatched", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
def left_join_keep_unmatched(spark, d):
    finished = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return table(spark, d, "customer").select("c_custkey").join(finished, "c_custkey", "left").withColumn("orders", F.coalesce("orders", F.lit(0)).cast("long"))


@query("anti_fk_orphans", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')")
def anti_fk_orphans(spark, d):
    used = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@query("semi_membership", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 0)")
def semi_membership(spark, d):
    wanted = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY' AND c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(wanted, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("nullable_fk_orphans", "SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, nullif(l_suppkey % 120, 0) AS s FROM lineitem) WHERE s IS NOT NULL AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = s AND s_acctbal > 0)")
def nullable_fk_orphans(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.nullif(F.col("l_suppkey") % 120, F.lit(0)).alias("s"))
    good = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("s"))
    return rows.where("s IS NOT NULL").join(good, "s", "left_anti").select("l_orderkey", "l_linenumber")


@query("lateral_latest", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1) ON o_custkey = c_custkey")
def lateral_latest(spark, d):
    order = F.struct("o_orderdate", "o_orderkey")
    latest = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", order).alias("o_orderkey"), F.max_by("o_totalprice", order).alias("o_totalprice"))
    return table(spark, d, "customer").select("c_custkey").join(latest, "c_custkey", "left")


@query(
    "key_join_cardinality_class",
    """SELECT c_custkey, coalesce(n, 0) AS matches, CASE WHEN n = 1 THEN 'MATCHED_EXACT' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'NOT_FOUND' END AS class, CASE WHEN n = 1 THEN m END AS match
 FROM customer LEFT JOIN (SELECT s_nationkey AS k, floor(s_acctbal / 1000)::BIGINT AS b, count(*) AS n, min(s_suppkey) AS m FROM supplier GROUP BY 1, 2) ON k = c_nationkey AND b = floor(c_acctbal / 1000)::BIGINT""",
)
def key_join_cardinality_class(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey", "c_nationkey AS k", "CAST(floor(c_acctbal / 1000) AS BIGINT) AS b")
    reference = table(spark, d, "supplier").selectExpr("s_suppkey", "s_nationkey AS k", "CAST(floor(s_acctbal / 1000) AS BIGINT) AS b")
    return match.key_matches(rows, reference, ["k", "b"], "c_custkey", "s_suppkey")


@query("agreed_enrichment", "SELECT k, b, min(c_mktsegment) AS c_mktsegment FROM (SELECT c_nationkey AS k, floor(c_acctbal / 10)::BIGINT AS b, c_mktsegment FROM customer) GROUP BY 1, 2 HAVING count(DISTINCT c_mktsegment) = 1")
def agreed_enrichment(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_nationkey AS k", "CAST(floor(c_acctbal / 10) AS BIGINT) AS b", "c_mktsegment")
    return match.agreed_values(rows, ["k", "b"], ["c_mktsegment"])


@query(
    "full_outer_manifest",
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'NOT_IN_MANIFEST' WHEN b.k IS NULL THEN 'MISSING' WHEN a.n = b.n THEN 'MATCH' ELSE 'MISMATCH' END AS status
 FROM (SELECT c_nationkey * 1000 + floor(c_acctbal / 100)::BIGINT AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey * 1000 + floor(s_acctbal / 100)::BIGINT AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k""",
)
def full_outer_manifest(spark, d):
    a = table(spark, d, "customer").groupBy(F.expr("c_nationkey * 1000 + CAST(floor(c_acctbal / 100) AS BIGINT)").alias("k")).agg(F.count("*").alias("n"))
    b = table(spark, d, "supplier").groupBy(F.expr("s_nationkey * 1000 + CAST(floor(s_acctbal / 100) AS BIGINT)").alias("k")).agg(F.count("*").alias("m"))
    kind = F.when(F.col("n").isNull(), "NOT_IN_MANIFEST").when(F.col("m").isNull(), "MISSING").when(F.col("n") == F.col("m"), "MATCH").otherwise("MISMATCH")
    return a.join(b, "k", "full").select("k", kind.alias("status"))


@query("self_join_block_pairs", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) < 500")
def self_join_block_pairs(spark, d):
    s = table(spark, d, "supplier")
    a, b = s.select(F.col("s_suppkey").alias("a"), "s_nationkey", F.col("s_acctbal").alias("x")), s.select(F.col("s_suppkey").alias("b"), "s_nationkey", F.col("s_acctbal").alias("y"))
    return a.join(b, "s_nationkey").where("a < b AND abs(x - y) < 500").select("a", "b")


@query("conditional_pivot_counts", FACTS + "SELECT delegation, sum(CASE WHEN medal = 'Gold' THEN 1 ELSE 0 END)::BIGINT AS gold, sum(CASE WHEN medal = 'Silver' THEN 1 ELSE 0 END)::BIGINT AS silver, sum(CASE WHEN medal = 'Bronze' THEN 1 ELSE 0 END)::BIGINT AS bronze FROM f GROUP BY 1")
def conditional_pivot_counts(spark, d):
    return counting.conditional_counts(facts(spark, d), ["delegation"], "medal", {"Gold": "gold", "Silver": "silver", "Bronze": "bronze"})


@query("composite_distinct_outcomes", FACTS + "SELECT sport, count(*) AS outcomes FROM (SELECT DISTINCT sport, year, event, medal FROM f) GROUP BY 1")
def composite_distinct_outcomes(spark, d):
    return facts(spark, d).groupBy("sport").agg(F.count_distinct(F.struct("year", "event", "medal")).alias("outcomes"))


@query("global_counts_union", "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def global_counts_union(spark, d):
    out = None
    for name in ("customer", "orders", "lineitem", "part", "supplier", "nation", "region"):
        part = table(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("having_multi_group", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) BETWEEN 3 AND 10")
def having_multi_group(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n BETWEEN 3 AND 10")


@query("string_agg_ordered", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def string_agg_ordered(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("names"))


@query("mode_value", FACTS + "SELECT delegation, sport, n FROM (SELECT delegation, sport, count(*) AS n, row_number() OVER (PARTITION BY delegation ORDER BY count(*) DESC, sport) AS k FROM f GROUP BY 1, 2) WHERE k = 1")
def mode_value(spark, d):
    return counting.mode(facts(spark, d), ["delegation"], "sport")


@query("dup_excess", "SELECT count(*) AS \"groups\", coalesce(sum(n - 1), 0)::BIGINT AS excess FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1)")
def dup_excess(spark, d):
    return counting.duplicate_excess(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


@query("min_max_avg", "SELECT l_returnflag, min(l_quantity) AS least, max(l_quantity) AS greatest, CAST(avg(CAST(l_quantity AS DECIMAL(5,2))) AS DECIMAL(7,2))::DOUBLE AS mean FROM lineitem GROUP BY 1 HAVING count(*) >= 50")
def min_max_avg(spark, d):
    out = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.min("l_quantity").alias("least"), F.max("l_quantity").alias("greatest"), F.round(F.avg("l_quantity"), 2).alias("mean"), F.count("*").alias("n"))
    return out.where("n >= 50").drop("n")


@query("iqr_outliers", """WITH q AS (SELECT c_nationkey, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3, count(*) AS n FROM customer GROUP BY 1)
 SELECT c_nationkey, round(q1, 4) AS q1, round(q3, 4) AS q3, count(*) FILTER (c_acctbal < q1 - 0.5 * (q3 - q1) OR c_acctbal > q3 + 0.5 * (q3 - q1)) AS outliers FROM customer JOIN q USING (c_nationkey) WHERE n >= 4 AND q3 > q1 GROUP BY 1, 2, 3""")
def iqr_outliers(spark, d):
    return counting.iqr_outliers(table(spark, d, "customer"), ["c_nationkey"], "c_acctbal", 0.5).withColumns({"q1": F.round("q1", 4), "q3": F.round("q3", 4)})


@query("column_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS \"rows\", count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS distinct_values, CAST(min(length(CAST({c} AS VARCHAR))) AS BIGINT) AS least_length, CAST(max(length(CAST({c} AS VARCHAR))) AS BIGINT) AS greatest_length FROM part" for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size")))
def column_profile(spark, d):
    return counting.profile(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))


@query("numeric_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({c})::DOUBLE AS least, max({c})::DOUBLE AS greatest, round(avg({c}), 4) AS mean FROM lineitem" for c in ("l_quantity", "l_discount", "l_linenumber")))
def numeric_profile(spark, d):
    return counting.numeric_profile(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_linenumber"])


@query("value_frequencies", "WITH c AS (SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS common_place, row_number() OVER (ORDER BY n, value) AS rare_place FROM c) SELECT * FROM r WHERE common_place <= 5 OR rare_place <= 5")
def value_frequencies(spark, d):
    return counting.value_frequencies(table(spark, d, "part"), "p_name", 5)


@query("rollup_edition_country", FACTS + "SELECT delegation, year, count(*) AS n, count(DISTINCT person) AS people FROM f WHERE medal IS NOT NULL GROUP BY ROLLUP (delegation, year)")
def rollup_edition_country(spark, d):
    return facts(spark, d).where("medal IS NOT NULL").rollup("delegation", "year").agg(F.count("*").alias("n"), F.count_distinct("person").alias("people"))


@query("sample_one_per_status", "SELECT o_orderstatus, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def sample_one_per_status(spark, d):
    return counting.top_per_group(table(spark, d, "orders").select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], ["o_orderkey"], 1).drop("place")


@query("global_ranking_ties", FACTS + "SELECT delegation, gold, total, row_number() OVER (ORDER BY gold DESC, total DESC, delegation) AS place FROM (SELECT delegation, count(*) FILTER (medal = 'Gold') AS gold, count(medal) AS total FROM f GROUP BY 1)")
def global_ranking_ties(spark, d):
    counted = facts(spark, d).groupBy("delegation").agg(F.count_if(F.col("medal") == "Gold").alias("gold"), F.count("medal").alias("total"))
    return counting.ranked(counted, [F.desc("gold"), F.desc("total"), "delegation"])


@query("dup_rank", "SELECT l_orderkey, l_partkey, l_linenumber, k AS duplicate_rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_quantity) - 1 AS k FROM lineitem) WHERE k > 0")
def dup_rank(spark, d):
    rows = counting.ranked(table(spark, d, "lineitem"), ["l_linenumber", "l_suppkey", "l_quantity"], ["l_orderkey", "l_partkey"])
    return rows.where("place > 1").select("l_orderkey", "l_partkey", "l_linenumber", (F.col("place") - 1).alias("duplicate_rank"))


@query("mark_duplicates", "SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS duplicated FROM documents")
def mark_duplicates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    # Only repeated keys are joined, and on another expression: both sides then have an exchange that a hot text can split.
    repeated = docs.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.reverse("h").alias("k"), F.lit(True).alias("twice"))
    return docs.withColumn("k", F.reverse("h")).join(repeated, "k", "left").select("doc_id", F.coalesce("twice", F.lit(False)).alias("duplicated"))


@query("top1_after_group", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 1")
def top1_after_group(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(1)


@query("top20_people", FACTS + "SELECT person, count(*) FILTER (medal = 'Gold') AS gold, count(medal) AS total FROM f GROUP BY 1 ORDER BY gold DESC, total DESC, person LIMIT 20")
def top20_people(spark, d):
    counted = facts(spark, d).groupBy("person").agg(F.count_if(F.col("medal") == "Gold").alias("gold"), F.count("medal").alias("total"))
    return counted.orderBy(F.desc("gold"), F.desc("total"), "person").limit(20)


@query(
    "sort_by_medal_whole_order",
    FACTS
    + """, g AS (SELECT event, medal, CASE WHEN line < 7 THEN position END AS position, person, edition, line FROM f)
 SELECT *, row_number() OVER (PARTITION BY event ORDER BY CASE medal WHEN 'Gold' THEN 1 WHEN 'Silver' THEN 2 WHEN 'Bronze' THEN 3 ELSE 4 END, position NULLS LAST, person, edition, line) AS place FROM g""",
)
def sort_by_medal_whole_order(spark, d):
    """The place of every row in its event by medal, then position; seventh lines have no position here, so that nulls are sorted too."""
    from pyspark.sql import Window

    from laurel.functions.parse import medal_rank

    rows = facts(spark, d).select("event", "medal", F.when(F.col("line") < 7, F.col("position")).alias("position"), "person", "edition", "line")
    order = Window.partitionBy("event").orderBy(medal_rank(F.col("medal")), F.asc_nulls_last("position"), "person", "edition", "line")
    return rows.withColumn("place", F.row_number().over(order))


@query("seeded_stratified_sample", "SELECT c_mktsegment, c_custkey, place FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat('7:', CAST(c_custkey AS VARCHAR))), c_custkey) AS place FROM customer) WHERE place <= 10")
def seeded_stratified_sample(spark, d):
    return counting.stratified_sample(table(spark, d, "customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment"], "c_custkey", 10, 7)


@query("distinct_pairs", FACTS + "SELECT DISTINCT sport, season FROM f")
def distinct_pairs(spark, d):
    return facts(spark, d).select("sport", "season").distinct()


@query("set_diff_ids", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_diff_ids(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query("set_intersection_ids", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_intersection_ids(spark, d):
    orders = table(spark, d, "orders")
    return orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(orders.where("o_orderstatus = 'P'").select("o_custkey"))


@query("set_union_ids", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def set_union_ids(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).union(table(spark, d, "customer").select("c_nationkey")).distinct()


@query("cte_chain", FACTS + ", g AS (SELECT edition, event FROM f WHERE medal = 'Gold' AND year = 1998), p AS (SELECT DISTINCT person FROM f WHERE medal = 'Gold' AND year = 1998) SELECT (SELECT count(*) FROM p) AS people, (SELECT count(*) FROM (SELECT DISTINCT * FROM g)) AS outcomes")
def cte_chain(spark, d):
    gold = facts(spark, d).where("medal = 'Gold' AND year = 1998")
    return gold.agg(F.count_distinct("person").alias("people"), F.count_distinct(F.struct("edition", "event")).alias("outcomes"))


@query("scalar_subqueries", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1.8 * (SELECT avg(o_totalprice) FROM orders)")
def scalar_subqueries(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("_orders_scalar")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM _orders_scalar WHERE o_totalprice > 1.8 * (SELECT avg(o_totalprice) FROM _orders_scalar)")


@query("correlated_count", "SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS lines, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') AS returned FROM supplier")
def correlated_count(spark, d):
    counted = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    return table(spark, d, "supplier").select("s_suppkey").join(counted, "s_suppkey", "left").na.fill(0)


@query("between_years", FACTS + "SELECT year, season, count(*) AS n FROM f WHERE year >= 1996 AND year <= 1999 AND season IN ('1-URGENT', '2-HIGH') GROUP BY ALL")
def between_years(spark, d):
    return facts(spark, d).where(F.col("year").between(1996, 1999) & F.col("season").isin("1-URGENT", "2-HIGH")).groupBy("year", "season").agg(F.count("*").alias("n"))


@query("first_last_rows", "SELECT 'first' AS which, o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5) UNION ALL SELECT 'last', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5)")
def first_last_rows(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    first = orders.orderBy("o_orderdate", "o_orderkey").limit(5).select(F.lit("first").alias("which"), "o_orderkey")
    return first.union(orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(5).select(F.lit("last"), "o_orderkey"))


@query("span_and_editions", FACTS + "SELECT person, CAST(min(year) AS INTEGER) AS first_year, CAST(max(year) AS INTEGER) AS last_year, count(DISTINCT year) AS editions, count(DISTINCT sport) AS sports FROM f GROUP BY 1")
def span_and_editions(spark, d):
    return facts(spark, d).groupBy("person").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_distinct("year").alias("editions"), F.count_distinct("sport").alias("sports"))


@query("melt_wide_long", "SELECT o_custkey, year, n FROM (SELECT o_custkey, sum(CASE WHEN year(o_orderdate) = 1996 THEN 1 END)::BIGINT AS y1996, sum(CASE WHEN year(o_orderdate) = 1997 THEN 1 END)::BIGINT AS y1997 FROM orders GROUP BY 1) UNPIVOT INCLUDE NULLS (n FOR year IN (y1996, y1997))")
def melt_wide_long(spark, d):
    y = F.year("o_orderdate")
    wide = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.when(y == 1996, 1)).alias("y1996"), F.sum(F.when(y == 1997, 1)).alias("y1997"))
    return reshape.melted(wide, ["o_custkey"], ["y1996", "y1997"], "year", "n")


@query("dimension_ids", "SELECT p_brand, p_type, row_number() OVER (ORDER BY p_brand, p_type) AS id FROM (SELECT DISTINCT p_brand, p_type FROM part)")
def dimension_ids(spark, d):
    return reshape.dimension(table(spark, d, "part"), ["p_brand", "p_type"], "id")


@query("nest_facts", "SELECT o_custkey, CAST(count(*) AS INTEGER) AS n, max(o_totalprice) AS most, CAST(count(*) FILTER (o_orderstatus = 'F') AS INTEGER) AS finished FROM orders GROUP BY 1")
def nest_facts(spark, d):
    nested = reshape.nested(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey", "o_totalprice", "o_orderstatus"], ["o_orderkey"], "orders")
    return nested.select("o_custkey", F.size("orders").alias("n"), F.array_max(F.transform("orders", lambda o: o["o_totalprice"])).alias("most"), F.size(F.filter("orders", lambda o: o["o_orderstatus"] == "F")).alias("finished"))


@query("unnest_exists_filter", "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000")
def unnest_exists_filter(spark, d):
    nested = reshape.nested(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey", "o_totalprice", "o_orderstatus"], ["o_orderkey"], "orders")
    found = reshape.with_matches(nested, "orders", lambda o: (o["o_orderstatus"] == "P") & (o["o_totalprice"] > 300000))
    return reshape.unnested(found, "matches", ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("tagged_union_catalog", "SELECT 'region' AS kind, r_regionkey AS id, r_name AS name, NULL::INTEGER AS parent FROM region UNION ALL SELECT 'nation', n_nationkey, n_name, n_regionkey FROM nation")
def tagged_union_catalog(spark, d):
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"))
    return reshape.tagged({"region": regions, "nation": nations})


@query("json_props_agg", "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1")
def json_props_agg(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query("running_totals", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seen FROM events")
def running_totals(spark, d):
    return table(spark, d, "events").select("event_id", F.count("*").over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)).alias("seen"))
