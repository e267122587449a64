"""Lookups, signatures and orders as queries: the test tables bound to the model of ten tables, with SQL for each result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.functions import text
from laurel.operators import counting, match
from laurel.plans import country, person
from laurel.plans.registry import query
from laurel.session import table

SEASON = "CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN 'Summer' WHEN left(o_orderpriority, 1) = '3' THEN 'Winter' ELSE 'Summer Youth' END"
MEDAL = "CASE WHEN l_returnflag = 'A' THEN 'Gold' WHEN l_returnflag = 'R' THEN 'Silver' WHEN l_linestatus = 'F' THEN 'Bronze' END"


def bound(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Nations are countries with a delegation each, but for every seventh, whose delegation stands alone; customers persons, brands sports, types disciplines, parts events."""
    nation, part, customer = table(spark, d, "nation"), table(spark, d, "part"), table(spark, d, "customer")
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    editions = orders.selectExpr("year(o_orderdate) AS anio", f"{SEASON} AS temporada").distinct()
    edition_id = "anio * 10 + CASE temporada WHEN 'Summer' THEN 1 WHEN 'Winter' THEN 2 ELSE 3 END"
    brand, kind = "CAST(substr(p_brand, 7) AS INT)", "p_type"
    field = f"CAST(pmod(crc32({kind}), 1000000) AS INT) * 100 + {brand}"
    held = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return {
        "entidad_geografica": nation.selectExpr("n_nationkey AS id_entidad", "n_name AS nombre", "concat('C', n_nationkey) AS codigo_pais"),
        "noc": nation.selectExpr("n_nationkey + 100 AS id_noc", "concat('N', n_nationkey) AS codigo_noc", "concat('Team ', n_name) AS nombre_noc", "CASE WHEN n_nationkey % 7 <> 6 THEN n_nationkey END AS id_entidad"),
        "sede": nation.selectExpr("explode(array(n_nationkey, n_nationkey + 1000)) AS id_sede", "n_name", "n_nationkey AS id_pais").selectExpr("id_sede", "concat(CASE WHEN id_sede < 1000 THEN 'Old ' ELSE 'New ' END, n_name) AS nombre", "id_pais"),
        "edicion_olimpica": editions.selectExpr(f"{edition_id} AS id_edicion", "anio", "temporada", "CASE WHEN temporada <> 'Winter' THEN anio % 25 END AS id_sede"),
        "deporte": part.selectExpr(f"{brand} AS id_deporte", "p_brand AS nombre").distinct(),
        "disciplina": part.selectExpr(f"{field} AS id_disciplina", f"{brand} AS id_deporte", "p_type AS nombre").distinct(),
        "evento": part.selectExpr("p_partkey AS id_evento", f"{field} AS id_disciplina", "concat(p_name, CASE WHEN p_size % 2 = 0 THEN ' (Olympic)' ELSE '' END) AS nombre"),
        "poblacion": nation.selectExpr("n_nationkey AS id_entidad", "explode(array(2000, 2010)) AS anio").selectExpr("id_entidad", "anio", "id_entidad * 1000 + anio AS poblacion"),
        "atleta": customer.selectExpr(
            "c_custkey AS id_atleta", "c_name AS nombre", "c_name AS nombre_completo", "CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'Female' END AS sexo", "DATE'1960-01-01' AS fecha_nacimiento", "CAST(NULL AS STRING) AS ciudad_nacimiento", "CAST(NULL AS STRING) AS region_nacimiento",
            "c_nationkey AS id_pais_nacimiento", "CASE WHEN c_custkey % 3 = 0 THEN DATE'1996-06-30' END AS fecha_fallecimiento", "CAST(NULL AS INT) AS id_pais_fallecimiento", "CAST(NULL AS DOUBLE) AS altura_cm", "CAST(NULL AS DOUBLE) AS peso_kg",
        ),
        "participacion": held.selectExpr("l_orderkey * 10 + l_linenumber AS id_participacion", "o_custkey AS id_atleta", f"year(o_orderdate) * 10 + CASE {SEASON} WHEN 'Summer' THEN 1 WHEN 'Winter' THEN 2 ELSE 3 END AS id_edicion", "l_partkey AS id_evento", "l_suppkey % 25 + 100 AS id_noc",
            "CAST(l_quantity AS INT) AS posicion", "l_linenumber = 2 AS empatado", f"{MEDAL} AS medalla", "CASE WHEN l_linenumber = 7 THEN 'DNF' END AS estado_resultado", "CAST(NULL AS STRING) AS equipo", "CAST(NULL AS INT) AS edad", "CAST(NULL AS STRING) AS nombre_competencia"),
    }


#: The star of `bound` in SQL; queries begin with it.
STAR = f"""WITH g AS (SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey AS person, CAST(year(o_orderdate) AS INTEGER) AS anio, {SEASON} AS temporada, l_partkey AS event,
 p_name || CASE WHEN p_size % 2 = 0 THEN ' (Olympic)' ELSE '' END AS evento, p_size % 2 = 0 AS canonical, p_type AS disciplina, p_brand AS deporte, l_suppkey % 25 AS nat, CAST(l_quantity AS INTEGER) AS posicion,
 l_linenumber = 2 AS empatado, {MEDAL} AS medalla, CASE WHEN l_linenumber = 7 THEN 'DNF' END AS estado
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) """
_NAME = "Customer#00000001"


def history(spark, d):
    return person.history(bound(spark, d), _NAME, first_year=1993, last_year=1997, most=500)


_MINE = f", h AS (SELECT g.*, c_name, c_custkey FROM g JOIN customer ON c_custkey = person WHERE contains(c_name, '{_NAME}') AND anio BETWEEN 1993 AND 1997)"


@query(
    "person_history_detail",
    STAR + _MINE + """ SELECT c_custkey AS id_atleta, c_name AS atleta, anio, temporada, deporte, disciplina, evento, 'N' || nat AS codigo_noc, posicion, medalla,
 CASE WHEN medalla IS NOT NULL THEN medalla WHEN estado IS NOT NULL THEN estado WHEN empatado THEN '=' || posicion || ' lugar' ELSE posicion || ' lugar' END AS resultado,
 CASE WHEN c_custkey % 3 = 0 AND anio > 1996 THEN 1 ELSE 0 END AS posterior_a_fallecimiento FROM h""",
)
def person_history_detail(spark, d):
    """D1: every result of the persons of a name within a span of years."""
    return history(spark, d).tables["detail"].select("id_atleta", "atleta", "anio", "temporada", "deporte", "disciplina", "evento", "codigo_noc", "posicion", "medalla", "resultado", "posterior_a_fallecimiento")


_REAL = ", r AS (SELECT c_custkey, anio, temporada, disciplina, deporte, medalla, count(*) FILTER (canonical) AS c, count(*) FILTER (NOT canonical) AS d FROM h WHERE medalla IS NOT NULL GROUP BY ALL)"


@query(
    "person_history_medals",
    STAR + _MINE + _REAL + """, m AS (SELECT c_custkey, sum(CASE WHEN c > 0 THEN c ELSE d END) FILTER (medalla = 'Gold') AS oro, sum(CASE WHEN c > 0 THEN c ELSE d END) FILTER (medalla = 'Silver') AS plata,
 sum(CASE WHEN c > 0 THEN c ELSE d END) FILTER (medalla = 'Bronze') AS bronce, sum(c + d) AS filas_origen FROM r GROUP BY 1)
SELECT p.c_custkey AS id_atleta, coalesce(oro, 0)::BIGINT AS oro, coalesce(plata, 0)::BIGINT AS plata, coalesce(bronce, 0)::BIGINT AS bronce, coalesce(filas_origen, 0)::BIGINT AS filas_origen,
 coalesce(dnf, 0)::BIGINT AS dnf FROM (SELECT c_custkey, count(*) FILTER (estado = 'DNF') AS dnf FROM h GROUP BY 1) p LEFT JOIN m USING (c_custkey)""",
)
def person_history_medals(spark, d):
    """D1: real medals of the persons of a name."""
    return history(spark, d).tables["medals"].select("id_atleta", "oro", "plata", "bronce", "filas_origen", "dnf")


def _totals(dialect: str) -> str:
    key = "anio, temporada, event, medalla" + (", nat" if dialect == "relational" else "")
    of = "".join(f", count(DISTINCT CASE WHEN medalla = '{m}' THEN ({key}) END) AS {n}" for m, n in (("Gold", "medallas_oro_oficiales"), ("Silver", "medallas_plata_oficiales"), ("Bronze", "medallas_bronce_oficiales")))
    return STAR + f"SELECT count(DISTINCT id) AS total_participaciones, count(DISTINCT person) AS total_atletas_distintos{of}, count(DISTINCT CASE WHEN medalla IS NOT NULL THEN ({key}) END) AS total_medallas_oficiales_pais, count(medalla) AS preseas_totales_entregadas_a_atletas FROM g WHERE nat = 3 AND anio = 1995"


@query("country_totals", _totals("relational"))
def country_totals(spark, d):
    """D2: totals of a country's delegations in a year, medals counted officially."""
    return country.results(bound(spark, d), "N3", year=1995).tables["totals"]


@query("country_totals_document", _totals("document"))
def country_totals_document(spark, d):
    """D9: the same in the document dialect, where the delegation is no part of an outcome."""
    return country.results(bound(spark, d), "C3", year=1995, dialect="document").tables["totals"]


@query(
    "country_hosting",
    STAR + """, e AS (SELECT DISTINCT anio, temporada FROM (SELECT year(o_orderdate)::INTEGER AS anio, """ + SEASON + """ AS temporada FROM orders) WHERE temporada <> 'Winter' AND anio % 25 = 20), n AS (SELECT n_name FROM nation WHERE n_nationkey = 20)
SELECT CASE WHEN count(*) > 0 THEN 'SÍ' ELSE 'NO' END AS ha_sido_sede, count(*) AS total_ediciones_como_sede, (SELECT 'New ' || n_name || ', Old ' || n_name FROM n) AS ciudades_sede,
 coalesce(string_agg((SELECT 'Old ' || n_name FROM n) || ' (' || anio || ' ' || temporada || ')', ', ' ORDER BY (SELECT 'Old ' || n_name FROM n) || ' (' || anio || ' ' || temporada || ')'), '') AS resumen_ediciones_como_sede FROM e""",
)
def country_hosting(spark, d):
    """D2: whether and how often a country held games, and all its cities."""
    # Found by its country code: the twentieth nation's delegation stands alone.
    return country.results(bound(spark, d), "C20").tables["hosting"]


@query(
    "country_detail",
    STAR + """SELECT anio, temporada, evento, c_name AS atleta, codigo_noc, medalla, estado_resultado FROM (SELECT g.*, c_name, 'N' || nat AS codigo_noc, coalesce(estado, 'Finished') AS estado_resultado FROM g JOIN customer ON c_custkey = person
 WHERE nat = 4 AND temporada <> 'Winter' ORDER BY CASE medalla WHEN 'Gold' THEN 1 WHEN 'Silver' THEN 2 WHEN 'Bronze' THEN 3 ELSE 4 END, anio DESC, deporte, evento, c_name, id LIMIT 50)""",
)
def country_detail(spark, d):
    """D2: the first fifty results of a country by medal, newest first (a report of the first rows by its own definition)."""
    return country.results(bound(spark, d), "NATION_4").tables["detail"].select("anio", "temporada", "evento", "atleta", "codigo_noc", "medalla", "estado_resultado")


@query(
    "person_document",
    STAR + "SELECT c_custkey AS id_atleta, c_name AS nombre, count(medalla) AS medallas, count(person) AS participaciones FROM customer LEFT JOIN g ON person = c_custkey WHERE c_name = 'Customer#000000007' GROUP BY ALL",
)
def person_document(spark, d):
    """D8: a person with the results nested."""
    found = person.document_search(bound(spark, d), "customer#000000007").tables["people"]
    return found.select("id_atleta", "nombre", F.coalesce("medallas", F.lit(0).cast("long")).alias("medallas"), F.greatest(F.size(F.coalesce("participaciones", F.array())), F.lit(0)).cast("long").alias("participaciones"))


# Names of events, orders and multisets.

_EVENT = "p_name || CASE p_size % 5 WHEN 0 THEN ', Men (Olympic)' WHEN 1 THEN ' 4 x 100 m Mixed' WHEN 2 THEN ' Race Walk Women''s' WHEN 3 THEN ' Three Day Event Open' ELSE ' Coxless Freestyle' END"


def _words_sql(fine: bool) -> str:
    """The alignment of the query's names in SQL, whose words are known: sport and discipline words leave, others are spelled in one way."""
    gone = list(text.SPORT_WORDS if fine else text.ROWING_WORDS)
    own = f"' ' || {text.normal_sql(_EVENT)} || ' '"
    if fine:
        for old, new in text.SYNONYMS.items():
            own = f"replace({own}, ' {old} ', ' {new} ')"
    parents = sorted(gone, key=len, reverse=True)
    for w in parents:
        own = f"replace({own}, ' {w} ', '  ')"
    own = f"replace({own}, ' ' || {text.normal_sql('p_type')} || ' ', '  ')"
    own = f"replace({own}, ' 4 x 100 ', ' 4x100 ')"
    own = f"regexp_replace({own}, ' (men|women) s ', ' \\1 ', 'g')"
    for old, new in text.ONE_SPELLING.items():
        own = f"replace({own}, ' {old} ', ' {new} ')"
    return f"SELECT array_to_string(list_sort(list_distinct(list_filter(string_split({own}, ' '), lambda w: w <> ''))), ' ') AS signature, count(*) AS events FROM part GROUP BY 1"


def _aligned(spark, d, fine: bool) -> DataFrame:
    name = F.expr(_EVENT)
    return table(spark, d, "part").groupBy(text.event_alignment(name, F.lit(None).cast("string"), F.col("p_type"), fine).alias("signature")).agg(F.count("*").alias("events"))


@query("event_alignment", _words_sql(False))
def event_alignment(spark, d):
    """Names of events without the words of sport, discipline and rowing."""
    return _aligned(spark, d, False)


@query("event_alignment_fine", _words_sql(True))
def event_alignment_fine(spark, d):
    """The same with historical names replaced and all words of sports left out."""
    return _aligned(spark, d, True)


_IDS = "CASE WHEN c_custkey % 10 = 0 THEN 'x' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END"


@query("numeric_first_order", f"SELECT id, row_number() OVER (ORDER BY TRY_CAST(id AS BIGINT) IS NULL, TRY_CAST(id AS BIGINT), id) AS number FROM (SELECT {_IDS} AS id FROM customer)")
def numeric_first_order(spark, d):
    """O7: ids in their order, numbered by range partitions and offsets."""
    ids = table(spark, d, "customer").select(F.expr(_IDS.replace("VARCHAR", "STRING")).alias("id"))
    return match.numbered(ids.withColumns({f"k{i}": k for i, k in enumerate(text.id_order(F.col("id")))}), ["k0", "k1", "k2"]).select("id", "number")


_LOCAL = "CASE n_nationkey % 4 WHEN 0 THEN 'Éclair ' WHEN 1 THEN 'eclair ' WHEN 2 THEN 'Zebra ' ELSE 'zèbre ' END || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')"


@query("locale_order", f"SELECT name, row_number() OVER (ORDER BY {text.fold_sql('name')}) AS place FROM (SELECT {_LOCAL} AS name FROM nation)")
def locale_order(spark, d):
    """O6: names in the order of a locale, in which accents and case come after letters."""
    names = table(spark, d, "nation").select(F.expr(_LOCAL.replace("VARCHAR", "STRING")).alias("name"))
    return counting.ranked(names, [text.locale_order(F.col("name"))]).select("name", "place")  # a dimension's few rows


@query(
    "multiset_algebra",
    """WITH a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY 1)
SELECT 'shared' AS part, count(*) AS keys, sum(least(a.n, b.n))::BIGINT AS n FROM a JOIN b USING (k)
UNION ALL SELECT 'rest', count(*), sum(a.n - coalesce(b.n, 0))::BIGINT FROM a LEFT JOIN b USING (k) WHERE a.n > coalesce(b.n, 0)""",
)
def multiset_algebra(spark, d):
    """A15: what two multisets share, and what is left of the first."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_linenumber")
    a, b = lines.where("l_linenumber <= 2"), lines.where("l_linenumber > 2")
    total = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("keys"), F.sum("n").alias("n"))
    return total(counting.shared_counts(a, b, ["k"]), "shared").unionByName(total(counting.remaining_counts(a, b, ["k"]), "rest"))


@query("join_on_computed_key", "SELECT n_name, count(*) AS n FROM (SELECT 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS t, c_nationkey FROM customer) s JOIN customer c ON c.c_custkey = TRY_CAST(right(s.t, 9) AS BIGINT) JOIN nation ON n_nationkey = c.c_nationkey GROUP BY 1")
def join_on_computed_key(spark, d):
    """J10: a key parsed from text is projected first, then joined by equality."""
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")
    staged = customer.select(F.right(F.concat(F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")), F.lit(9)).try_cast("long").alias("key"))
    return staged.join(customer, staged["key"] == customer["c_custkey"]).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query(
    "edition_merge",
    """WITH e AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS season FROM orders),
m AS (SELECT year, season, CASE WHEN season = '4-NOT SPECIFIED' THEN '5-LOW' ELSE season END AS s FROM e),
k AS (SELECT year, s, row_number() OVER (ORDER BY year, s) AS id FROM (SELECT DISTINCT year, s FROM m)),
r AS (SELECT l_orderkey * 10 + l_linenumber AS id, k.id AS edition, m.season <> m.s AS moved, l_suppkey % 10 AS delegation, CAST(l_quantity AS INTEGER) AS place FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN m ON m.year = year(o_orderdate) AND m.season = o_orderpriority JOIN k ON k.year = m.year AND k.s = m.s),
o AS (SELECT id, edition, delegation, place FROM r WHERE NOT moved UNION ALL SELECT min(id), edition, delegation, place FROM r WHERE moved GROUP BY edition, delegation, place),
n AS (SELECT *, row_number() OVER (ORDER BY id) AS number FROM o)
SELECT edition, count(*) AS n, min(number) AS first_number, max(number) AS last_number FROM n GROUP BY 1""",
)
def edition_merge(spark, d):
    """D34: editions merged and numbered anew, rows that follow them told apart and numbered anew."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    editions = orders.selectExpr("CAST(year(o_orderdate) AS INT) AS year", "o_orderpriority AS season").distinct().selectExpr("year * 10 + CAST(left(season, 1) AS INT) AS edition", "year", "season")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).selectExpr("l_orderkey * 10 + l_linenumber AS id", "year(o_orderdate) * 10 + CAST(left(o_orderpriority, 1) AS INT) AS edition", "l_suppkey % 10 AS delegation", "CAST(l_quantity AS INT) AS place")
    targets = editions.where("season = '4-NOT SPECIFIED'").selectExpr("year", "season", "year AS new_year", "'5-LOW' AS new_season")
    _, out = match.remapped(rows, editions, targets, "id", "edition")
    return out.groupBy(F.col("edition").cast("long").alias("edition")).agg(F.count("*").alias("n"), F.min("id").alias("first_number"), F.max("id").alias("last_number"))


@query("catalog_check", "SELECT t AS validation, 0::BIGINT AS expected, 0::BIGINT AS actual, 'PASS' AS status FROM (VALUES ('nation'), ('region')) x(t) UNION ALL SELECT 'part', 0, 2, 'FAIL'")
def catalog_check(spark, d):
    """S11, J18: columns and types of tables against a register; that of the parts names a type wrongly and a column that is not there."""
    from laurel.operators import gates

    wanted = {t: dict(table(spark, d, t).dtypes) for t in ("nation", "region", "part")}
    wanted["part"] = wanted["part"] | {"p_name": "bigint", "p_none": "string"}
    return gates.report([gates.schema_matches(table(spark, d, t), t, w) for t, w in wanted.items()]).drop("detail")
