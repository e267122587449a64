"""Results of a country or delegation: resolution in steps, hosting, totals with official medals, and detail."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.functions import parse, text
from laurel.operators import match
from laurel.plans import answers
from laurel.plans.answers import Answer, Status
from laurel.plans.model import star


def directory(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per entity or per delegation without an entity: ids, name, code, delegations' codes and names."""
    nocs = tables["noc"]
    held = nocs.where("id_entidad IS NOT NULL").groupBy("id_entidad").agg(F.array_sort(F.collect_list("codigo_noc")).alias("codes"), F.array_sort(F.collect_list("nombre_noc")).alias("names"))
    entities = tables["entidad_geografica"].join(held, "id_entidad", "left")
    none = F.array().cast("array<string>")
    entities = entities.select("id_entidad", F.lit(None).cast("int").alias("id_noc"), "nombre", "codigo_pais", F.coalesce("codes", none).alias("codes"), F.coalesce("names", none).alias("names"))
    free = nocs.where("id_entidad IS NULL").select(F.lit(None).cast("int").alias("id_entidad"), "id_noc", F.coalesce("nombre_noc", "codigo_noc").alias("nombre"), F.lit(None).cast("string").alias("codigo_pais"), F.array_compact(F.array("codigo_noc")).alias("codes"), F.array_compact(F.array("nombre_noc")).alias("names"))
    return entities.unionByName(free)


def resolve(tables: dict[str, DataFrame], wanted: str) -> DataFrame:
    """Rows of the directory for a text: by delegation code, else country code, else name, else delegation name, else part of a name."""
    up = wanted.strip().upper()
    steps = [
        F.array_contains("codes", up),
        F.upper("codigo_pais") == up,
        F.col("id_entidad").isNotNull() & text.equals_folded(F.col("nombre"), wanted),
        F.exists("names", lambda n: text.equals_folded(n, wanted)),
        text.contains_literal(F.col("nombre"), wanted) | F.exists("names", lambda n: text.contains_literal(n, wanted)) | (F.col("id_entidad").isNull() & F.exists("codes", lambda c: text.contains_literal(c, wanted))),
    ]
    return match.prioritized(directory(tables), steps, "id_entidad")


def results(tables: dict[str, DataFrame], wanted: str | None, year: int | None = None, season: str | None = None, sport: str | None = None, top: int | None = 50, dialect: str = "relational") -> Answer:
    """OK with profile, hosting, editions, totals and detail; NO_MATCH; AMBIGUOUS with candidates.

    All delegations of an entity count as one. Hosting ignores the filters. Official medals count an outcome once:
    (edition, event, delegation, medal), in the document dialect without the delegation. Totals count editions without
    a venue, the detail lists only those with one. The sport is matched without regard to case only, accents kept.
    """
    if not (wanted or "").strip():
        raise answers.ParameterError("a country or delegation is needed")
    season, top = answers.season(season), answers.clamped(top, 50, 1000)
    given = {"wanted": wanted, "year": year, "season": season, "sport": sport, "top": top, "dialect": dialect}
    found = resolve(tables, wanted)
    heads = found.orderBy("nombre").limit(2).collect()
    if not heads:
        return Answer(Status.NO_MATCH, given)
    if len(heads) > 1 and heads[0].step == 4:
        shown = found.select("id_entidad", "id_noc", F.col("nombre").alias("pais_o_delegacion"), F.coalesce("codigo_pais", F.lit("N/A")).alias("codigo_iso"), F.array_join("codes", ", ").alias("codigos_noc_asociados"))
        return Answer(Status.AMBIGUOUS, given, OrderedDict(candidates=shown.orderBy("pais_o_delegacion")))
    entity, noc = heads[0].id_entidad, heads[0].id_noc
    mine = F.col("id_entidad") == entity if entity is not None else F.col("id_noc") == noc
    rows = star(tables).where(mine)
    rows = answers.where_all(rows, [None if year is None else F.col("anio") == year, None if season is None else F.col("temporada") == season, None if not (sport or "").strip() else F.lower("deporte").contains(sport.strip().lower())])
    venues = tables["sede"].where(F.col("id_pais") == (entity if entity is not None else -1)).select("id_sede", F.col("nombre").alias("ciudad_sede"))
    hosted = tables["edicion_olimpica"].join(venues, "id_sede")
    return Answer(
        Status.OK,
        given,
        OrderedDict(profile=profile(tables, heads[0]), hosting=hosting(hosted, venues), editions=hosted.select("id_edicion", "anio", "temporada", "ciudad_sede").orderBy("anio", "temporada"), totals=totals(rows, dialect), detail=detail(tables, rows, top)),
    )


def profile(tables: dict[str, DataFrame], found) -> DataFrame:
    """Name, codes and the latest population."""
    spark = tables["noc"].sparkSession
    one = spark.range(1).select(F.lit(found.id_entidad).cast("int").alias("id_entidad"), F.lit(found.nombre).alias("pais"), F.lit(found.codigo_pais or "N/A").alias("codigo_iso_pais"), F.lit(", ".join(found.codes) or "Sin NOC").alias("codigos_noc_historicos"))
    latest = tables["poblacion"].where(F.col("id_entidad") == (found.id_entidad if found.id_entidad is not None else -1)).agg(F.max_by("poblacion", "anio").alias("poblacion_mas_reciente"), F.max("anio").alias("anio_censo_poblacion"))
    return one.crossJoin(latest)  # one row each


def hosting(hosted: DataFrame, venues: DataFrame) -> DataFrame:
    """Whether and how often games were held, and all the cities with a venue, those without an edition too."""
    label = F.concat("ciudad_sede", F.lit(" ("), F.col("anio").cast("string"), F.lit(" "), "temporada", F.lit(")"))
    cities = venues.agg(F.array_join(F.array_sort(F.collect_set("ciudad_sede")), ", ").alias("ciudades_sede"))
    out = hosted.agg(F.count("*").alias("total_ediciones_como_sede"), F.array_join(F.array_sort(F.collect_list(label)), ", ").alias("resumen_ediciones_como_sede")).crossJoin(cities)  # one row each
    return out.select(F.when(F.col("total_ediciones_como_sede") > 0, "SÍ").otherwise("NO").alias("ha_sido_sede"), "total_ediciones_como_sede", F.coalesce(F.nullif("ciudades_sede", F.lit("")), F.lit("Ninguna")).alias("ciudades_sede"), "resumen_ediciones_como_sede")


def totals(rows: DataFrame, dialect: str) -> DataFrame:
    """Participations, persons, official medals and medals handed to persons, in one pass over the rows."""
    key = F.struct("id_edicion", "id_evento", "medalla", *(["id_noc"] if dialect == "relational" else []))
    of = lambda m, name: F.count_distinct(F.when(F.col("medalla") == m, key)).alias(name)
    return rows.agg(
        F.count_distinct("id_participacion").alias("total_participaciones"),
        F.count_distinct("id_atleta").alias("total_atletas_distintos"),
        of("Gold", "medallas_oro_oficiales"),
        of("Silver", "medallas_plata_oficiales"),
        of("Bronze", "medallas_bronce_oficiales"),
        F.count_distinct(F.when(F.col("medalla").isNotNull(), key)).alias("total_medallas_oficiales_pais"),
        F.count("medalla").alias("preseas_totales_entregadas_a_atletas"),
    )


def detail(tables: dict[str, DataFrame], rows: DataFrame, top: int) -> DataFrame:
    """The first rows by medal, then newest edition."""
    people = tables["atleta"].select("id_atleta", F.col("nombre").alias("atleta"))
    out = rows.where(F.col("sede").isNotNull()).join(people, "id_atleta")
    out = out.orderBy(parse.medal_rank(F.col("medalla")), F.desc("anio"), "deporte", "evento", "atleta", "id_participacion").limit(top)
    return out.select("anio", "temporada", F.col("sede").alias("ciudad_sede"), "deporte", "disciplina", "evento", "atleta", "codigo_noc", F.coalesce("nombre_noc", "codigo_noc").alias("nombre_noc"), F.coalesce("pais_representado", F.lit("N/A")).alias("pais_representado"), "equipo", "posicion", F.coalesce("medalla", F.lit("Sin Medalla")).alias("medalla"), F.coalesce("estado_resultado", F.lit("Finished")).alias("estado_resultado"))
