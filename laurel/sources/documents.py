"""The document model: nested collections made from the relational tables, and their checks and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.operators import reshape
from laurel.plans.model import star


def _entry() -> Column:
    """A result with its edition, event and delegation nested."""
    return F.struct(
        F.col("id_participacion"),
        F.struct("id_edicion", "anio", "temporada", F.struct(F.col("sede").alias("nombre")).alias("sede")).alias("edicion"),
        F.struct("id_evento", F.col("evento").alias("nombre"), F.struct("id_disciplina", F.col("disciplina").alias("nombre"), F.struct("id_deporte", F.col("deporte").alias("nombre")).alias("deporte")).alias("disciplina")).alias("evento"),
        F.struct("id_noc", "codigo_noc", F.struct("id_entidad", F.col("pais_representado").alias("nombre")).alias("entidad")).alias("noc"),
        F.col("posicion"),
        F.col("estado_resultado"),
        F.col("medalla"),
        F.col("id_atleta"),
    )


def people(tables: dict[str, DataFrame]) -> DataFrame:
    """A document per person with all results; persons without results have an empty array."""
    entries = star(tables).groupBy("id_atleta").agg(F.array_sort(F.collect_list(_entry())).alias("participaciones"))
    return tables["atleta"].join(entries, "id_atleta", "left").withColumn("participaciones", F.coalesce("participaciones", F.array().cast(entries.schema["participaciones"].dataType)))


def entities(tables: dict[str, DataFrame]) -> DataFrame:
    """A document per entity with populations, delegations, venues and editions held."""
    out = tables["entidad_geografica"]
    venues = tables["sede"].withColumnRenamed("id_pais", "id_entidad")
    held = tables["edicion_olimpica"].join(venues.select("id_sede", "id_entidad", F.col("nombre").alias("ciudad")), "id_sede")
    for name, rows, fields in (("poblacion_anual", tables["poblacion"], ["anio", "poblacion"]), ("nocs", tables["noc"], ["id_noc", "codigo_noc", "nombre_noc"]), ("sedes", venues, ["id_sede", "nombre"]), ("ediciones_organizadas", held, ["id_edicion", "anio", "temporada", "ciudad"])):
        nested = reshape.nested(rows.where("id_entidad IS NOT NULL"), ["id_entidad"], fields, fields[:1], name)
        out = out.join(nested, "id_entidad", "left").withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))
    return out


def buckets(tables: dict[str, DataFrame]) -> DataFrame:
    """A document per entity (or delegation without one, or nothing known) and edition with its results."""
    rows = star(tables)
    kind = F.when(F.col("id_entidad").isNotNull(), "ENTIDAD").when(F.col("id_noc").isNotNull(), "NOC").otherwise("SIN_NOC")
    key = F.concat_ws(":", kind, F.coalesce("id_entidad", "id_noc", F.lit(0)).cast("string"))
    rows = rows.withColumns({"tipo_agrupacion": kind, "clave": key})
    return rows.groupBy("clave", "tipo_agrupacion", "id_edicion", "anio", "temporada").agg(F.array_sort(F.collect_list(_entry())).alias("participaciones"), F.count("medalla").alias("medallas"))


def catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """Six kinds of small documents under one tag."""
    parts = {}
    for tag, name in (("DEPORTE", "deporte"), ("DISCIPLINA", "disciplina"), ("EVENTO", "evento"), ("EDICION", "edicion_olimpica"), ("SEDE", "sede"), ("NOC", "noc")):
        rows = tables[name]
        id = rows.columns[0]
        parts[tag] = rows.withColumn("id", F.col(id).cast("long")).drop(id)
    return reshape.tagged(parts)


def with_element_field(docs: DataFrame, array: str, name: str, value) -> DataFrame:
    """docs with a field added to every element of an array."""
    return docs.withColumn(array, F.transform(array, lambda x: x.withField(name, value)))


def lifted(docs: DataFrame, outer: str, inner: str) -> DataFrame:
    """docs with a nested field in the place of its parent."""
    return docs.withColumn(outer, F.col(f"{outer}.{inner}"))


def flat(docs: DataFrame) -> DataFrame:
    """The results in people() as rows again."""
    return docs.select(F.explode("participaciones").alias("p")).select("p.id_participacion", "p.id_atleta", "p.edicion.id_edicion", "p.evento.id_evento", "p.noc.id_noc", "p.posicion", "p.estado_resultado", "p.medalla")
