"""The relational model: ten tables with types, keys and checks; loading, casting and the star of results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.functions import parse
from laurel.operators import gates


@dataclass(frozen=True)
class Table:
    """columns: name -> type; key; unique keys; references column -> (table, column); checks: name -> SQL condition."""

    columns: dict[str, str]
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)


_ENTITY, _NOC = ("entidad_geografica", "id_entidad"), ("noc", "id_noc")

#: Names, types and constraints are fixed by the data that is loaded.
MODEL: dict[str, Table] = {
    "entidad_geografica": Table({"id_entidad": "int", "nombre": "string", "codigo_pais": "string"}, ("id_entidad",), required=("nombre",)),
    "deporte": Table({"id_deporte": "int", "nombre": "string"}, ("id_deporte",), (("nombre",),), required=("nombre",)),
    "noc": Table({"id_noc": "int", "codigo_noc": "string", "nombre_noc": "string", "id_entidad": "int", "notas": "string"}, ("id_noc",), (("codigo_noc",),), {"id_entidad": _ENTITY}),
    "atleta": Table(
        {
            "id_atleta": "bigint", "nombre": "string", "nombre_completo": "string", "nombre_usado": "string", "nombre_original": "string", "otros_nombres": "string", "apodos": "string",
            "orden_nombre": "string", "sexo": "string", "fecha_nacimiento": "date", "ciudad_nacimiento": "string", "region_nacimiento": "string", "id_pais_nacimiento": "int",
            "id_pais_nacionalidad": "int", "fecha_fallecimiento": "date", "id_pais_fallecimiento": "int", "altura_cm": "decimal(5,2)", "peso_kg": "decimal(5,2)",
        },
        ("id_atleta",), references={"id_pais_nacimiento": _ENTITY, "id_pais_nacionalidad": _ENTITY, "id_pais_fallecimiento": _ENTITY}, required=("nombre",),
    ),
    "sede": Table({"id_sede": "int", "nombre": "string", "id_pais": "int"}, ("id_sede",), (("nombre", "id_pais"),), {"id_pais": _ENTITY}, ("nombre", "id_pais")),
    "edicion_olimpica": Table({"id_edicion": "int", "anio": "smallint", "temporada": "string", "id_sede": "int"}, ("id_edicion",), (("anio", "temporada"),), {"id_sede": ("sede", "id_sede")}, ("anio", "temporada"), {"season": f"temporada IN {parse.SEASONS}"}),
    "disciplina": Table({"id_disciplina": "int", "id_deporte": "int", "nombre": "string"}, ("id_disciplina",), (("id_deporte", "nombre"),), {"id_deporte": ("deporte", "id_deporte")}, ("id_deporte", "nombre")),
    "evento": Table({"id_evento": "bigint", "id_disciplina": "int", "nombre": "string"}, ("id_evento",), (("id_disciplina", "nombre"),), {"id_disciplina": ("disciplina", "id_disciplina")}, ("id_disciplina", "nombre")),
    "poblacion": Table({"id_entidad": "int", "anio": "smallint", "poblacion": "bigint"}, ("id_entidad", "anio"), references={"id_entidad": _ENTITY}),
    "participacion": Table(
        {
            "id_participacion": "bigint", "id_atleta": "bigint", "id_edicion": "int", "id_evento": "bigint", "id_noc": "int", "equipo": "string", "nombre_competencia": "string", "edad": "decimal(5,2)",
            "altura_cm_registrada": "decimal(5,2)", "peso_kg_registrado": "decimal(16,13)", "posicion": "int", "empatado": "boolean", "estado_resultado": "string", "medalla": "string",
        },
        ("id_participacion",),
        references={"id_atleta": ("atleta", "id_atleta"), "id_edicion": ("edicion_olimpica", "id_edicion"), "id_evento": ("evento", "id_evento"), "id_noc": _NOC},
        required=("id_atleta", "id_edicion", "id_evento"),
        checks={"medal": f"medalla IN {parse.MEDALS}", "position": "posicion > 0"},
    ),
}


def typed(staging: DataFrame, name: str) -> DataFrame:
    """A staged table of text columns as its registered types; what does not convert is null, a column that lacks is null."""
    return staging.select(*[(parse.safe_cast(F.col(c), kind) if c in staging.columns else F.lit(None).cast(kind)).alias(c) for c, kind in MODEL[name].columns.items()])


def staging_gates(staging: DataFrame, name: str) -> DataFrame:
    """Every staged value converts, without losing decimals."""
    out = []
    for c, kind in MODEL[name].columns.items():
        if c not in staging.columns or kind == "string":
            continue
        out.append(gates.convertible(staging, f"{name}.{c} converts", c, parse.safe_cast(F.col(c), kind)))
        if kind.startswith("decimal"):
            precision, scale = map(int, kind[8:-1].split(","))
            out.append(gates.holds(staging, f"{name}.{c} keeps its decimals", ~parse.loses_precision(F.col(c), precision, scale)))
    return gates.report(out)


def model_gates(tables: dict[str, DataFrame]) -> DataFrame:
    """Keys, unique keys, references, required columns and checks of all given tables."""
    out = []
    for name, df in tables.items():
        spec = MODEL[name]
        out.append(gates.unique(df, f"{name} key", list(spec.key)))
        out += [gates.unique(df.dropna(subset=list(u)), f"{name} unique {', '.join(u)}", list(u)) for u in spec.unique]
        out += [gates.no_orphans(df, f"{name}.{c} exists", c, tables[t], k) for c, (t, k) in spec.references.items() if t in tables and c in df.columns]
        wise = {f"{name}.{c} is given": (F.col(c).isNull(), c) for c in spec.required}
        wise |= {f"{name} check {k}": (~F.expr(v), "") for k, v in spec.checks.items()}
        if wise:
            out.append(gates.row_wise(df, wise))
    return gates.report(out)


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a folder of Parquet tables."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in MODEL}


def star(tables: dict[str, DataFrame]) -> DataFrame:
    """Participations with edition, venue, event, discipline, sport, delegation and represented country.

    The country is that of the delegation. Editions without a venue, and rows without a delegation, stay. Spark
    broadcasts the dimensions that are under its threshold and shuffles the rest.
    """
    t = tables
    editions = t["edicion_olimpica"].join(t["sede"].select("id_sede", F.col("nombre").alias("sede")), "id_sede", "left")
    sports = t["deporte"].select("id_deporte", F.col("nombre").alias("deporte"))
    fields = t["disciplina"].select("id_disciplina", "id_deporte", F.col("nombre").alias("disciplina"))
    events = t["evento"].select("id_evento", "id_disciplina", F.col("nombre").alias("evento")).join(fields, "id_disciplina").join(sports, "id_deporte")
    countries = t["entidad_geografica"].select("id_entidad", F.col("nombre").alias("pais_representado"))
    nocs = t["noc"].select("id_noc", "codigo_noc", "nombre_noc", "id_entidad").join(countries, "id_entidad", "left")
    return t["participacion"].join(editions, "id_edicion").join(events, "id_evento").join(nocs, "id_noc", "left")
