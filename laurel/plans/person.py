"""History of a person: search by name, filters, ambiguity, profile, real medal counts and the detail of results."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.functions import parse, text
from laurel.operators import counting
from laurel.plans import answers
from laurel.plans.answers import Answer, Status
from laurel.plans.model import star

NAMES = ("nombre", "nombre_completo", "nombre_usado", "nombre_original")


def _any(columns: list[Column], test) -> Column:
    """Whether the test holds for one of the columns."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(test(c), F.lit(False))
    return out


def history(
    tables: dict[str, DataFrame],
    name: str | None,
    sport: str | None = None,
    country: str | None = None,
    year: int | None = None,
    first_year: int | None = None,
    last_year: int | None = None,
    medal: str | None = None,
    season: str | None = None,
    medallists_only: bool = False,
    exact: bool = False,
    person: int | None = None,
    most: int | None = 25,
) -> Answer:
    """OK with profile, medals and detail; NO_MATCH; FILTERED_EMPTY with the filters; AMBIGUOUS with candidates beyond `most` persons.

    Names match in any of four columns without regard to case, accents and bullets; user text is literal. Filters keep
    rows; persons without rows left are dropped only if there is a filter. A season is matched as a whole.
    """
    if person is None and not (name or "").strip():
        raise answers.ParameterError("a name or an id is needed")
    most, medal, season = answers.clamped(most, 25, 500), answers.medal(medal), answers.season(season)
    spans = answers.years(year, first_year, last_year)
    wanted = (name or "").strip()
    given = {"name": wanted, "sport": sport, "country": country, "year": year, "first_year": first_year, "last_year": last_year, "medal": medal, "season": season, "medallists_only": medallists_only, "person": person, "most": most}

    people = tables["atleta"]
    columns = [F.col(c) for c in NAMES if c in people.columns]
    if person is not None:
        found = people.where(F.col("id_atleta") == person)
    elif exact:
        found = people.where(_any(columns, lambda c: text.equals_folded(c, wanted)))
    else:
        found = people.where(_any(columns, lambda c: text.contains_literal(c, wanted)))
    if found.isEmpty():
        return Answer(Status.NO_MATCH, given)

    rows = star(tables).join(found.select("id_atleta"), "id_atleta", "left_semi")
    in_country = None
    if country is not None:
        in_country = _any([F.col("codigo_noc")], lambda c: text.equals_folded(c, country)) | _any([F.col("nombre_noc"), F.col("pais_representado")], lambda c: text.contains_literal(c, country))
    filters = [*spans, None if season is None else F.col("temporada") == season, None if sport is None else text.contains_literal(F.col("deporte"), sport), None if medal is None else F.col("medalla") == medal, in_country, F.col("medalla").isNotNull() if medallists_only else None]
    rows = answers.where_all(rows, filters)
    if any(f is not None for f in filters):
        found = found.join(rows.select("id_atleta"), "id_atleta", "left_semi")
        if found.isEmpty():
            return Answer(Status.FILTERED_EMPTY, given)

    if len(found.select("id_atleta").limit(most + 1).collect()) > most:
        total = tables["participacion"].join(found.select("id_atleta"), "id_atleta", "left_semi").groupBy("id_atleta").agg(F.count("*").alias("participaciones"), F.count("medalla").alias("medallas"))
        candidates = found.select("id_atleta", "nombre", shown_sex().alias("sexo"), "fecha_nacimiento").join(total, "id_atleta", "left").na.fill(0, ["participaciones", "medallas"])
        return Answer(Status.AMBIGUOUS, given, OrderedDict(candidates=candidates.orderBy(F.desc("medallas"), F.desc("participaciones"), "nombre", "id_atleta").limit(200)))
    return Answer(Status.OK, given, OrderedDict(profile=profile(tables, found, rows), medals=medals(found, rows), detail=detail(found, rows)))


def shown_sex() -> Column:
    return F.when(F.col("sexo").isin("M", "Male"), "Male").when(F.col("sexo").isin("F", "Female"), "Female").otherwise(F.col("sexo"))


def _real_medals(rows: DataFrame) -> DataFrame:
    held = rows.where(F.col("medalla").isNotNull())
    counted = counting.real_counts(held, ["id_atleta", "medalla"], ["id_edicion", "id_disciplina"], text.is_canonical(F.col("evento")))
    of = lambda m: F.coalesce(F.sum(F.when(F.col("medalla") == m, F.col("real"))), F.lit(0))
    return counted.groupBy("id_atleta").agg(of("Gold").alias("oro"), of("Silver").alias("plata"), of("Bronze").alias("bronce"), F.sum("real").alias("total_medallas"), F.sum("source_rows").alias("filas_origen"), F.sum("undecided").alias("grupos_indeterminados"))


def profile(tables: dict[str, DataFrame], found: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each person with real counts of results and medals, and the rows behind them."""
    real = counting.real_counts(rows, ["id_atleta"], ["id_edicion", "id_disciplina"], text.is_canonical(F.col("evento"))).select("id_atleta", F.col("real").alias("participaciones"), F.col("source_rows").alias("participaciones_filas_origen"))
    span = rows.groupBy("id_atleta").agg(F.count_distinct("anio").alias("ediciones"), F.count_distinct("deporte").alias("deportes"), F.min("anio").alias("primer_ano"), F.max("anio").alias("ultimo_ano"))
    won = _real_medals(rows).select("id_atleta", "total_medallas", F.col("filas_origen").alias("medallas_filas_origen"))
    lands = tables["entidad_geografica"]
    born = lands.select(F.col("id_entidad").alias("id_pais_nacimiento"), F.col("nombre").alias("pais_nacimiento"))
    died = lands.select(F.col("id_entidad").alias("id_pais_fallecimiento"), F.col("nombre").alias("pais_fallecimiento"))
    out = found.join(born, "id_pais_nacimiento", "left").join(died, "id_pais_fallecimiento", "left").join(real, "id_atleta", "left").join(span, "id_atleta", "left").join(won, "id_atleta", "left")
    counts = ["participaciones", "participaciones_filas_origen", "total_medallas", "medallas_filas_origen", "ediciones", "deportes"]
    full = F.trim(F.replace("nombre_completo", F.lit(text.BULLET), F.lit(" ")))
    columns = ["id_atleta", "nombre", full.alias("nombre_completo"), shown_sex().alias("sexo"), F.col("sexo").alias("sexo_original"), "fecha_nacimiento", "ciudad_nacimiento", "region_nacimiento", "pais_nacimiento", "fecha_fallecimiento", "pais_fallecimiento", "altura_cm", "peso_kg"]
    return out.na.fill(0, counts).select(*columns, *counts, "primer_ano", "ultimo_ano").orderBy(F.desc("total_medallas"), F.desc("participaciones"), "nombre", "id_atleta")


def medals(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Real medals of each person, the rows behind them, undecided groups, and results without a medal."""
    status = F.col("estado_resultado")
    rest = rows.groupBy("id_atleta").agg(
        F.count_if(F.col("medalla").isNull() & status.isNull() & F.col("posicion").isNotNull()).alias("sin_medalla_con_posicion"), *[F.count_if(status == s).alias(s.lower()) for s in ("DNF", "DNS", "DQ")]
    )
    out = found.select("id_atleta", "nombre").join(_real_medals(rows), "id_atleta", "left").join(rest, "id_atleta", "left")
    return out.na.fill(0).orderBy(F.desc("total_medallas"), "nombre", "id_atleta")


def detail(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Every row as it is, with a readable result and a flag for results after the person's death."""
    people = found.select("id_atleta", F.col("nombre").alias("atleta"), "fecha_fallecimiento")
    later = F.when(F.col("anio") > F.year("fecha_fallecimiento"), 1).otherwise(0)
    label = parse.result_label(F.col("medalla"), F.col("estado_resultado"), F.col("posicion"), F.col("empatado"))
    columns = ["id_atleta", "atleta", "anio", "temporada", "sede", "deporte", "disciplina", "evento", "codigo_noc", "pais_representado", "equipo", "edad", "posicion", "empatado", "estado_resultado", "medalla"]
    out = rows.join(people, "id_atleta").select(*columns, label.alias("resultado"), "nombre_competencia", later.alias("posterior_a_fallecimiento"))
    return out.orderBy("atleta", "id_atleta", "anio", "deporte", "disciplina", "evento")


def document_search(tables: dict[str, DataFrame], words: str, most: int = 25) -> Answer:
    """The document dialect's search: exact in normal form before partial; partial means that all words begin words of one name.

    Medals count raw rows here. OK gives persons with their nested results, AMBIGUOUS the candidates, those that begin with the words first.
    """
    if not words.strip():
        raise answers.ParameterError("a name is needed")
    people = tables["atleta"]
    columns = [F.col(c) for c in NAMES[:3] if c in people.columns]
    plain = text.fold_python(words).strip()
    step = F.when(_any(columns, lambda c: text.equals_folded(c, words)), 0).when(_any(columns, lambda c: text.all_words(c, words)), F.when(_any(columns, lambda c: text.fold(c).startswith(plain)), 1).otherwise(2))
    found = people.withColumn("step", step).where("step IS NOT NULL")
    heads = found.select("id_atleta", "step").orderBy("step", "id_atleta").limit(most + 1).collect()
    given = {"words": words, "most": most}
    if not heads:
        return Answer(Status.NO_MATCH, given)
    if heads[0].step == 0:
        found = found.where("step = 0")
        heads = [h for h in heads if h.step == 0]
    if len(heads) > most:
        return Answer(Status.AMBIGUOUS, given, OrderedDict(candidates=found.select("id_atleta", "nombre", "step").orderBy("step", "nombre", "id_atleta").limit(200)))
    rows = star(tables).join(found.select("id_atleta"), "id_atleta", "left_semi")
    nested = rows.groupBy("id_atleta").agg(F.array_sort(F.collect_list(F.struct("anio", "temporada", "deporte", "disciplina", "evento", "codigo_noc", "medalla", "posicion"))).alias("participaciones"), F.count("medalla").alias("medallas"))
    return Answer(Status.OK, given, OrderedDict(people=found.select("id_atleta", "nombre").join(nested, "id_atleta", "left").orderBy("nombre", "id_atleta")))
