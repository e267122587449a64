import pytest

import games
from laurel.plans import answers, country, model, person
from laurel.plans.answers import Status
from laurel.sources import documents


@pytest.fixture(scope="module")
def t(spark):
    return games.tables(spark)


def ids(answer, table="profile", column="id_atleta"):
    return sorted(r[column] for r in answer.tables[table].collect())


def test_gates_pass_and_find_faults(t):
    assert model.model_gates(t).where("status = 'FAIL'").count() == 0
    broken = t | {"participacion": t["participacion"].withColumn("id_noc", t["participacion"]["id_noc"] + 1000)}
    failed = model.model_gates(broken).where("status = 'FAIL'").collect()
    assert [r.validation for r in failed] == ["participacion.id_noc exists"]


@pytest.mark.parametrize("name", ["gonzalez", "GONZÁLEZ", "josé gonz", "José María González"])
def test_names_without_accents_case_and_bullets(t, name):
    assert 1 in ids(person.history(t, name))


def test_letters_that_do_not_decompose(t):
    assert ids(person.history(t, "lukasz orsted")) == [6]


def test_wildcards_are_literal(t):
    assert ids(person.history(t, "100%")) == [3]
    assert person.history(t, "%").tables["profile"].count() == 1
    assert person.history(t, "_").status is Status.NO_MATCH


def test_exact_and_id(t):
    assert ids(person.history(t, "jose gonzalez", exact=True)) == [1, 2]
    assert ids(person.history(t, None, person=4)) == [4]


def test_real_medals_count_the_canonical_naming(t):
    answer = person.history(t, None, person=1)
    profile, medals = answer.tables["profile"].first(), answer.tables["medals"].first()
    assert (profile.participaciones, profile.participaciones_filas_origen, profile.total_medallas, profile.medallas_filas_origen) == (2, 3, 1, 2)
    assert (medals.oro, medals.filas_origen, medals.grupos_indeterminados) == (1, 2, 0)
    undecided = person.history(t, None, person=5).tables["medals"].first()
    assert (undecided.bronce, undecided.oro, undecided.grupos_indeterminados) == (1, 1, 1)


def test_detail_is_faithful(t):
    rows = person.history(t, None, person=1).tables["detail"].collect()
    assert [(r.anio, r.resultado, r.posterior_a_fallecimiento) for r in rows] == [(1972, "Gold", 0), (1972, "Gold", 0), (1976, "=5 lugar", 1)]


def test_filters_drop_persons_only_if_given(t):
    assert ids(person.history(t, "gestartet")) == [4]
    assert person.history(t, "gestartet", year=1972).status is Status.FILTERED_EMPTY
    assert person.history(t, "nobody").status is Status.NO_MATCH
    assert ids(person.history(t, "gonzalez", country="guatemala", medal="gold")) == [1]
    assert ids(person.history(t, "a", season="Summer Youth")) == [3]


def test_ambiguity_gives_candidates(t):
    answer = person.history(t, "gonzalez", most=1)
    assert answer.status is Status.AMBIGUOUS
    assert [(r.id_atleta, r.medallas, r.participaciones, r.sexo) for r in answer.tables["candidates"].collect()] == [(1, 2, 3, "Male"), (2, 0, 1, "Male")]


@pytest.mark.parametrize("wrong", [dict(name=" "), dict(name="a", medal="Oro"), dict(name="a", season="Otono"), dict(name="a", first_year=2000, last_year=1990)])
def test_wrong_parameters_are_errors(t, wrong):
    with pytest.raises(answers.ParameterError):
        person.history(t, **wrong)


@pytest.mark.parametrize(("value", "want"), [(None, 50), (0, 50), (-99, 50), (99999, 1000), (7, 7)])
def test_limits_are_clamped(value, want):
    assert answers.clamped(value, 50, 1000) == want


def test_document_search(t):
    assert [r.id_atleta for r in person.document_search(t, "jose gonzalez").tables["people"].collect()] == [2, 1]
    assert [r.id_atleta for r in person.document_search(t, "gonz jos").tables["people"].collect()] == [2, 1]
    assert person.document_search(t, "xyz").status is Status.NO_MATCH
    assert person.document_search(t, "gonz jos", most=1).status is Status.AMBIGUOUS


@pytest.mark.parametrize(("wanted", "name"), [("GUA", "Guatemala"), ("gtm", "Guatemala"), ("cote d'ivoire", "Côte d'Ivoire"), ("East Germany", "Alemania"), ("roc", "ROC"), ("guinea", "Guinea"), ("ecuat", "Guinea Ecuatorial")])
def test_country_resolution(t, wanted, name):
    assert country.results(t, wanted).tables["profile"].first().pais == name


def test_country_totals(t):
    answer = country.results(t, "GER")
    total = answer.tables["totals"].first()
    assert (total.total_participaciones, total.total_atletas_distintos, total.medallas_oro_oficiales, total.total_medallas_oficiales_pais, total.preseas_totales_entregadas_a_atletas) == (6, 3, 2, 5, 6)
    document = country.results(t, "GER", dialect="document").tables["totals"].first()
    assert document.medallas_oro_oficiales == 1
    assert answer.tables["hosting"].first().ciudades_sede == "Berlin, Kiel, Munich"
    assert answer.tables["hosting"].first().total_ediciones_como_sede == 3
    assert country.results(t, "GER", year=1936).tables["editions"].count() == 3


def test_editions_without_venue_count_but_are_not_listed(t):
    answer = country.results(t, "ROC")
    assert answer.tables["totals"].first().total_participaciones == 1
    assert answer.tables["detail"].count() == 0
    assert answer.tables["hosting"].first().ha_sido_sede == "NO"


def test_country_sport_keeps_accents(t):
    assert country.results(t, "GER", sport="futbol").tables["totals"].first().total_participaciones == 0
    assert country.results(t, "GER", sport="FÚTBOL").tables["totals"].first().total_participaciones == 3


def test_country_ambiguous_missing_and_wrong(t):
    assert country.results(t, "guin").status is Status.AMBIGUOUS
    assert country.results(t, "nowhere").status is Status.NO_MATCH
    with pytest.raises(answers.ParameterError):
        country.results(t, "  ")
    latest = country.results(t, "GUA").tables["profile"].first()
    assert latest.anio_censo_poblacion == 2024


def test_documents_hold_all_results(t):
    people = documents.people(t)
    assert people.count() == 6
    back = documents.flat(people)
    same = t["participacion"].select(back.columns)
    assert back.exceptAll(same).isEmpty() and same.exceptAll(back).isEmpty()
    assert documents.buckets(t).selectExpr("sum(size(participaciones))").first()[0] == 11
    assert documents.catalogue(t).count() == sum(t[x].count() for x in ("deporte", "disciplina", "evento", "edicion_olimpica", "sede", "noc"))
    assert [len(r.nocs) for r in documents.entities(t).orderBy("id_entidad").collect()] == [1, 2, 1, 1, 1, 0]
