"""A small hand-made set of results with the cases that the lookups must get right."""

from laurel.plans.model import MODEL

ROWS = {
    "entidad_geografica": [(1, "Guatemala", "GTM"), (2, "Alemania", "DEU"), (3, "Côte d'Ivoire", "CIV"), (4, "Guinea", "GIN"), (5, "Guinea Ecuatorial", "GNQ"), (6, "Sin sede", None)],
    "deporte": [(1, "Athletics"), (2, "Fútbol")],
    "noc": [(10, "GUA", "Guatemala", 1, None), (20, "GER", "Germany", 2, None), (21, "GDR", "East Germany", 2, None), (30, "ROC", "ROC", None, None), (40, "CIV", "Ivory Coast", 3, None), (50, "GUI", "Guinea", 4, None), (51, "GEQ", "Equatorial Guinea", 5, None)],
    "sede": [(1, "Munich", 2), (2, "Berlin", 2), (3, "Kiel", 2)],
    "edicion_olimpica": [(1, 1972, "Summer", 1), (2, 1936, "Summer", 2), (3, 2010, "Summer Youth", None), (4, 1976, "Summer", 1)],
    "disciplina": [(1, 1, "Athletics"), (2, 2, "Football")],
    "evento": [(1, 1, "200 metres, Men (Olympic)"), (2, 1, "Athletics Men's 200 metres"), (3, 2, "Football, Men (Olympic)"), (4, 1, "Athletics Men's 400 metres"), (5, 1, "100% race_[x]")],
    "poblacion": [(1, 2000, 11), (1, 2020, 17), (1, 2024, None), (2, 2020, 83)],
    "atleta": [
        dict(id_atleta=1, nombre="José•González", nombre_completo="José María•González", sexo="M", fecha_nacimiento="1950-01-02", fecha_fallecimiento="1973-05-05", id_pais_nacimiento=1),
        dict(id_atleta=2, nombre="Jose Gonzalez", sexo="Male"),
        dict(id_atleta=3, nombre="Ana 100%", sexo="Female"),
        dict(id_atleta=4, nombre="Nie Gestartet", sexo="F"),
        dict(id_atleta=5, nombre="Max Müller", sexo="M"),
        dict(id_atleta=6, nombre="Łukasz Ørsted", sexo="M"),
    ],
    "participacion": [
        dict(id_participacion=1, id_atleta=1, id_edicion=1, id_evento=1, id_noc=10, posicion=1, medalla="Gold"),
        dict(id_participacion=2, id_atleta=1, id_edicion=1, id_evento=2, id_noc=10, posicion=1, medalla="Gold"),
        dict(id_participacion=3, id_atleta=1, id_edicion=4, id_evento=4, id_noc=10, posicion=5, empatado=True),
        dict(id_participacion=4, id_atleta=2, id_edicion=1, id_evento=4, id_noc=10, estado_resultado="DNF"),
        dict(id_participacion=5, id_atleta=5, id_edicion=1, id_evento=3, id_noc=20, posicion=1, medalla="Gold"),
        dict(id_participacion=6, id_atleta=6, id_edicion=1, id_evento=3, id_noc=20, posicion=1, medalla="Gold"),
        dict(id_participacion=7, id_atleta=3, id_edicion=1, id_evento=3, id_noc=21, posicion=1, medalla="Gold"),
        dict(id_participacion=8, id_atleta=3, id_edicion=3, id_evento=5, id_noc=30, posicion=2, medalla="Silver"),
        dict(id_participacion=9, id_atleta=5, id_edicion=2, id_evento=2, id_noc=20, medalla="Bronze"),
        dict(id_participacion=10, id_atleta=5, id_edicion=2, id_evento=4, id_noc=20, medalla="Bronze"),
        dict(id_participacion=11, id_atleta=5, id_edicion=2, id_evento=1, id_noc=20, medalla="Bronze"),
    ],
}


def tables(spark):
    out = {}
    for name, spec in MODEL.items():
        columns = list(spec.columns)
        rows = [tuple(r.get(c) for c in columns) if isinstance(r, dict) else r for r in ROWS[name]]
        text = spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], ", ".join(f"{c} string" for c in columns))
        from laurel.plans.model import typed

        out[name] = typed(text, name).cache()
    return out
