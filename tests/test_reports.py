"""The reports over the hand-written tables, with expectations worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caseflow import plans
from caseflow.plans import KEEP_TIES, ONE_ROW
from caseflow.plans.person_history import FEEDS
from tests.conftest import plan_of
from tests.fixtures import AS_OF, MUNICIPALITIES, ts


def rows(df, *cols):
    selected = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in selected.collect()), key=repr)


# Case detail ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def detail(tables):
    return plans.case_detail(tables).cache()


def test_case_detail_rows(detail):
    # 13 deleted, 14 and 16 unknown, 15 of an excluded type, 18 before the first year.
    assert rows(detail, "numero_solicitud_pqrsf", "numero_servicio") == [
        (10, 1000), (10, 1004), (11, 1001), (11, 1001), (11, 1002), (11, 1002), (12, None),
        (17, None), (19, None)]


def test_case_detail_dates(detail):
    got = {r.numero_servicio: r for r in detail.where("numero_servicio is not null").collect()}
    # The last closing entry; the NULL one does not count as last.
    assert got[1000].fecha_cierre == ts("2023-03-20 08:00:00")
    assert got[1001].fecha_cierre == ts("2023-07-10")
    # The first assignment has no known time and counts as the earliest, so the study
    # that follows gives the date.
    assert got[1000].fecha_asignacion_servicio == ts("2023-03-08")
    assert got[1001].fecha_asignacion_servicio == ts("2023-05-09")
    assert got[1002].fecha_asignacion_servicio == ts("2023-01-01")
    assert got[1000].fecha_solucion_servicio == ts("2023-03-15")
    assert got[1002].fecha_solucion_servicio == ts("2024-05-12")
    assert got[1004].fecha_solucion_servicio is None


def test_case_detail_attributes(detail):
    got = {(r.numero_solicitud_pqrsf, r.numero_servicio, r.municipio_afiliacion): r
           for r in detail.collect()}
    first = got[10, 1000, "Bello"]
    assert (first.EstadoCaso, first.reabierto_Supersalud, first.region_afiliacion) == (
        "Cerrado", "SI", "Norte")
    assert (first.ResponsableCaso, first.IPSDestino) == ("Luis", "Sede, norte;\n")
    assert first.IPS_responsable_respuesta == first.usuario_asignado_servicio
    # The person's type '1' reads as true, so members of both types match.
    assert {k[2] for k in got if k[0] == 11} == {"Suelto", "Medellín"}
    second = got[11, 1001, "Medellín"]
    assert (second.EstadoCaso, second.reabierto_Supersalud, second.region_afiliacion) == (
        "Cerrado", "NO", "VALLE DE ABURRA")
    assert got[12, None, None].EstadoCaso == "Radicado"
    assert got[17, None, None].EstadoCaso is None


def test_case_detail_match_and_year_parameters(tables):
    strict = plans.case_detail(tables, match="strict", min_year=2024)
    assert rows(strict, "numero_solicitud_pqrsf") == [(12,), (17,)]
    old = plans.case_detail(tables, min_year=2021)
    closed = old.where("numero_solicitud_pqrsf = 18").first()
    assert closed.fecha_cierre == ts("2022-01-02")
    # Under binary comparison 'Cerrado' is not the closing state of the case log.
    exact = plans.case_detail(tables, min_year=2021, collation="binary")
    assert exact.where("numero_solicitud_pqrsf = 18").first().fecha_cierre is None


# Consolidated --------------------------------------------------------------------------

def test_ties_repeat_the_case(tables):
    form = {**KEEP_TIES, "min_year": 2023}
    ties = plans.consolidated(tables, **form, as_of=AS_OF)
    one = plans.consolidated(tables, **{**form, "closing": "one"}, as_of=AS_OF)
    key = ["numero_solicitud_pqrsf", "numero_servicio"]
    # Two tied closing entries of case 10, and both of its services twice. The entries of
    # case 12 have no time and do not tie.
    assert rows(ties, *key) == [(10, 1000)] * 2 + [(10, 1004)] * 2 + [
        (11, 1001), (11, 1002), (12, None), (17, None), (19, None)]
    assert rows(one, *key) == [(10, 1000), (10, 1004), (11, 1001), (11, 1002), (12, None),
                               (17, None), (19, None)]
    untied = "numero_solicitud_pqrsf <> 10"
    assert rows(ties.where(untied)) == rows(one.where(untied))
    assert rows(ties.distinct()) == rows(one.distinct())


def test_consolidated_one_row(tables):
    got = {(r.numero_solicitud_pqrsf, r.numero_servicio): r
           for r in plans.consolidated(tables, **ONE_ROW, as_of=AS_OF).collect()}
    first = got[10, 1000]
    assert (first.edad, first.genero_afectado, first.discapacidad_afectado) == (39, "F", "NO")
    assert (first.cod_divipola_afiliacion, first.mpio_afiliacion) == ("05001", "MEDELLIN")
    assert first.region_afiliacion == "NORTE"
    assert first.usuario_asignado_servicio == 'ANA; \t "RUIZ",  PAZ\r\n'
    assert first.responsable_caso == "LUIS"
    assert (first.IPS_responsable_respuesta, first.nit_responsable_respuesta) == (
        "SEDE NORTE", "NIT7")
    assert (first.medicamento, first.servicio_atribuido_ips) == ("NO", "NO")
    # The site has no name, so the service's text is taken; a strict match finds nobody.
    second = got[11, 1001]
    assert (second.IPS_responsable_respuesta, second.nit_responsable_respuesta) == (
        "SEDE UNO", "NIT50")
    assert (second.medicamento, second.servicio_atribuido_ips) == ("SI", "SI")
    assert (second.edad, second.discapacidad_afectado) == (None, "SI")
    assert got[11, 1002].servicio_atribuido_ips == "No aplica"
    # Without a service the flags take their default; without a person there is no flag.
    assert (got[12, None].medicamento, got[12, None].discapacidad_afectado) == ("NO", "SI")
    assert got[17, None].discapacidad_afectado is None
    # Unknown on both sides counts as a disability.
    assert got[19, None].discapacidad_afectado == "SI"


def test_consolidated_forms(tables):
    ties = plans.consolidated(tables, **KEEP_TIES, as_of=AS_OF)
    assert rows(ties, "numero_solicitud_pqrsf") == [(12,), (17,)]
    assert "fecha_modificacion_caso" in ties.columns
    form = {**KEEP_TIES, "min_year": 2023}
    got = {r.numero_servicio: r for r in plans.consolidated(tables, **form).collect()}
    # A nameless site gives an empty name, an unknown site none at all.
    assert got[1001].IPS_responsable_respuesta == ""
    assert got[1002].IPS_responsable_respuesta is None
    # The provider with the site's own id, not the site's foreign key.
    assert got[1000].nit_responsable_respuesta == "NIT50"


def test_closing_precedence_differs(tables):
    closed = {"numero_solicitud_pqrsf", "fecha_cierre_caso"}
    got = dict(rows(plans.consolidated(tables, **ONE_ROW).where("numero_servicio = 1002"),
                    *sorted(closed, reverse=True)))
    assert got == {11: ts("2023-07-10")}


def test_unknown_choices_are_refused(tables):
    for wrong in ({"name_fallback": "x"}, {"closing": "x"}, {"match": "x"}):
        with pytest.raises(ValueError):
            plans.consolidated(tables, **{**ONE_ROW, **wrong})


def test_forms_agree_without_ties(spark, tables):
    log = tables["aus_seguimientos"].where("id <> 3")
    same = {**KEEP_TIES, "min_year": 2021}
    untied = {**tables, "aus_seguimientos": log}
    ties = plans.consolidated(untied, **same, as_of=AS_OF)
    one = plans.consolidated(untied, **{**same, "closing": "one"}, as_of=AS_OF)
    assert rows(ties) == rows(one)


def test_location_role(tables):
    place = plans.consolidated(tables, **ONE_ROW, location_role="membership")
    assert place.where("numero_servicio = 1000").first().cod_divipola_afiliacion == "05088"


def test_case_detail_with_unknown_times_ignored(tables):
    detail = plans.case_detail(tables, unknown_time="ignore")
    assert detail.where("numero_servicio = 1000").first().fecha_asignacion_servicio == ts(
        "2023-03-06")


# Wide detail ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def wide(tables):
    rows = plans.wide_detail(tables, as_of=AS_OF).cache()
    yield rows
    rows.unpersist()


def test_wide_rows(wide):
    # All case types count, and the document alone finds members of both types.
    assert rows(wide.groupBy("numero_solicitud_pqrsf").count()) == [
        ("10", 2), ("11", 4), ("12", 1), ("15", 1), ("16", 1), ("17", 1), ("19", 1)]


def test_wide_attributes(wide):
    first = wide.where("numero_solicitud_pqrsf = '10' and medicamento = 'NO'").first()
    assert (first.Edad_actual, first.riesgo_vida) == (40, "Peticion general")
    assert (first.mpio_afiliacion, first.region_afiliacion) == ("MEDELLIN", "VALLE DE ABURRA")
    assert (first.cod_pqrd, first.municipio_pqrd) == ("05001", "Medellín")
    # Each deletion brings two spaces together, and those go last.
    assert first.IPS_responsable_respuesta == "ANARUIZPAZ"
    assert first.nit_responsable_respuesta == "U5"
    assert first.fecha_cierre_servicio == ts("2023-03-15")
    assert first.motivo_especifico == "Demora"
    other = wide.where("numero_solicitud_pqrsf = '10' and medicamento is null").first()
    # No assigned user: the service's own text and the provider with the site's id.
    assert (other.IPS_responsable_respuesta, other.nit_responsable_respuesta) == (
        "SEDE UNO", "NIT50")
    alone = wide.where("numero_solicitud_pqrsf = '17'").first()
    assert (alone.discapacidad_afectado, alone.cod_pqrd, alone.municipio_pqrd) == (
        "SI", None, "Suelto")
    reasons = rows(wide.where("numero_solicitud_pqrsf = '11'"), "motivo_especifico",
                   "servicio_atribuido_ips", "cod_divipola_afiliacion", "mpio_afiliacion")
    assert reasons == [("Costo", "No aplica", "05001", "MEDELLIN"),
                       ("Costo", "No aplica", None, "MEDELLIN"),
                       ("Costo", "SI", "05001", "MEDELLIN"),
                       ("Costo", "SI", None, "MEDELLIN")]
    assert {r[0] for r in rows(wide, "riesgo_vida")} == {"Peticion general", "Simple", "Vital"}


def test_wide_provider_key(tables):
    other = plans.wide_detail(tables, provider_key="foreign_key").where(
        "numero_solicitud_pqrsf = '10' and medicamento is null").first()
    assert other.nit_responsable_respuesta == "NIT7"
    with pytest.raises(ValueError):
        plans.wide_detail(tables, provider_key="name")


def test_wide_distinct_needs_no_shuffle_of_its_own(spark, tables):
    # The plan of a report, and not that of a cached copy of it.
    spark.catalog.clearCache()
    plan = plan_of(plans.wide_detail(tables, as_of=AS_OF))
    above_join = plan[:plan.index("SortMergeJoin")]
    assert "HashAggregate" in above_join and "Exchange" not in above_join


def shuffled(node):
    """The columns of each shuffle of a plan."""
    children = node.children()
    found = [c for i in range(children.size()) for c in shuffled(children.apply(i))]
    if node.nodeName() == "Exchange":
        output = node.output()
        found.append([output.apply(i).name() for i in range(output.size())])
    return found


def test_wide_texts_are_moved_once_and_packed(spark, tables):
    spark.catalog.clearCache()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        detail = plans.wide_detail(tables, as_of=AS_OF)
        moved = shuffled(detail._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # The rows of services go by case once; by service go ids only.
    assert [c for c in moved if "_service" in c] == [
        ["case_id", "_right_part", "service_id", "_service", "_service_as_is",
         "fecha_cierre_servicio"]]
    texts = {"ma_tecnologia_valor", "descripcion_servicio_pqrd", "mae_servicio_motivo_valor",
             "service_reason", "radicado", "radicado_SNS", "estado_caso"}
    assert not [c for c in moved if texts.intersection(c)]


def test_wide_detail_of_odd_services(spark, tables):
    """Services without an id or a case, repeated ones, and cases that repeat or have no id."""
    services, cases = tables["aus_caso_servicios"], tables["aus_casos"]
    no_id = services.where("aus_casos_id = 10").withColumn("id", F.lit(None).cast("long"))
    no_case = services.withColumn("aus_casos_id", F.lit(None).cast("long"))
    unnamed = cases.where("id IN (10, 12)").withColumn("id", F.lit(None).cast("long"))
    odd = {**tables, "aus_caso_servicios": services.union(services).union(no_id).union(no_case),
           "aus_casos": cases.union(cases).union(unnamed)}
    got = plans.wide_detail(odd, as_of=AS_OF).drop("numero_solicitud_pqrsf")
    plain = plans.wide_detail(tables, as_of=AS_OF).where("numero_solicitud_pqrsf IS NOT NULL")
    assert set(rows(plain.drop("numero_solicitud_pqrsf"))) <= set(rows(got))
    per_case = rows(plans.wide_detail(odd, as_of=AS_OF).groupBy("numero_solicitud_pqrsf").count())
    # Without an id a service has no known closing time, which one of the two of case 10 has not
    # either; a case without an id has no services.
    assert per_case == sorted([("10", 3), ("11", 4), ("12", 1), ("15", 1), ("16", 1), ("17", 1),
                               ("19", 1), (None, 2)], key=repr)


# Monthly tracking ----------------------------------------------------------------------

def test_tracking(tables):
    got = rows(plans.monthly_tracking(tables), "anio", "mes", "grupo_caso", "origen",
               "documento", "municipio_afiliacion", "region_afiliacion", "Nro_pqrd")
    regulator, other = "Supersalud", "Otros canales"
    assert got == sorted([
        (2023, 3, "1-Creados", regulator, "100", "Bello", "Norte", 1),
        (2023, 5, "1-Creados", other, "200", "Suelto", "VALLE DE ABURRA", 1),
        (2023, 5, "1-Creados", other, "200", "Medellín", "VALLE DE ABURRA", 1),
        (2024, 2, "1-Creados", regulator, "300", None, None, 1),
        (2024, 3, "1-Creados", regulator, None, None, None, 1),
        (2023, 12, "1-Creados", regulator, "600", None, None, 1),
        (2023, 3, "2-Cerrado el mismo mes", regulator, "100", "Bello", "Norte", 1),
        (2023, 7, "3-Cerrado meses anteriores", other, "200", "Suelto", "VALLE DE ABURRA", 1),
        (2023, 7, "3-Cerrado meses anteriores", other, "200", "Medellín", "VALLE DE ABURRA", 1),
        # Created before the first year, closed in scope.
        (2022, 1, "3-Cerrado meses anteriores", regulator, "200", "Medellín",
         "VALLE DE ABURRA", 1),
        (2024, 2, "4-Abiertos", regulator, "300", None, None, 1),
        (2023, 12, "4-Abiertos", regulator, "600", None, None, 1),
    ], key=repr)


def test_tracking_closed_segments_are_disjoint(tables):
    out = plans.monthly_tracking(tables)
    closed = out.where("grupo_caso like '2-%' or grupo_caso like '3-%'")
    keys = [c for c in out.columns if c not in ("grupo_caso", "Nro_pqrd")]
    assert closed.count() == closed.select(keys).distinct().count()


def test_tracking_display_names(tables):
    from caseflow.functions import with_labels

    assert with_labels(plans.monthly_tracking(tables), {"anio": "año"}).columns[0] == "año"


def test_tracking_years(tables):
    bounded = plans.monthly_tracking(tables, other_month_created_years=[2023],
                                     open_years=[2024, 2025])
    tags = rows(bounded.groupBy("grupo_caso").agg(F.sum("Nro_pqrd")))
    assert tags == [("1-Creados", 6), ("2-Cerrado el mismo mes", 1),
                    ("3-Cerrado meses anteriores", 2), ("4-Abiertos", 1)]


def test_tracking_counts_member_rows_or_cases(tables, spark):
    twice = {**tables, "aseg_afiliados": tables["aseg_afiliados"].union(
        tables["aseg_afiliados"])}

    def total(**more):
        out = plans.monthly_tracking(twice, **more).where("documento = '100'")
        return rows(out.groupBy("grupo_caso").agg(F.sum("Nro_pqrd")))

    assert total() == [("1-Creados", 2), ("2-Cerrado el mismo mes", 2)]
    assert total(count_distinct_cases=True) == [("1-Creados", 1), ("2-Cerrado el mismo mes", 1)]


# Productivity --------------------------------------------------------------------------

def test_productivity(tables):
    got = rows(plans.productivity(tables, min_year=2023), "id_caso", "id", "grupo", "usuario",
               "estado_caso_servicio", "estado_interaccion", "fecha_interaccion",
               "interacciones")
    cases = [r for r in got if r[2] == "Casos"]
    assert [r[:2] for r in cases] == [(10, 1), (10, 2), (10, 3), (11, 5), (11, 6), (12, 9)]
    services = [r for r in got if r[2] == "Servicios"]
    assert sum(r[-1] for r in services) == 8
    # Two entries of one service at one time by one user count together.
    assert (11, 1002, "Servicios", "g2", "Abierto", "Resuelto", ts("2024-05-12"), 2) in services
    one = plans.productivity(tables).first()
    assert (one.responsable_caso, one.region) == ("LUIS", "VALLE DE ABURRA")
    assert one.fecha_interaccion.year == 2024


# Contracts, members, authorisations, history -------------------------------------------

def test_contract_tariffs(tables):
    got = rows(plans.contract_tariffs(tables), "contrato", "numero_documento",
               "Desctipo_tecnologia", "codigo_tecnologia", "nombre",
               "mae_modalidad_contrato_valor")
    assert got == [
        ("C1", "NIT7", "Insumo", "I1", "Medellín", "EVENTO"),
        ("C1", "NIT7", "Medicamento", "M1", "Medellín", "EVENTO"),
        ("C1", "NIT7", "Tecnologia", "T1", "Medellín", "EVENTO"),
        ("C1", "NIT7", "Tecnologia", "T2", "Medellín", "EVENTO"),
        ("C2", None, "Paquete", "P1", "Bello", "CAPITA"),
    ]


def test_contract_network(tables):
    got = rows(plans.contract_network(tables), "contrato", "Desctipo_tecnologia",
               "ma_servicio_habilitacion_codigo", "mae_region_valor")
    assert got == [("C1", "Tecnologia", "H1", "MEDELLIN"), ("C2", "Paquete", "H1", "Norte")]


def test_members(tables):
    assert rows(plans.members_by_municipality(tables)) == [("05088", 2), (None, 2)]
    assert rows(plans.members_by_municipality(tables, collation="binary")) == [
        ("05088", 2), (None, 1)]
    home = plans.members_by_municipality(tables, location_role="residence")
    assert rows(home) == [("05001", 3), (None, 1)]


def test_authorizations(tables):
    got = plans.authorization_wait(tables)
    classes = dict(rows(got.where("ma_tecnologia_codigo = '890208'"), "numero_autorizacion",
                        "subregion_ant"))
    expected = ["Valle de Aburrá", "Oriente", "Norte", "Nordeste", "Occidente", "Suroeste",
                "Bajo Cauca", "Magdalena Medio", "Urabá", "SIN CLASIFICAR", "SIN CLASIFICAR",
                "Valle de Aburrá"]
    assert classes == {**{f"A{i}": c for i, c in enumerate(expected)}, "A90": "Valle de Aburrá"}
    assert got.count() == len(MUNICIPALITIES) + 2
    waits = dict(rows(got, "numero_autorizacion", "dias_espera"))
    assert (waits["A0"], waits["A90"]) == (9, -1)
    exact = plans.authorization_wait(tables, collation="binary")
    assert exact.where("numero_autorizacion = 'A11'").first().subregion_ant == "SIN CLASIFICAR"


def test_last_day_of_a_timestamp_period(tables):
    requests = tables["au_anexos3"].withColumn(
        "fecha_solicitud", F.col("fecha_solicitud").cast("timestamp_ntz")
        + F.when(F.col("id") == 2, F.expr("INTERVAL '10' HOUR")).otherwise(
            F.expr("INTERVAL '0' HOUR")))
    late = {**tables, "au_anexos3": requests}
    assert plans.authorization_wait(late).where("numero_autorizacion = 'A90'").count() == 0
    whole = plans.authorization_wait(late, inclusive_end=True)
    assert whole.where("numero_autorizacion = 'A90'").count() == 1


def test_history(tables):
    feeds = plans.feed_history(tables, "555")
    assert {name: df.count() for name, df in feeds.items()} == {
        "consulta": 1, "urgencia": 1, "hospitalizacion": 1, "procedimiento": 0}
    assert feeds["consulta"].first().codigo_consulta == "C1"
    urgent = feeds["urgencia"].first()
    assert urgent.causa_externa == urgent.causa_muerte == "Caida"
    labelled = plans.feed_history(tables, "A55", labels=True)
    assert labelled["consulta"].columns == list(FEEDS["consulta"].labels.values())
    assert labelled["consulta"].columns[0] == "Código prestador"
    assert labelled["consulta"].count() == 1


def test_timeline(tables):
    got = plans.person_history(tables, "555")
    assert rows(got, "origen", "fecha", "codigo_consulta", "estado_salida") == [
        ("consulta", dt.date(2010, 1, 1), "C1", None),
        ("hospitalizacion", dt.date(2017, 6, 1), None, "Vivo"),
        ("urgencia", dt.date(2015, 1, 1), None, None),
    ]
    assert "EqualTo(documento_afiliado,555)" in plan_of(got)
