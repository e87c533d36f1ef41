"""The widest case detail: demographics, places, milestones and cleansed names."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions import (
    BINARY,
    DEFAULT_COLLATION,
    age_years,
    cleanse_text,
    collation_class,
    decode,
    geo_code,
    period_filter,
    plain_class,
)
from caseflow.operators import (
    distinct_rows,
    flatten_hierarchy,
    hot_keys,
    join_parts,
    keep_marked,
    key_marks,
    lookup,
    milestones,
    pack_texts,
    plain_key,
    skew_join,
    unpack_texts,
    with_copies,
    with_parts,
)
from caseflow.plans import common
from caseflow.plans.common import Tables

TABLES = ["aus_casos", "aus_caso_servicios", "aus_seguimientos", "aus_servicio_gestiones",
          "aus_personas", "aseg_afiliados", "gn_ubicaciones", "gn_usuarios",
          "cnt_prestadores", "cnt_prestador_sedes"]

# Strings deleted from names, in this order.
NAME_REMOVALS = [";", ",", "\r", "\n", "\t", '"', "&quot", "\r\n", "\n", "\t", "", "  "]
# Flag codes; any other code has no label.
YES_NO = {0: "NO", 1: "SI"}
ATTRIBUTED = {0: "NO", 1: "SI", 3: "No aplica"}

# What a row shows of its case, its person and its service alone. Texts of one kind are moved
# as one and, under the default collation, folded as one.
CASE_TEXTS = ["radicado_SNS", "cod_pqrd", "municipio_pqrd", "riesgo_vida", "estado_caso",
              "origen_pqrd", "tipo_solicitud", "ente_control", "case_reason",
              "tipo_motivo_especifico", "subtipo_motivo_especifico", "reabierto_Supersalud"]
PERSON_TEXTS = ["tipo_identificacion_afectado", "identificacion_afectado", "genero_afectado",
                "estado_afiliacion", "regimen_afiliacion", "grupo_poblacional",
                "discapacidad_afectado", "cod_divipola_afiliacion", "mpio_afiliacion",
                "region_afiliacion"]
SERVICE_TEXTS = ["medicamento", "servicio_atribuido_ips", "nit_responsable_respuesta",
                 "IPS_responsable_respuesta", "ambito_servicio", "codigo_servicio_pqrd",
                 "descripcion_servicio_pqrd"]
COLUMNS = ["tipo_identificacion_afectado", "identificacion_afectado",
           "fecha_nacimiento_afectado", "Edad_actual", "genero_afectado", "estado_afiliacion",
           "regimen_afiliacion", "grupo_poblacional", "discapacidad_afectado",
           "cod_divipola_afiliacion", "mpio_afiliacion", "region_afiliacion", "cod_pqrd",
           "municipio_pqrd", "numero_solicitud_pqrsf", "radicado_SNS", "fecha_creacion_caso",
           "riesgo_vida", "estado_caso", "origen_pqrd", "tipo_solicitud", "ente_control",
           "motivo_especifico", "tipo_motivo_especifico", "subtipo_motivo_especifico",
           "fecha_cierre_caso", "cantidad_servicios", "medicamento", "servicio_atribuido_ips",
           "nit_responsable_respuesta", "IPS_responsable_respuesta", "ambito_servicio",
           "fecha_cierre_servicio", "codigo_servicio_pqrd", "descripcion_servicio_pqrd",
           "reabierto_Supersalud"]

PROVIDER_KEYS = ("site_id", "foreign_key")


def wide_detail(
    tables: Tables,
    min_year: int = 2023,
    as_of: str | dt.date | None = None,
    year_days: float = 365.2,
    match: str = "document",
    provider_key: str = "site_id",
    collation: str = DEFAULT_COLLATION,
    unknown_time: str = "first",
    reduce_first: bool = False,
    grouping: str | None = None,
) -> DataFrame:
    """Distinct rows of live cases, their person, places and services.

    Rows are distinct under ``grouping``, which is ``collation`` unless given: texts that it
    holds equal make one row, with the smallest spelling of each.

    Joins that could add no column to a distinct result (phones, unread statuses, the
    responsible user) are left out. ``provider_key`` takes the provider either by the
    service's site id or through the site's foreign key. ``unknown_time`` and
    ``reduce_first`` are those of ``case_detail``.
    """
    if provider_key not in PROVIDER_KEYS:
        raise ValueError(f"provider_key must be one of {PROVIDER_KEYS}, not {provider_key!r}")
    grouping = collation if grouping is None else grouping
    cases = common.live_cases(tables, exclude_types=False)
    cases = cases.where(period_filter(F.col("fecha_hora_crea"), min_year=min_year))
    places = flatten_hierarchy(tables["gn_ubicaciones"], "id", "gn_ubicaciones_id",
                               ["prefijo", "nombre", "descripcion", "mae_region_valor"])

    hot = hot_keys(
        tables["aus_caso_servicios"].select(F.col("aus_casos_id").alias("case_id")), ["case_id"])
    if reduce_first:
        tables = common.reduced(tables, cases)
    else:
        # The services are the widest of what is moved, so those of other cases stay behind.
        tables = {**tables, "aus_caso_servicios": keep_marked(
            tables["aus_caso_servicios"], "aus_casos_id", key_marks(cases, "id"))}
    # Each attribute is computed at its own grain; the last step only renames and picks.
    detail = pack_texts(_cases(cases, places, tables, collation), CASE_TEXTS, "_case")
    detail = _with_persons(detail, tables, places, match, as_of, year_days, collation)
    services = _services(tables, hot, grouping)
    times = _closing_times(services, tables, collation, unknown_time)
    services = _dated(_named(services, tables, provider_key), times)

    # Cases, services and closings lie by case and part from here on.
    on = ["case_id", "_right_part"]
    detail = pack_texts(detail, PERSON_TEXTS, "_person")
    detail = with_copies(detail, ["case_id"], hot).repartition(*on)
    detail = unpack_texts(unpack_texts(detail, CASE_TEXTS, "_case"), PERSON_TEXTS, "_person")
    keys = {}
    if grouping.upper() == DEFAULT_COLLATION:
        keys = {"_case_key": [c for c in CASE_TEXTS if c != "case_reason"] + PERSON_TEXTS,
                "_service_key": SERVICE_TEXTS}
        detail = plain_key(detail, keys["_case_key"], "_case_key")
        services = plain_key(services, SERVICE_TEXTS, "_service_key")
    closed = common.case_closings(tables, "one", collation, "fecha_cierre_caso")
    closed = with_copies(closed.withColumnRenamed("aus_casos_id", "case_id"), ["case_id"], hot)
    rows = join_parts(detail, services, ["case_id"])
    rows = rows.join(closed.drop("_right_parts"), on, "left")

    rows = rows.withColumn("motivo_especifico", F.coalesce("case_reason", "service_reason"))
    rows = rows.withColumnRenamed("case_id", "numero_solicitud_pqrsf")
    # Distinct while the rows lie by case id and part, and sorted by these first, so that no
    # further shuffle is needed: equal rows have the same part. Only then is the id made text.
    shown = [c for c in COLUMNS if c != "numero_solicitud_pqrsf"]
    rows = rows.select("numero_solicitud_pqrsf", "_right_part", *shown, *keys)
    return distinct_rows(rows, grouping, alike=keys).withColumn(
        "numero_solicitud_pqrsf", F.col("numero_solicitud_pqrsf").cast("string")).select(*COLUMNS)


def _alike(texts: list[str], grouping: str) -> list[Column]:
    """The same values for all that DISTINCT holds equal."""
    if grouping.upper() == DEFAULT_COLLATION:
        return [plain_class(texts)]
    return [F.col(c) if grouping == BINARY else collation_class(F.col(c), grouping)
            for c in texts]


def _cases(cases, places, tables, collation) -> DataFrame:
    placed = lookup(cases, places, "gn_ubicaciones_id", "id",
                    {"prefix": "prefijo", "parent_prefix": "parent_prefijo",
                     "municipio_pqrd": "nombre"},
                    sized_by=[tables["gn_ubicaciones"]])
    return placed.select(
        F.col("id").alias("case_id"),
        F.col("aus_personas_id").alias("person_id"),
        F.col("radicado").alias("radicado_SNS"),
        geo_code(F.col("parent_prefix"), F.col("prefix")).alias("cod_pqrd"),
        "municipio_pqrd",
        F.col("fecha_hora_crea").alias("fecha_creacion_caso"),
        decode(F.col("mae_solicitud_riesgo_vidal_valor"), common.LIFE_RISK, keep_other=True,
               collation=collation).alias("riesgo_vida"),
        F.col("mae_solicitud_estado_valor").alias("estado_caso"),
        F.col("mae_solicitud_origen_valor").alias("origen_pqrd"),
        F.col("mae_solicitud_tipo_valor").alias("tipo_solicitud"),
        F.col("mae_solicitud_ente_contro_valor").alias("ente_control"),
        F.col("mae_motivo_especifico_valor").alias("case_reason"),
        F.col("mae_tipo_motivo_especifico_valor").alias("tipo_motivo_especifico"),
        F.col("mae_subtipo_motivo_especifico_valor").alias("subtipo_motivo_especifico"),
        "cantidad_servicios",
        common.reopened_by_regulator(collation).alias("reabierto_Supersalud"),
    )


def _with_persons(detail, tables, places, match, as_of, year_days, collation) -> DataFrame:
    # Members that agree in every column read are rare, and the result is distinct anyway.
    members = tables["aseg_afiliados"].select(
        "numero_documento",
        F.col("mae_tipo_documento_codigo").alias("member_tipo"),
        "fecha_nacimiento",
        "mae_genero_codigo",
        F.col("mae_estado_afiliacion_valor").alias("estado_afiliacion"),
        F.col("mae_regimen_valor").alias("regimen_afiliacion"),
        F.col("mae_grupo_poblacional_valor").alias("grupo_poblacional"),
        F.col("discapacidad").alias("member_disability"),
        "residencia_ubicacion_id",
    )
    matched = common.with_members(detail, tables, "person_id", {
        "tipo_documento": "mae_tipo_documento_codigo", "documento": "documento",
        "mae_sexo_codigo": "mae_sexo_codigo", "person_disability": "discapacidad",
    }, members, match, collation)
    placed = lookup(matched, places, "residencia_ubicacion_id", "id",
                    {"prefix": "prefijo", "parent_prefix": "parent_prefijo",
                     "municipality": "descripcion", "region": "mae_region_valor"},
                    sized_by=[tables["gn_ubicaciones"]])
    known = common.disability(F.col("member_disability"), F.col("person_disability"))
    return placed.select(
        *[c for c in detail.columns if c != "person_id"],
        F.col("tipo_documento").alias("tipo_identificacion_afectado"),
        F.col("documento").alias("identificacion_afectado"),
        F.col("fecha_nacimiento").alias("fecha_nacimiento_afectado"),
        age_years(F.col("fecha_nacimiento"), as_of, year_days).alias("Edad_actual"),
        F.coalesce("mae_sexo_codigo", "mae_genero_codigo").alias("genero_afectado"),
        "estado_afiliacion", "regimen_afiliacion", "grupo_poblacional",
        # A case without a person counts as unknown too.
        known.alias("discapacidad_afectado"),
        geo_code(F.col("parent_prefix"), F.col("prefix")).alias("cod_divipola_afiliacion"),
        common.municipality_name(F.col("municipality"), collation).alias("mpio_afiliacion"),
        common.region_name(F.col("region"), collation).alias("region_afiliacion"),
    )


def _services(tables, hot, grouping) -> DataFrame:
    """Services and their part of the case. A hot case is split by what its rows show of the
    service itself, so that rows that are equal in all they show meet."""
    services = tables["aus_caso_servicios"].select(
        F.col("aus_casos_id").alias("case_id"),
        F.col("id").alias("service_id"),
        "gn_usuarios_asignado_id",
        "cnt_prestador_sede_destino_id",
        "cnt_prestador_sede_destino_valor",
        F.col("mae_servicio_motivo_valor").alias("service_reason"),
        decode(F.col("medicamento"), YES_NO).alias("medicamento"),
        decode(F.col("servicio_atribuido_ips"), ATTRIBUTED).alias("servicio_atribuido_ips"),
        F.col("mae_servicio_ambito_valor").alias("ambito_servicio"),
        F.col("ma_tecnologia_codigo").alias("codigo_servicio_pqrd"),
        F.col("ma_tecnologia_valor").alias("descripcion_servicio_pqrd"),
    )
    own = [c for c in SERVICE_TEXTS if c in services.columns]
    return with_parts(services, ["case_id"], hot, _alike(own, grouping))


def _closing_times(services, tables, collation, unknown_time) -> DataFrame:
    """Closing times by case, part and service, where one is known.

    Only ids are moved to meet the log and come back with a time, so that the texts of a
    service are moved once.
    """
    reached = milestones(tables["aus_servicio_gestiones"], "aus_servicios_id",
                         "mae_estado_valor", "fecha_hora_crea",
                         {"Cerrado": "closed_at", "Resuelto": "solved_at"},
                         collation=collation, unknown=unknown_time)
    time = F.coalesce("closed_at", "solved_at").alias("fecha_cierre_servicio")
    reached = reached.select(F.col("aus_servicios_id").alias("service_id"), time)
    times = skew_join(services.select("service_id", "case_id", "_right_part"),
                      reached.where("fecha_cierre_servicio IS NOT NULL"), ["service_id"], "inner")
    # Repeated services need it once; they lie by their id, so this is no shuffle.
    return times.distinct()


def _named(services, tables, provider_key) -> DataFrame:
    """The services with who answers for them."""
    users = tables["gn_usuarios"].select(
        "id", "documento", cleanse_text(F.col("nombre"), NAME_REMOVALS).alias("nombre"))
    detail = common.add_users(services, {"gn_usuarios": users}, "gn_usuarios_asignado_id",
                              {"user_name": "nombre", "user_document": "documento"})
    providers, sizes = tables["cnt_prestadores"].select("id", "numero_documento"), None
    if provider_key == "foreign_key":
        sites = tables["cnt_prestador_sedes"].select("id", "cnt_prestador_id")
        sizes = [sites, providers]
        providers = lookup(sites, providers, "cnt_prestador_id", "id", ["numero_documento"])
    detail = lookup(detail, providers, "cnt_prestador_sede_destino_id", "id",
                    {"provider_document": "numero_documento"},
                    sized_by=sizes)
    site = cleanse_text(F.col("cnt_prestador_sede_destino_valor"), NAME_REMOVALS)
    return detail.select(
        "case_id", "_right_part", "service_id", "service_reason", "medicamento",
        "servicio_atribuido_ips",
        F.coalesce("user_document", "provider_document").alias("nit_responsable_respuesta"),
        F.coalesce("user_name", site).alias("IPS_responsable_respuesta"),
        "ambito_servicio", "codigo_servicio_pqrd", "descripcion_servicio_pqrd",
    )


def _dated(services, times) -> DataFrame:
    """The services with their closing time, laid out by case and part."""
    on, texts = ["case_id", "_right_part"], ["service_reason", *SERVICE_TEXTS]
    packed = pack_texts(services, texts, "_service")
    both = packed.unionByName(times, allowMissingColumns=True).repartition(*on)
    of_one = Window.partitionBy(*on, "service_id")
    dated = both.withColumn(
        "fecha_cierre_servicio", F.max("fecha_cierre_servicio").over(of_one))
    dated = dated.where("_service IS NOT NULL OR _service_as_is IS NOT NULL")
    return unpack_texts(dated.drop("service_id"), texts, "_service")
