"""Consolidated case report, keeping tied closings or one closing per case."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions import (
    DEFAULT_COLLATION,
    age_years,
    cleanse_text,
    coalesce_milestones,
    decode,
    geo_code,
    period_filter,
    simple_upper,
)
from caseflow.operators import flatten_hierarchy, lookup, milestones
from caseflow.plans import common
from caseflow.plans.common import Tables

TABLES = ["aus_casos", "aus_caso_servicios", "aus_seguimientos", "aus_servicio_gestiones",
          "aus_personas", "aseg_afiliados", "gn_ubicaciones", "gn_usuarios",
          "cnt_prestadores", "cnt_prestador_sedes"]

# Strings deleted from site names, in this order.
SHORT_REMOVALS = [";", ",", "\r", "\n"]
LONG_REMOVALS = [";", ",", "\r", "\n", "\t", '"', "&quot", "\r\n", "\n"]

# The two forms in which the report is issued.
KEEP_TIES: dict[str, Any] = {
    "closing": "all", "min_year": 2024, "provider_key": "id", "name_fallback": "empty",
    "removals": SHORT_REMOVALS, "with_modified": True,
}
ONE_ROW: dict[str, Any] = {
    "closing": "one", "min_year": 2022, "provider_key": "cnt_prestador_id",
    "name_fallback": "service", "removals": LONG_REMOVALS, "with_modified": False,
}

NAME_FALLBACKS = ("empty", "service")

_CASE_DATES = ("fecha_cierre", "fecha_resuelto", "fecha_cerrado")
_SOLUTION_DATES = ("fecha_cerrado", "fecha_resuelto")


def consolidated(
    tables: Tables,
    closing: str = "one",
    min_year: int = 2022,
    provider_key: str = "cnt_prestador_id",
    name_fallback: str = "service",
    removals: Sequence[str] = tuple(LONG_REMOVALS),
    with_modified: bool = False,
    as_of: str | dt.date | None = None,
    year_days: float = 365.25,
    match: str = "strict",
    location_role: str = "residence",
    collation: str = DEFAULT_COLLATION,
    reduce_first: bool = False,
) -> DataFrame:
    """One row per case, member row and service, created in ``min_year`` or later.

    ``closing='all'`` repeats a case for every closing entry that shares the last time;
    ``'one'`` does not. ``provider_key`` is the site column that leads to the provider.
    Where a site has no name, ``name_fallback`` gives an empty one or the text held on
    the service. ``location_role`` chooses the residence or the membership place for
    municipality and code; the region always comes from the membership.
    ``reduce_first`` cuts services, logs and persons to the kept cases before they are
    worked on, which pays where ``min_year`` keeps a small part of the cases.
    ``consolidated(tables, **KEEP_TIES)`` and ``**ONE_ROW`` are the two issued forms.
    """
    if name_fallback not in NAME_FALLBACKS:
        raise ValueError(f"name_fallback must be one of {NAME_FALLBACKS}, not {name_fallback!r}")
    # Each attribute is computed at its own grain (user, site, case, person, service); the
    # last step, which sees every pair, only renames and picks.
    tables = {**tables, "gn_usuarios": tables["gn_usuarios"].withColumn(
        "nombre", simple_upper(F.col("nombre")))}
    recent = period_filter(F.col("fecha_hora_crea"), min_year=min_year)
    cases = common.live_cases(tables).where(recent)
    if reduce_first:
        tables = common.reduced(tables, cases)
    detail = _cases(cases, with_modified, collation)
    # The user is an attribute of the case, so it is looked up before persons repeat cases.
    detail = common.add_users(detail, tables, "gn_usuarios_responsable_id",
                              {"responsable_caso": "nombre"})
    closed = common.case_closings(tables, closing, collation, "fecha_cierre")
    detail = common.attach(detail, closed, "case_id", "aus_casos_id")
    detail = _with_persons(detail, tables, match, location_role, as_of, year_days, collation)
    services = _services(tables, provider_key, name_fallback, removals, collation)
    detail = common.with_services(detail, services, "case_id", tables)

    dates = {n: F.col(n) for n in (*_CASE_DATES, "fecha_asignado")}
    return detail.select(
        F.col("case_id").alias("numero_solicitud_pqrsf"),
        F.col("radicado").alias("radicado_SNS"),
        F.col("service_id").alias("numero_servicio"),
        F.col("tipo_documento").alias("tipo_identificacion_afectado"),
        F.col("documento").alias("identificacion_afectado"),
        F.col("fecha_nacimiento").alias("fecha_nacimiento_afectado"),
        "edad",
        "genero_afectado",
        "estado_afiliacion",
        "regimen_afiliacion",
        "grupo_poblacional",
        "discapacidad_afectado",
        "cod_divipola_afiliacion",
        "mpio_afiliacion",
        "region_afiliacion",
        "fecha_creacion_caso",
        coalesce_milestones(dates, _CASE_DATES).alias("fecha_cierre_caso"),
        "reabierto_supersalud",
        "estado_caso",
        "riesgo_de_vida",
        "origen_pqrs",
        "tipo_solicitud",
        "ente_control",
        "estado_servicio",
        "cod_servicio",
        "des_servicio",
        F.col("fecha_asignado").alias("fecha_asignacion_servicio"),
        coalesce_milestones(dates, _SOLUTION_DATES).alias("fecha_solucion_servicio"),
        *(["fecha_modificacion_caso"] if with_modified else []),
        # A case without a service has no flags recorded, hence the default label.
        F.coalesce("medicamento", F.lit("NO")).alias("medicamento"),
        F.coalesce("servicio_atribuido_ips", F.lit("NO")).alias("servicio_atribuido_ips"),
        "responsable_caso",
        "usuario_asignado_servicio",
        "IPS_responsable_respuesta",
        "nit_responsable_respuesta",
    )


def _cases(cases: DataFrame, with_modified: bool, collation: str) -> DataFrame:
    modified = [F.col("fecha_hora_modifica").alias("fecha_modificacion_caso")]
    return cases.select(
        F.col("id").alias("case_id"),
        F.col("aus_personas_id").alias("person_id"),
        "gn_usuarios_responsable_id",
        "radicado",
        F.col("fecha_hora_crea").alias("fecha_creacion_caso"),
        common.reopened_by_regulator(collation).alias("reabierto_supersalud"),
        decode(F.col("mae_solicitud_estado_valor"), common.CASE_STATES, keep_other=True,
               collation=collation).alias("estado_caso"),
        F.col("mae_solicitud_riesgo_vidal_valor").alias("riesgo_de_vida"),
        F.col("mae_solicitud_origen_valor").alias("origen_pqrs"),
        F.col("mae_solicitud_tipo_valor").alias("tipo_solicitud"),
        F.col("mae_solicitud_ente_contro_valor").alias("ente_control"),
        *(modified if with_modified else []),
    )


def _with_persons(detail, tables, match, location_role, as_of, year_days,
                  collation) -> DataFrame:
    home = {"residence": "residencia_ubicacion_id",
            "membership": "afiliacion_ubicaciones_id"}[location_role]
    members = tables["aseg_afiliados"].select(
        "numero_documento",
        F.col("mae_tipo_documento_codigo").alias("member_tipo"),
        "fecha_nacimiento",
        "mae_genero_codigo",
        F.col("mae_estado_afiliacion_valor").alias("estado_afiliacion"),
        F.col("mae_regimen_valor").alias("regimen_afiliacion"),
        F.col("mae_grupo_poblacional_valor").alias("grupo_poblacional"),
        F.col("discapacidad").alias("member_disability"),
        F.col(home).alias("home_id"),
        F.col("afiliacion_ubicaciones_id").alias("membership_id"),
    )
    matched = common.with_members(detail, tables, "person_id", {
        "tipo_documento": "mae_tipo_documento_codigo", "documento": "documento",
        "mae_sexo_codigo": "mae_sexo_codigo", "person_disability": "discapacidad",
        "known_person": "id",
    }, members, match, collation)
    places = flatten_hierarchy(tables["gn_ubicaciones"], "id", "gn_ubicaciones_id",
                               ["prefijo", "descripcion"])
    placed = lookup(matched, places, "home_id", "id",
                    {"prefix": "prefijo", "parent_prefix": "parent_prefijo",
                     "municipality": "descripcion"},
                    sized_by=[tables["gn_ubicaciones"]])
    placed = lookup(placed, tables["gn_ubicaciones"], "membership_id", "id",
                    {"region": "mae_region_valor"})
    return placed.select(
        *detail.columns, "tipo_documento", "documento", "fecha_nacimiento",
        age_years(F.col("fecha_nacimiento"), as_of, year_days).alias("edad"),
        F.coalesce("mae_sexo_codigo", "mae_genero_codigo").alias("genero_afectado"),
        "estado_afiliacion", "regimen_afiliacion", "grupo_poblacional",
        # A case without a person says nothing of one.
        F.when(F.col("known_person").isNotNull(), common.disability(
            F.col("member_disability"), F.col("person_disability")))
        .alias("discapacidad_afectado"),
        geo_code(F.col("parent_prefix"), F.col("prefix")).alias("cod_divipola_afiliacion"),
        common.municipality_name(F.col("municipality"), collation).alias("mpio_afiliacion"),
        simple_upper(common.region_name(F.col("region"), collation)).alias("region_afiliacion"),
    )


def _services(tables, provider_key, name_fallback, removals, collation) -> DataFrame:
    services = tables["aus_caso_servicios"]
    reached = milestones(tables["aus_servicio_gestiones"], "aus_servicios_id",
                         "mae_estado_valor", "fecha_hora_crea", common.SERVICE_STATES,
                         collation=collation)
    detail = services.withColumnsRenamed({"id": "service_id", "aus_casos_id": "case_id"})
    detail = common.attach(detail, reached, "service_id", "aus_servicios_id")
    detail = common.add_users(detail, tables, "gn_usuarios_asignado_id",
                              {"usuario_asignado_servicio": "nombre"})

    # Names are cleansed once per site, not once per service.
    site_name = F.col("nombre")
    if name_fallback == "empty":
        site_name = F.coalesce(site_name, F.lit(""))
    sites = tables["cnt_prestador_sedes"].select(
        F.col("id").alias("site_id"), F.col(provider_key).alias("provider_id"),
        cleanse_text(site_name, removals).alias("site_name"))
    sites = lookup(sites, tables["cnt_prestadores"], "provider_id", "id", ["numero_documento"])
    detail = lookup(detail, sites, "cnt_prestador_sede_destino_id", "site_id",
                    {"site_name": "site_name", "provider_document": "numero_documento"},
                    sized_by=[tables["cnt_prestador_sedes"], tables["cnt_prestadores"]])
    name = F.col("site_name")
    if name_fallback == "service":
        held = cleanse_text(F.col("cnt_prestador_sede_destino_valor"), removals)
        name = F.coalesce(name, held)
    return detail.select(
        "case_id",
        "service_id",
        F.col("mae_estado_valor").alias("estado_servicio"),
        F.col("ma_tecnologia_codigo").alias("cod_servicio"),
        F.col("ma_tecnologia_valor").alias("des_servicio"),
        decode(F.col("medicamento"), {1: "SI"}, default="NO").alias("medicamento"),
        decode(F.col("servicio_atribuido_ips"), {1: "SI", 3: "No aplica"}, default="NO")
        .alias("servicio_atribuido_ips"),
        "usuario_asignado_servicio",
        name.alias("IPS_responsable_respuesta"),
        F.col("provider_document").alias("nit_responsable_respuesta"),
        *common.SERVICE_STATES.values(),
    )
