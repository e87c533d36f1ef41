"""Case x service detail with milestone dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions import (
    DEFAULT_COLLATION,
    coalesce_milestones,
    decode,
    period_filter,
)
from caseflow.operators import lookup, milestones
from caseflow.plans import common
from caseflow.plans.common import Tables

TABLES = ["aus_casos", "aus_caso_servicios", "aus_seguimientos", "aus_servicio_gestiones",
          "aus_personas", "aseg_afiliados", "gn_ubicaciones", "gn_usuarios",
          "cnt_prestador_sedes"]


def case_detail(
    tables: Tables,
    min_year: int = 2023,
    match: str = "type_or_truthy",
    closing_order: tuple[str, ...] = ("closed_case", "fecha_resuelto"),
    collation: str = DEFAULT_COLLATION,
    unknown_time: str = "first",
    reduce_first: bool = False,
) -> DataFrame:
    """One row per live case and service, created in ``min_year`` or later.

    A service whose log has an entry of a state without a time has reached that state at
    no known time with ``unknown_time='first'``; ``'ignore'`` takes the earliest known.
    ``reduce_first`` is that of ``consolidated``.
    """
    recent = period_filter(F.col("fecha_hora_crea"), min_year=min_year)
    cases = common.live_cases(tables).where(recent)
    if reduce_first:
        tables = common.reduced(tables, cases)
    detail = cases.select(
        F.col("id").alias("case_id"), F.col("aus_personas_id").alias("person_id"),
        "gn_usuarios_responsable_id", "radicado", "fecha_hora_crea", "fecha_hora_modifica",
        "mae_solicitud_riesgo_vidal_valor", "mae_solicitud_origen_valor",
        decode(F.col("mae_solicitud_estado_valor"), common.CASE_STATES, keep_other=True,
               collation=collation).alias("EstadoCaso"),
        common.reopened_by_regulator(collation).alias("reabierto_Supersalud"),
    )
    detail = common.add_users(detail, tables, "gn_usuarios_responsable_id",
                              {"ResponsableCaso": "nombre"})
    closed = common.case_closings(tables, "one", collation, "closed_case")
    detail = common.attach(detail, closed, "case_id", "aus_casos_id")
    detail = _with_persons(detail, tables, match, collation)
    services = _services(tables, collation, unknown_time)
    detail = common.with_services(detail, services, "case_id", tables)

    dates = {n: F.col(n) for n in ("closed_case", "fecha_asignado", "fecha_estudio",
                                   "fecha_cerrado", "fecha_resuelto", "service_created")}
    return detail.select(
        F.col("case_id").alias("numero_solicitud_pqrsf"),
        F.col("radicado").alias("numero_radicado"),
        F.col("service_id").alias("numero_servicio"),
        F.col("tipo_documento").alias("tipo_doc_usuario"),
        F.col("documento").alias("doc_usuario"),
        "municipio_afiliacion",
        "region_afiliacion",
        "EstadoCaso",
        "reabierto_Supersalud",
        "fecha_hora_crea",
        "fecha_hora_modifica",
        coalesce_milestones(dates, closing_order).alias("fecha_cierre"),
        F.col("mae_solicitud_riesgo_vidal_valor").alias("riesgo_de_vida"),
        "ResponsableCaso",
        "mae_solicitud_origen_valor",
        F.coalesce("usuario_asignado_servicio", "IPSDestino").alias("IPS_responsable_respuesta"),
        "IPSDestino",
        "usuario_asignado_servicio",
        F.col("mae_estado_valor").alias("EstadoServicio"),
        F.col("ma_tecnologia_codigo").alias("Cod_servicio"),
        F.col("ma_tecnologia_valor").alias("Des_servicio"),
        coalesce_milestones(dates, ("fecha_asignado", "fecha_estudio", "service_created"))
        .alias("fecha_asignacion_servicio"),
        coalesce_milestones(dates, ("fecha_cerrado", "fecha_resuelto"))
        .alias("fecha_solucion_servicio"),
    )


def _with_persons(detail: DataFrame, tables: Tables, match: str, collation: str) -> DataFrame:
    """Adds the person, and the municipality and region of the membership."""
    members = tables["aseg_afiliados"].select(
        "numero_documento", F.col("mae_tipo_documento_codigo").alias("member_tipo"),
        "afiliacion_ubicaciones_id")
    matched = common.with_members(
        detail, tables, "person_id",
        {"tipo_documento": "mae_tipo_documento_codigo", "documento": "documento"},
        members, match, collation)
    placed = lookup(matched, tables["gn_ubicaciones"], "afiliacion_ubicaciones_id", "id",
                    {"municipio_afiliacion": "nombre", "region": "mae_region_valor"})
    return placed.withColumn("region_afiliacion", common.region_name(F.col("region"), collation))


def _services(tables: Tables, collation: str, unknown_time: str) -> DataFrame:
    """Services with milestone dates, assigned user and destination site."""
    services = tables["aus_caso_servicios"]
    states = {s: n for s, n in common.SERVICE_STATES.items() if s != "Rechazado"}
    reached = milestones(tables["aus_servicio_gestiones"], "aus_servicios_id",
                         "mae_estado_valor", "fecha_hora_crea", states, collation=collation,
                         unknown=unknown_time)
    detail = services.select(
        F.col("id").alias("service_id"), F.col("aus_casos_id").alias("case_id"),
        "gn_usuarios_asignado_id", "cnt_prestador_sede_destino_id", "mae_estado_valor",
        "ma_tecnologia_codigo", "ma_tecnologia_valor",
        F.col("fecha_hora_crea").alias("service_created"))
    detail = common.attach(detail, reached, "service_id", "aus_servicios_id")
    detail = common.add_users(detail, tables, "gn_usuarios_asignado_id",
                              {"usuario_asignado_servicio": "nombre"})
    return lookup(detail, tables["cnt_prestador_sedes"], "cnt_prestador_sede_destino_id", "id",
                  {"IPSDestino": "nombre"})
