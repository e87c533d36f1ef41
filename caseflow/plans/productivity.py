"""Interactions recorded on cases and on services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions import DEFAULT_COLLATION, period_filter, simple_upper
from caseflow.operators import count_by, lookup, skew_join, tagged_union
from caseflow.plans import common
from caseflow.plans.common import Tables

TABLES = ["aus_casos", "aus_caso_servicios", "aus_seguimientos", "aus_servicio_gestiones",
          "gn_ubicaciones", "gn_usuarios"]

# Group tags.
CASES, SERVICES = "Casos", "Servicios"

_CASE = ["id_caso", "id", "fecha_creacion_caso", "responsable_caso", "origen", "riesgo_vida"]
_PLACE = ["mpio_caso", "region"]
_ENTRY = ["usuario", "estado_interaccion"]
DIMS = [*_CASE, "estado_caso_servicio", *_PLACE, *_ENTRY, "fecha_interaccion"]
COLUMNS = [*DIMS[:-1], "grupo", "fecha_interaccion", "interacciones"]


def productivity(tables: Tables, min_year: int = 2024,
                 collation: str = DEFAULT_COLLATION, grouping: str | None = None) -> DataFrame:
    """Interactions per log entry's case or service, responsible user, place and time.

    Labels fall into one group under ``grouping``, which is ``collation`` unless given.

    The case group is keyed by the log entry, the service group by the service. Entries
    of deleted or unknown cases are left out.
    """
    info = _case_info(tables, collation)
    branches = {
        CASES: _case_entries(tables, info, min_year),
        SERVICES: _service_entries(tables, info, min_year),
    }
    # Each group is counted where its join left it: the join key is one of the
    # dimensions, so the rows need not be shuffled again. Logs and services are merged, and
    # not broadcast for looking small on disk, which would leave them by no key.
    counted = {
        tag: count_by(entries, DIMS, non_null="fecha_interaccion", name="interacciones",
                      collation=collation if grouping is None else grouping,
                      spelt_first=False)
        for tag, entries in branches.items()
    }
    return tagged_union(counted, "grupo").select(*COLUMNS)


def _case_info(tables: Tables, collation: str) -> DataFrame:
    """Live cases with the attributes both groups show, built once per case."""
    cases = common.live_cases(tables, exclude_types=False)
    info = cases.select(
        F.col("id").alias("id_caso"), "gn_ubicaciones_id", "gn_usuarios_responsable_id",
        F.col("fecha_hora_crea").alias("fecha_creacion_caso"),
        F.col("mae_solicitud_origen_valor").alias("origen"),
        F.col("mae_solicitud_riesgo_vidal_valor").alias("riesgo_vida"),
        F.col("mae_solicitud_estado_valor").alias("estado_caso"))
    info = lookup(info, tables["gn_ubicaciones"], "gn_ubicaciones_id", "id",
                  {"mpio_caso": "nombre", "place_region": "mae_region_valor"})
    info = common.add_users(info, tables, "gn_usuarios_responsable_id",
                            {"responsible": "nombre"})
    return info.select(
        "id_caso", "fecha_creacion_caso", simple_upper(F.col("responsible")).alias("responsable_caso"),
        "origen", "riesgo_vida", "estado_caso", "mpio_caso",
        common.region_name(F.col("place_region"), collation).alias("region"))


def _case_entries(tables: Tables, info: DataFrame, min_year: int) -> DataFrame:
    log = _recent(tables["aus_seguimientos"], min_year).select(
        F.col("aus_casos_id").alias("id_caso"), "id", *_log_columns())
    joined = skew_join(log.hint("merge"), info, ["id_caso"], "inner")
    return joined.withColumnRenamed("estado_caso", "estado_caso_servicio")


def _service_entries(tables: Tables, info: DataFrame, min_year: int) -> DataFrame:
    services = tables["aus_caso_servicios"].select(
        F.col("aus_casos_id").alias("id_caso"), "id",
        F.col("mae_estado_valor").alias("estado_caso_servicio"))
    services = skew_join(services.hint("merge"), info.drop("estado_caso"), ["id_caso"], "inner")
    log = _recent(tables["aus_servicio_gestiones"], min_year).select(
        F.col("aus_servicios_id").alias("id"), *_log_columns())
    return skew_join(log.hint("merge"), services, ["id"], "inner")


def _recent(log: DataFrame, min_year: int) -> DataFrame:
    return log.where(period_filter(F.col("fecha_hora_crea"), min_year=min_year))


def _log_columns():
    return [F.col("usuario_crea").alias("usuario"),
            F.col("mae_estado_valor").alias("estado_interaccion"),
            F.col("fecha_hora_crea").alias("fecha_interaccion")]
