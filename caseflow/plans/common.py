"""Steps that several reports share."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import BINARY, ci_eq, decode, exclude_codes, flag, not_deleted
from caseflow.operators import (
    hot_keys,
    keep_marked,
    key_marks,
    latest_per_key,
    lookup,
    match_member,
    skew_join,
)

Tables = Mapping[str, DataFrame]

# Case types left out (praise, suggestion, request for information).
EXCLUDED_TYPES = (3, 9, 10)
# States of the two logs.
CASE_CLOSED = "CERRADO"
SERVICE_STATES = {
    "Asignado": "fecha_asignado",
    "Estudio": "fecha_estudio",
    "Cerrado": "fecha_cerrado",
    "Resuelto": "fecha_resuelto",
    "Rechazado": "fecha_rechazado",
}
# Label normalisations.
REGION_NAMES = {"MEDELLIN": "VALLE DE ABURRA"}
MUNICIPALITY_NAMES = {"MEDELLÍN": "MEDELLIN"}
CASE_STATES = {"Solucionado": "Cerrado"}
REGULATOR_ORIGIN = {9: "Supersalud"}
OTHER_ORIGIN = "Otros canales"
LIFE_RISK = {"No aplica": "Peticion general", "Regular": "Simple"}
REGULATOR_REOPEN = "1"


def live_cases(tables: Tables, exclude_types: bool = True) -> DataFrame:
    cases = tables["aus_casos"].where(not_deleted(F.col("borrado")))
    if exclude_types:
        cases = cases.where(exclude_codes(F.col("mae_solicitud_tipo_codigo"), EXCLUDED_TYPES))
    return cases


def reduced(tables: Tables, cases: DataFrame) -> Tables:
    """The tables with little more than the services, log entries and persons of ``cases``.

    Worth its further reads where the cases are a small part, such as one year of many: what
    belongs to the others is tested against a bit set of the kept keys where it is read, and
    is then neither shuffled nor aggregated nor matched. The few rows that pass by chance
    belong to no kept case and fall out of the joins.
    """
    of_cases = key_marks(cases, "id")
    services = keep_marked(tables["aus_caso_servicios"], "aus_casos_id", of_cases)
    of_services = key_marks(services, "id")
    return {
        **tables,
        "aus_caso_servicios": services,
        "aus_seguimientos": keep_marked(tables["aus_seguimientos"], "aus_casos_id", of_cases),
        "aus_servicio_gestiones": keep_marked(
            tables["aus_servicio_gestiones"], "aus_servicios_id", of_services),
        "aus_personas": keep_marked(
            tables["aus_personas"], "id", key_marks(cases, "aus_personas_id")),
    }


def region_name(col: Column, collation: str = BINARY) -> Column:
    return decode(col, REGION_NAMES, keep_other=True, collation=collation)


def municipality_name(col: Column, collation: str = BINARY) -> Column:
    return decode(col, MUNICIPALITY_NAMES, keep_other=True, collation=collation)


def reopened_by_regulator(collation: str = BINARY) -> Column:
    return flag(
        F.col("reabierto") == 1,
        ci_eq(F.col("mae_motivo_reabre_codigo"), REGULATOR_REOPEN, collation),
    )


def disability(member: Column, person: Column) -> Column:
    """Only a recorded 0 says no; an unknown disability counts as one."""
    return decode(F.coalesce(member, person), {0: "NO"}, default="SI")


def case_closings(tables: Tables, ties: str, collation: str, name: str) -> DataFrame:
    """Time of the last closing entry per case (each tied entry with ``ties='all'``).

    An entry without a time is no closing: it could not be last, nor tie with another.
    """
    closing = ci_eq(F.col("mae_estado_valor"), CASE_CLOSED, collation)
    log = tables["aus_seguimientos"].select("aus_casos_id", "mae_estado_valor", "fecha_hora_crea")
    last = latest_per_key(
        log,
        ["aus_casos_id"],
        order="fecha_hora_crea",
        tie_break=[],
        where=closing & F.col("fecha_hora_crea").isNotNull(),
        cols=["fecha_hora_crea"],
        ties=ties,
    )
    return last.withColumnRenamed("fecha_hora_crea", name)


def attach(df: DataFrame, per_key: DataFrame, key: str, per_key_key: str) -> DataFrame:
    """Left join of a result with one row per key, as large as the table it goes to."""
    return skew_join(df, per_key.withColumnRenamed(per_key_key, key), [key], "left")


def with_members(cases: DataFrame, tables: Tables, key: str, person: Mapping[str, str],
                 members: DataFrame, match: str, collation: str = BINARY) -> DataFrame:
    """Cases with columns of their person, one row each, and of the members it matches.

    ``person`` names columns, ``documento`` and ``tipo_documento`` among them; members have
    ``numero_documento`` and ``member_tipo``. The cases bring the document to the members,
    so persons and members that no case needs never meet, and what is split is the member
    side alone, by documents.
    """
    found = lookup(cases, tables["aus_personas"], key, "id", person)
    return match_member(found, members, "documento", "tipo_documento", match,
                        "numero_documento", "member_tipo", collation)


def with_services(cases: DataFrame, services: DataFrame, key: str, tables: Tables) -> DataFrame:
    """Cases with their services, whose own attributes were added before: the two sides
    meet once, and a case with very many services is split. The hot cases are counted on the
    service table itself, all rows of which are still in ``services``."""
    base = tables["aus_caso_servicios"].select(F.col("aus_casos_id").alias(key))
    return skew_join(cases, services, [key], "left", hot_right=hot_keys(base, [key]),
                     spread_right=["service_id"])


def add_users(df: DataFrame, tables: Tables, key: str, cols: Mapping[str, str]) -> DataFrame:
    return lookup(df, tables["gn_usuarios"], key, "id", cols)
