"""Monthly tracking: cases created, closed and open, counted by person and place."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions import (
    DEFAULT_COLLATION,
    ci_in,
    decode,
    period_filter,
    same_period,
)
from caseflow.operators import count_by, distinct_rows, lookup, match_member, skew_join
from caseflow.plans import common
from caseflow.plans.common import Tables

TABLES = ["aus_casos", "aus_seguimientos", "aus_personas", "aseg_afiliados", "gn_ubicaciones"]

# Segment tags.
CREATED = "1-Creados"
CLOSED_SAME_MONTH = "2-Cerrado el mismo mes"
CLOSED_OTHER_MONTH = "3-Cerrado meses anteriores"
OPEN = "4-Abiertos"
# Case states that count as closed.
CLOSED_STATES = ["Cerrado", "Solucionado"]

_PERSON = ["person_id", "mae_tipo_documento_codigo", "documento"]
_PLACE = ["municipio_afiliacion", "region_afiliacion"]
DIMS = ["anio", "mes", "grupo_caso", "origen", "mae_tipo_documento_codigo", "documento", *_PLACE]


def monthly_tracking(
    tables: Tables,
    created_years: Iterable[int] = (2022, 2023, 2024),
    closed_years: Iterable[int] = (2022, 2023, 2024),
    same_month_created_years: Iterable[int] | None = (2022, 2023, 2024),
    other_month_created_years: Iterable[int] | None = None,
    open_years: Iterable[int] = (2023, 2024),
    match: str = "type_or_truthy",
    count_distinct_cases: bool = False,
    collation: str = DEFAULT_COLLATION,
    grouping: str | None = None,
) -> DataFrame:
    """Case counts per month, segment, origin, person and place of membership.

    A case is counted once per member row its person matches; with
    ``count_distinct_cases`` once per place. The segment of cases closed in another
    month is not bounded by creation year unless ``other_month_created_years`` is given.

    ``grouping`` is the collation under which labels fall into one group, as in the source
    database the one that compares them unless given.

    Cases are read once: each row yields the segments it belongs to. Both the cases and
    the members are counted before they meet, so a person with very many cases or a
    document with very many members is a handful of rows by the time of the joins.
    """
    grouping = collation if grouping is None else grouping
    segments = _segments(
        tables, created_years, closed_years, same_month_created_years,
        other_month_created_years, open_years, collation)
    counted = count_by(segments, ["person_id", "anio", "mes", "grupo_caso", "origen"],
                       name="cases")
    places = _person_places(tables, match, count_distinct_cases, collation, grouping)
    joined = skew_join(counted, places, ["person_id"], "left")
    # A case without a person still counts, under empty person and place.
    weighted = joined.withColumn("weight", F.col("cases") * F.coalesce("members", F.lit(1)))
    return count_by(weighted, DIMS, weight="weight", name="Nro_pqrd", collation=grouping)


def _segments(tables, created_years, closed_years, same_month_created_years,
              other_month_created_years, open_years, collation) -> DataFrame:
    closings = common.case_closings(tables, "one", collation, "closed")
    cases = common.live_cases(tables).select(
        F.col("id").alias("case_id"), F.col("aus_personas_id").alias("person_id"),
        F.col("fecha_hora_crea").alias("created"), "mae_solicitud_estado_valor",
        decode(F.col("mae_solicitud_origen_codigo"), common.REGULATOR_ORIGIN,
               default=common.OTHER_ORIGIN).alias("origen"))
    cases = common.attach(cases, closings, "case_id", "aus_casos_id")

    created, closed = F.col("created"), F.col("closed")
    is_closed = ci_in(F.col("mae_solicitud_estado_valor"), CLOSED_STATES, collation)
    closed_in_scope = is_closed & period_filter(closed, years=closed_years)
    same = same_period(created, closed)

    def made_in(years):
        return F.lit(True) if years is None else period_filter(created, years=years)

    def segment(condition, when, tag):
        return F.when(condition, F.struct(
            F.year(when).alias("anio"), F.month(when).alias("mes"),
            F.lit(tag).alias("grupo_caso")))

    found = F.array(
        segment(made_in(created_years), created, CREATED),
        segment(closed_in_scope & same & made_in(same_month_created_years),
                closed, CLOSED_SAME_MONTH),
        segment(closed_in_scope & ~same & made_in(other_month_created_years),
                closed, CLOSED_OTHER_MONTH),
        segment(~is_closed & period_filter(created, years=open_years), created, OPEN),
    )
    emitted = cases.select("person_id", "origen", F.explode(found).alias("s"))
    return emitted.where(F.col("s").isNotNull()).select(
        "person_id", "origen", "s.anio", "s.mes", "s.grupo_caso")


def _person_places(tables, match, distinct_places, collation, grouping) -> DataFrame:
    """Per person and place of membership, the number of member rows behind it."""
    members = count_by(
        tables["aseg_afiliados"],
        ["numero_documento", F.col("mae_tipo_documento_codigo").alias("member_tipo"),
         "afiliacion_ubicaciones_id"],
        name="members")
    placed = lookup(members, tables["gn_ubicaciones"], "afiliacion_ubicaciones_id", "id",
                    {"municipio_afiliacion": "nombre", "region": "mae_region_valor"})
    placed = placed.withColumn("region_afiliacion",
                               common.region_name(F.col("region"), collation))
    placed = count_by(placed, ["numero_documento", "member_tipo", *_PLACE], weight="members",
                      name="members")
    persons = tables["aus_personas"].select(
        F.col("id").alias("person_id"), "mae_tipo_documento_codigo", "documento")
    places = match_member(persons, placed, "documento", "mae_tipo_documento_codigo", match,
                          "numero_documento", "member_tipo", collation, split_members=False)
    if distinct_places:
        places = distinct_rows(places.select(*_PERSON, *_PLACE), grouping)
        places = places.withColumn("members", F.lit(1))
    return places
