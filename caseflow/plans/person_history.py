"""One person's history across the four clinical feeds."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions import with_labels
from caseflow.plans.common import Tables
from caseflow.sources.landing import of_person

TABLES = ["RIPS_AC_LLAVE", "RIPS_AU_LLAVE", "RIPS_AH_LLAVE", "RIPS_AP_LLAVE"]


@dataclass(frozen=True)
class Feed:
    """How one feed is read: its filter date, its event date and its output columns.

    ``columns`` maps output names to source columns in display order, and ``labels``
    output names to display labels. One source column may serve two outputs.
    """

    table: str
    filter_date: str
    event_date: str
    columns: Mapping[str, str]
    labels: Mapping[str, str]


_WHO = {
    "codigo_prestador": "codigo_reps",
    "tipo_identificacion": "mae_tipo_documento_codigo",
    "numero_identificacion": "documento_afiliado",
}
# Display labels.
_WHO_LABELS = {
    "codigo_prestador": "Código prestador",
    "tipo_identificacion": "Tipo identificación",
    "numero_identificacion": "Número identificación",
}

FEEDS = {
    # Consultations are selected by the time the row was made, not by the clinical date.
    "consulta": Feed(
        "RIPS_AC_LLAVE", "fecha_hora_crea", "fecha_consulta",
        {
            **_WHO,
            "fecha_consulta": "fecha_consulta",
            "codigo_consulta": "ma_tecnologia_codigo",
            "finalidad_consulta": "mae_finalidad_consulta_codigo",
            "causa_externa": "mae_causa_externa_codigo",
            "dx_principal": "ma_diagnostico_principal_codigo",
            "dx_relacionado_1": "ma_diagnostico_relacionado1_codigo",
            "dx_relacionado_2": "ma_diagnostico_relacionado2_codigo",
            "dx_relacionado_3": "ma_diagnostico_relacionado3_codigo",
        },
        # Display labels.
        {
            **_WHO_LABELS,
            "fecha_consulta": "Fecha de Consulta",
            "codigo_consulta": "Codigo de Consulta",
            "finalidad_consulta": "Finalidad consulta",
            "causa_externa": "Causa externa",
            "dx_principal": "Codigo del dx principal",
            "dx_relacionado_1": "Código del diagnóstico relacionado No. 1",
            "dx_relacionado_2": "Código del diagnóstico relacionado No. 2",
            "dx_relacionado_3": "Código del diagnóstico relacionado No. 3",
        },
    ),
    "urgencia": Feed(
        "RIPS_AU_LLAVE", "fecha_ingreso", "fecha_ingreso",
        {
            **_WHO,
            "fecha_ingreso": "fecha_ingreso",
            "causa_externa": "mae_causa_externa_valor",
            "dx_salida": "ma_diagnostico_salida_valor",
            "dx_relacionado_1": "ma_diagnostico_relacionado1_valor",
            "dx_relacionado_2": "ma_diagnostico_relacionado2_valor",
            "dx_relacionado_3": "ma_diagnostico_relacionado3_valor",
            "destino_salida": "mae_destino_salida_valor",
            "estado_salida": "mae_estado_salida_valor",
            "causa_muerte": "mae_causa_externa_valor",
            "fecha_salida": "fecha_salida",
        },
        # Display labels.
        {
            **_WHO_LABELS,
            "fecha_ingreso": "Fecha Ingreso",
            "causa_externa": "Causa Externa",
            "dx_salida": "DX Salida",
            "dx_relacionado_1": "Diagnóstico relacionado No. 1 a la salida",
            "dx_relacionado_2": "Diagnóstico relacionado No. 2 a la salida",
            "dx_relacionado_3": "Diagnóstico relacionado No. 3 a la salida",
            "destino_salida": "Destino del usuario a la salida de observación",
            "estado_salida": "Estado a la salida",
            "causa_muerte": "Causa básica de muerte en urgencias",
            "fecha_salida": "Fecha de la salida del usuario en observación",
        },
    ),
    "hospitalizacion": Feed(
        "RIPS_AH_LLAVE", "fecha_ingreso", "fecha_ingreso",
        {
            **_WHO,
            "via_ingreso": "mae_via_ingreso_valor",
            "fecha_ingreso": "fecha_ingreso",
            "causa_externa": "mae_causa_externa_valor",
            "dx_ingreso": "ma_diagnostico_ingreso_valor",
            "dx_egreso": "ma_diagnostico_egreso_valor",
            "dx_relacionado_1": "ma_diagnostico_relacionado1_valor",
            "dx_relacionado_2": "ma_diagnostico_relacionado2_valor",
            "dx_relacionado_3": "ma_diagnostico_relacionado3_valor",
            "estado_salida": "EstadoSalida",
            "dx_muerte": "ma_diagnostico_muerte_codigo",
            "fecha_salida": "fecha_salida",
        },
        # Display labels.
        {
            **_WHO_LABELS,
            "via_ingreso": "Vía ingreso",
            "fecha_ingreso": "Fecha ingreso",
            "causa_externa": "Causa externa",
            "dx_ingreso": "DX principal ingreso",
            "dx_egreso": "DX principal egreso",
            "dx_relacionado_1": "DX relacionado 1",
            "dx_relacionado_2": "DX relacionado 2",
            "dx_relacionado_3": "DX relacionado 3",
            "estado_salida": "Estado de salida",
            "dx_muerte": "DX muerte",
            "fecha_salida": "Fecha egreso",
        },
    ),
    "procedimiento": Feed(
        "RIPS_AP_LLAVE", "fecha_procedimiento", "fecha_procedimiento",
        {
            **_WHO,
            "fecha_procedimiento": "fecha_procedimiento",
            "codigo_procedimiento": "ma_tecnologia_codigo",
            "ambito": "mae_ambito_atencion_codigo_valor",
            "finalidad_procedimiento": "mae_finalidad_procedimiento_valor",
            "dx_principal": "ma_diagnostico_principal_valor",
            "dx_relacionado_1": "ma_diagnostico_relacionado1_valor",
        },
        # Display labels.
        {
            **_WHO_LABELS,
            "fecha_procedimiento": "Fecha de procedimiento",
            "codigo_procedimiento": "Codigo procedimiento",
            "ambito": "Ambito",
            "finalidad_procedimiento": "finalidad de procedimiento",
            "dx_principal": "dx principal",
            "dx_relacionado_1": "DX relacionado",
        },
    ),
}


def feed_history(tables: Tables, person: str, since: str | dt.date = "2015-01-01",
                 feeds: Mapping[str, Feed] = FEEDS, labels: bool = False,
                 ) -> dict[str, DataFrame]:
    """The person's rows of each feed, as one result per feed.

    ``person`` is a document number, compared as text: the filter reaches the scan, and a
    document with letters in the feed cannot fail the query.
    """
    results = {}
    for name, feed in feeds.items():
        rows = _rows(tables, feed, person, since).select(
            *[F.col(source).alias(output) for output, source in feed.columns.items()])
        results[name] = with_labels(rows, feed.labels) if labels else rows
    return results


def person_history(tables: Tables, person: str, since: str | dt.date = "2015-01-01",
                   feeds: Mapping[str, Feed] = FEEDS) -> DataFrame:
    """One timeline over all feeds: feed, event date and every feed's columns by name.

    A column that a feed does not have is NULL there. Of feeds written by ``land_history``
    only the person's folder is read.
    """
    parts = []
    for name, feed in feeds.items():
        columns = {o: s for o, s in feed.columns.items() if s != feed.event_date}
        parts.append(_rows(tables, feed, person, since).select(
            F.lit(name).alias("origen"),
            F.col(feed.event_date).alias("fecha"),
            *[F.col(source).alias(output) for output, source in columns.items()]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _rows(tables: Tables, feed: Feed, person: str, since: str | dt.date) -> DataFrame:
    document = F.col(feed.columns["numero_identificacion"])
    return tables[feed.table].where(
        of_person(tables[feed.table], person) & (document == F.lit(person)) & (F.col(feed.filter_date) >= F.lit(str(since))))
