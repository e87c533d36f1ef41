"""Authorised items with their waiting days and subregion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.data.subregions import SUBREGIONS, UNCLASSIFIED
from caseflow.functions import DEFAULT_COLLATION, ci_in, period_filter, wait_days
from caseflow.functions.semantics import BINARY
from caseflow.operators import classify, mapping_table, skew_join
from caseflow.plans.common import Tables
from caseflow.sources.landing import MONTH, in_months

TABLES = ["au_anexos3", "au_anexos4", "au_anexo4_items"]

# Technology codes of the psychology and psychiatry services.
TECHNOLOGY_CODES = ["890208", "890308", "890284", "890384"]

_PERSON = ["afiliado_tipo_documento", "afiliado_numero_documento", "afiliado_primer_apellido",
           "afiliado_segundo_apellido", "afiliado_primer_nombre", "afiliado_segundo_nombre",
           "afiliado_fecha_nacimiento", "diagnostico_principal", "afiliado_municipio",
           "mae_modalidad_tecnologia_codigo", "mae_modalidad_tecnologia_valor"]
_ITEM = ["ma_tecnologia_codigo", "ma_tecnologia_valor", "cantidad_autorizada",
         "fecha_hora_crea"]


def authorization_wait(
    tables: Tables,
    codes: Sequence[str] = tuple(TECHNOLOGY_CODES),
    start: str = "2024-01-01",
    end: str = "2025-03-31",
    inclusive_end: bool = False,
    classes: Mapping[str, Sequence[str]] = SUBREGIONS,
    default_class: str = UNCLASSIFIED,
    collation: str = DEFAULT_COLLATION,
) -> DataFrame:
    """One row per authorised item whose request date lies in the period.

    Requests outside the period are cut before the join. An authorisation without a
    request has no date to test and is left out. Of tables written by ``land_requests`` only
    the months of the period are read, of all three.
    """
    tables = {n: tables[n].where(in_months(tables[n], str(start), str(end))).drop(MONTH)
              for n in TABLES}
    requests = tables["au_anexos3"].where(
        period_filter(F.col("fecha_solicitud"), start=start, end=end,
                      inclusive_end=inclusive_end)
    ).withColumnRenamed("id", "au_anexos3_id")
    granted = tables["au_anexos4"].withColumnRenamed("id", "au_anexos4_id")
    granted = skew_join(granted, requests, ["au_anexos3_id"], "inner")
    granted = classify(granted, "afiliado_municipio", mapping_table(granted.sparkSession, classes),
                       default_class, name="subregion_ant", fold=collation != BINARY)
    items = tables["au_anexo4_items"].where(
        ci_in(F.col("ma_tecnologia_codigo"), list(codes), collation))
    rows = skew_join(items, granted, ["au_anexos4_id"], "inner")
    waited = wait_days(F.col("fecha_solicitud"), F.col("fecha_autorizacion"))
    return rows.select("fecha_solicitud", "fecha_autorizacion", waited.alias("dias_espera"),
                       *_PERSON, *_ITEM, "numero_autorizacion", "subregion_ant")
