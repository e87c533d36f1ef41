"""Contract catalogues: tariffs per technology, and the network of enabled services."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions import DEFAULT_COLLATION, decode
from caseflow.operators import distinct_rows, lookup, skew_join
from caseflow.plans.common import Tables

TABLES = ["cnt_contratos", "cnt_contrato_sedes", "cnt_contrato_detalles", "cnt_prestadores",
          "cnt_prestador_sedes", "gn_ubicaciones"]

# Technology types.
TECHNOLOGY_TYPES = {1: "Tecnologia", 2: "Medicamento", 3: "Insumo", 4: "Paquete"}

_KEYS = ["cnt_contratos_id", "cnt_contrato_sedes_id"]
_CONTRACT = ["numero_documento", "razon_social", "contrato", "fecha_inicio", "fecha_fin"]
_SERVICE = ["ma_servicio_habilitacion_codigo", "ma_servicio_habilitacion_valor"]
_TARIFF = ["ma_tecnologia_codigo", "ma_tecnologia_valor", "valor_manual", "valor_contratado",
           "complejidad"]
_PLACE = ["nombre", "mae_region_valor"]


def contract_tariffs(tables: Tables, types: Sequence[int] = (1, 2, 3, 4),
                     grouping: str = DEFAULT_COLLATION) -> DataFrame:
    """Distinct contract x site x technology with its tariff, active rows only.

    Texts that ``grouping`` holds equal make one row, shown in the smallest spelling.
    """
    details = _active_details(tables, types, [*_SERVICE, *_TARIFF])
    rows = _join_sites(tables, details)
    return distinct_rows(rows.select(
        *_CONTRACT, _type_label(), *_SERVICE,
        F.col("ma_tecnologia_codigo").alias("codigo_tecnologia"), *_TARIFF[1:],
        "mae_modalidad_contrato_valor", *_PLACE,
    ), grouping, spelt_first=False)


def contract_network(tables: Tables, types: Sequence[int] = (1, 4),
                     grouping: str = DEFAULT_COLLATION) -> DataFrame:
    """Distinct contract x site x enabled service, active rows only; ``grouping`` is that of
    ``contract_tariffs``.

    A site repeats an enabled service for each of its technologies; the repeats go
    before the join, within each map task first.
    """
    details = _active_details(tables, types, _SERVICE).distinct()
    rows = _join_sites(tables, details)
    return distinct_rows(rows.select(*_CONTRACT, _type_label(), *_SERVICE, *_PLACE), grouping)


def _active_details(tables: Tables, types: Sequence[int], cols: list[str]) -> DataFrame:
    details = tables["cnt_contrato_detalles"]
    active = (F.col("activo") == 1) & F.col("tipo_tecnologia").isin(*types)
    return details.where(active).select(*_KEYS, "tipo_tecnologia", *cols)


def _type_label():
    return decode(F.col("tipo_tecnologia"), TECHNOLOGY_TYPES).alias("Desctipo_tecnologia")


def _join_sites(tables: Tables, details: DataFrame) -> DataFrame:
    """Details joined once to the contract sites, which carry all other attributes."""
    contracts = tables["cnt_contratos"].withColumnRenamed("id", "cnt_contratos_id")
    sites = tables["cnt_contrato_sedes"].withColumnRenamed("id", "cnt_contrato_sedes_id")
    sites = skew_join(sites, contracts, ["cnt_contratos_id"], "inner")
    sites = lookup(sites, tables["cnt_prestadores"], "cnt_prestadores_id", "id",
                   ["numero_documento", "razon_social"])
    sites = lookup(sites, tables["cnt_prestador_sedes"], "cnt_prestador_sedes_id", "id",
                   ["ubicacion_id"])
    sites = lookup(sites, tables["gn_ubicaciones"], "ubicacion_id", "id", _PLACE)
    sites = sites.select(*_KEYS, *_CONTRACT, "mae_modalidad_contrato_valor", *_PLACE)
    return skew_join(details, sites, _KEYS, "inner")
