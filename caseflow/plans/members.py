"""Active members per municipality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions import DEFAULT_COLLATION, ci_eq, geo_code
from caseflow.operators import count_by, flatten_hierarchy, lookup
from caseflow.plans.common import Tables

TABLES = ["aseg_afiliados", "gn_ubicaciones"]

# Fixed value: membership state that counts as active.
ACTIVE = "activo"

LOCATION_ROLES = {
    "membership": "afiliacion_ubicaciones_id",
    "residence": "residencia_ubicacion_id",
}


def members_by_municipality(
    tables: Tables,
    state: str = ACTIVE,
    location_role: str = "membership",
    collation: str = DEFAULT_COLLATION,
) -> DataFrame:
    """Members in ``state`` per administrative code of their municipality.

    Members are counted per location id first, so only one row per location takes part
    in the lookup. Members without a complete code are counted under NULL.
    """
    location = LOCATION_ROLES[location_role]
    members = tables["aseg_afiliados"].where(
        ci_eq(F.col("mae_estado_afiliacion_valor"), state, collation))
    per_location = count_by(members, [location], name="members")
    places = flatten_hierarchy(tables["gn_ubicaciones"], "id", "gn_ubicaciones_id", ["prefijo"])
    coded = lookup(per_location, places, location, "id", ["prefijo", "parent_prefijo"],
                   sized_by=[tables["gn_ubicaciones"]])
    code = geo_code(F.col("parent_prefijo"), F.col("prefijo")).alias("cod_municipio_afiliacion")
    return count_by(coded, [code], weight="members", name="cantidad_afiliados")
