"""The registered queries as plain SQL, for DuckDB over the same files.

Written from the meaning of each report rather than from the Spark plan: rows are ranked
with QUALIFY, members are joined with the OR condition, nothing is counted ahead of a
join, and joins that the Spark plans leave out are kept.
"""

from __future__ import annotations

from caseflow.sources.star_schema import BASE_TABLES, DOMAIN_SQL
from checks.queries import (
    AS_OF,
    EVENT_TYPES,
    PERSON,
    SPELT_SERVICE,
    SPELT_TARIFF,
    SUBREGION_SAMPLE,
)

# Fixed values, spelt here anew: strings deleted from names, in this order.
NAME_REMOVALS = [";", ",", "\r", "\n", "\t", '"', "&quot", "\r\n", "\n", "\t", "", "  "]

# Fixed values, spelt here anew: municipalities per subregion, and the label of the others.
SUBREGIONS = {
    "Valle de Aburrá": [
        "MEDELLÍN", "BELLO", "ENVIGADO", "ITAGUI", "SABANETA", "LA ESTRELLA", "CALDAS",
        "COPACABANA", "GIRARDOTA", "BARBOSA",
    ],
    "Oriente": [
        "RIONEGRO", "MARINILLA", "LA CEJA", "EL CARMEN DE VIBORAL", "EL RETIRO",
        "EL SANTUARIO", "GUARNE", "LA UNION", "SAN VICENTE FERRER", "ALEJANDRIA",
        "CONCEPCION", "EL PEÑOL", "GRANADA", "GUATAPE", "SAN CARLOS", "SAN RAFAEL",
        "COCORNA", "SAN FRANCISCO", "SAN LUIS", "ABEJORRAL", "ARGELIA", "NARIÑO",
        "SONSON",
    ],
    "Norte": [
        "SANTA ROSA DE OS", "SAN PEDRO DE LOS MILAGROS", "SAN JOSE DE LA MONTAÑA",
        "DONMATIAS", "ENTRERIOS", "BELMIRA", "CAROLINA DEL PRINCIPE", "GOMEZ PLATA",
        "GUADALUPE", "ANGOSTURA", "BRICEÑO", "CAMPAMENTO", "YARUMAL", "VALDIVIA",
        "ITUANGO", "SAN ANDRES DE CUERQUIA", "TOLEDO",
    ],
    "Nordeste": [
        "AMALFI", "ANORI", "CISNEROS", "REMEDIOS", "SEGOVIA", "SAN ROQUE",
        "SANTO DOMINGO", "VEGACHI", "YALI", "YOLOMBO",
    ],
    "Occidente": [
        "ANZA", "ARMENIA", "BURITICA", "CAICEDO", "EBEJICO", "GIRALDO", "HELICONIA",
        "LIBORINA", "OLAYA", "SABANALARGA", "SAN JERONIMO", "SANTAFE DE ANTIO",
        "SOPETRAN", "ABRIAQUI", "CANASGORDAS", "DABEIBA", "FRONTINO", "PEQUE", "URAMITA",
    ],
    "Suroeste": [
        "CARAMANTA", "JERICO", "LA PINTADA", "MONTEBELLO", "PUEBLORRICO",
        "SANTA BARBARA", "TAMESIS", "TARSO", "VALPARAISO", "BETULIA", "CONCORDIA",
        "SALGAR", "URRAO", "ANDES", "BETANIA", "CIUDAD BOLIVAR", "HISPANIA", "JARDIN",
        "AMAGA", "ANGELOPOLIS", "FREDONIA", "TITIRIBI", "VENECIA",
    ],
    "Bajo Cauca": [
        "CAUCASIA", "CACERES", "EL BAGRE", "NECHI", "TARAZA", "ZARAGOZA",
    ],
    "Magdalena Medio": [
        "PUERTO BERRIO", "PUERTO NARE", "PUERTO TRIUNFO", "YONDO", "CARACOLI", "MACEO",
    ],
    "Urabá": [
        "APARTADO", "CAREPA", "CHIGORODO", "MUTATA", "TURBO", "ARBOLETES", "NECOCLI",
        "SAN JUAN DE URA", "SAN PEDRO DE URA", "MURINDO", "VIGIA DEL FUERTE",
    ],
}
UNCLASSIFIED = "SIN CLASIFICAR"
# Fixed values, spelt here anew: display labels of the urgency feed.
URGENCY_LABELS = {
    "codigo_prestador": "Código prestador",
    "tipo_identificacion": "Tipo identificación",
    "numero_identificacion": "Número identificación",
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
}

_NAMES = {name: name for name in BASE_TABLES}


def _domain(name: str) -> str:
    sql = DOMAIN_SQL[name].replace("{explode}", "unnest([0, 1, 2])")
    return f"{name} AS ({sql.format(**_NAMES)})"


def _with(tables: list[str], body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([*map(_domain, tables), *ctes]) + "\n" + body


def _spelt_twice(sql: str, table: str, columns: list[str], shown: list[str],
                 summed: str | None = None) -> str:
    """A query over a table that has every row again in other spellings: the labels as
    ``shown`` that fold alike are one, in the smallest spelling."""
    other = ", ".join(f"translate(upper({c}), 'AEO', '\u00c1\u00c9\u00d3') AS {c}" for c in columns)
    once = _domain(table).replace(f"{table} AS", f"{table}_once AS", 1)
    twice = (f"{table} AS (SELECT * FROM {table}_once UNION ALL "
             f"SELECT * REPLACE ({other}) FROM {table}_once)")
    assert _domain(table) in sql
    rows = sql.replace(_domain(table), f"{once},\n{twice}", 1)
    left_out = [*shown, *([summed] if summed else [])]
    keys = [f"lower(strip_accents({c})) AS key_{i}, min({c}) AS {c}" for i, c in enumerate(shown)]
    sums = [f"CAST(sum({summed}) AS BIGINT) AS {summed}"] if summed else []
    return (f"SELECT * EXCLUDE ({', '.join(f'key_{i}' for i in range(len(shown)))}) FROM ("
            f"SELECT * EXCLUDE ({', '.join(left_out)}), {', '.join([*keys, *sums])} "
            f"FROM ({rows}) GROUP BY ALL)")


def _text(value: str) -> str:
    """A SQL literal; control characters as chr() since DuckDB does not unescape."""
    parts = ["chr(%d)" % ord(c) if c in "\r\n\t" else "'%s'" % c.replace("'", "''")
             for c in value]
    return " || ".join(parts)


def _cleansed(expression: str, removals) -> str:
    for pattern in removals:
        if pattern:
            expression = f"replace({expression}, {_text(pattern)}, '')"
    return expression


def _age(birth: str, year_days: str, as_of: str = AS_OF) -> str:
    days = f"date_diff('day', CAST({birth} AS DATE), DATE '{as_of}')"
    return f"CAST(trunc({days} / {year_days}) AS INTEGER)"


_REGION = "CASE {0} WHEN 'MEDELLIN' THEN 'VALLE DE ABURRA' ELSE {0} END"
_TRUTHY = ("coalesce(try_cast(regexp_extract({0}, '^\\s*([+-]?[0-9]+(\\.[0-9]*)?)', 1)"
           " AS DOUBLE), 0) <> 0")
_OR_MATCH = ("m.numero_documento = p.documento AND (m.mae_tipo_documento_codigo = "
             "p.mae_tipo_documento_codigo OR " + _TRUTHY.format("p.mae_tipo_documento_codigo")
             + ")")
_LIVE = "c.borrado <> 1 AND c.mae_solicitud_tipo_codigo NOT IN (3, 9, 10)"
_REOPENED = "CASE WHEN c.reabierto = 1 AND c.mae_motivo_reabre_codigo = '1' THEN 'SI' ELSE 'NO' END"

_CLOSED = """closed AS (
    SELECT aus_casos_id, fecha_hora_crea AS closed_at FROM aus_seguimientos
    WHERE mae_estado_valor = 'CERRADO'
    QUALIFY row_number() OVER (PARTITION BY aus_casos_id ORDER BY fecha_hora_crea DESC) = 1)"""
_CLOSED_TIES = """closed AS (
    SELECT aus_casos_id, fecha_hora_crea AS closed_at FROM aus_seguimientos
    WHERE mae_estado_valor = 'CERRADO'
    QUALIFY rank() OVER (PARTITION BY aus_casos_id ORDER BY fecha_hora_crea DESC) = 1)"""
_REACHED = """reached AS (
    SELECT aus_servicios_id,
           min(fecha_hora_crea) FILTER (mae_estado_valor = 'Asignado') AS asignado,
           min(fecha_hora_crea) FILTER (mae_estado_valor = 'Estudio') AS estudio,
           min(fecha_hora_crea) FILTER (mae_estado_valor = 'Cerrado') AS cerrado,
           min(fecha_hora_crea) FILTER (mae_estado_valor = 'Resuelto') AS resuelto
    FROM aus_servicio_gestiones GROUP BY aus_servicios_id)"""

# The first entry of each state by rank, in which an entry without a time comes first.
_RANKED = """reached AS (
    SELECT aus_servicios_id,
           max(fecha_hora_crea) FILTER (mae_estado_valor = 'Asignado') AS asignado,
           max(fecha_hora_crea) FILTER (mae_estado_valor = 'Estudio') AS estudio,
           max(fecha_hora_crea) FILTER (mae_estado_valor = 'Cerrado') AS cerrado,
           max(fecha_hora_crea) FILTER (mae_estado_valor = 'Resuelto') AS resuelto
    FROM (SELECT * FROM aus_servicio_gestiones QUALIFY row_number() OVER (
              PARTITION BY aus_servicios_id, mae_estado_valor
              ORDER BY fecha_hora_crea ASC NULLS FIRST) = 1)
    GROUP BY aus_servicios_id)"""

_EVENT_COLUMNS = ", ".join(
    f"min(CASE WHEN event_type = '{e}' THEN ts END) AS first_{e}" for e in EVENT_TYPES)
_EVENT_REACHED = f"reached AS (SELECT user_id, {_EVENT_COLUMNS} FROM events GROUP BY user_id)"
_FIRSTS = ", ".join(f"first_{e}" for e in EVENT_TYPES)


def _match(condition: str) -> str:
    return _with(["aus_personas", "aseg_afiliados"], f"""
        SELECT p.id AS person_id, p.mae_tipo_documento_codigo, p.documento,
               m.mae_regimen_valor, CAST(m.residencia_ubicacion_id AS BIGINT)
                   AS residencia_ubicacion_id
        FROM aus_personas p LEFT JOIN aseg_afiliados m ON {condition}""")


_CASE_DETAIL = _with(
    ["aus_casos", "aus_caso_servicios", "aus_seguimientos", "aus_servicio_gestiones",
     "aus_personas", "aseg_afiliados", "gn_ubicaciones", "gn_usuarios",
     "cnt_prestador_sedes"], f"""
    SELECT c.id AS numero_solicitud_pqrsf, c.radicado AS numero_radicado,
           s.id AS numero_servicio, p.mae_tipo_documento_codigo AS tipo_doc_usuario,
           p.documento AS doc_usuario, g.nombre AS municipio_afiliacion,
           {_REGION.format("g.mae_region_valor")} AS region_afiliacion,
           CASE c.mae_solicitud_estado_valor WHEN 'Solucionado' THEN 'Cerrado'
                ELSE c.mae_solicitud_estado_valor END AS EstadoCaso,
           {_REOPENED} AS reabierto_Supersalud, c.fecha_hora_crea, c.fecha_hora_modifica,
           coalesce(k.closed_at, r.resuelto) AS fecha_cierre,
           c.mae_solicitud_riesgo_vidal_valor AS riesgo_de_vida,
           resp.nombre AS ResponsableCaso, c.mae_solicitud_origen_valor,
           coalesce(asig.nombre, ips.nombre) AS IPS_responsable_respuesta,
           ips.nombre AS IPSDestino, asig.nombre AS usuario_asignado_servicio,
           s.mae_estado_valor AS EstadoServicio, s.ma_tecnologia_codigo AS Cod_servicio,
           s.ma_tecnologia_valor AS Des_servicio,
           coalesce(r.asignado, r.estudio, s.fecha_hora_crea) AS fecha_asignacion_servicio,
           coalesce(r.cerrado, r.resuelto) AS fecha_solucion_servicio
    FROM aus_casos c
    LEFT JOIN aus_caso_servicios s ON s.aus_casos_id = c.id
    LEFT JOIN gn_usuarios resp ON resp.id = c.gn_usuarios_responsable_id
    LEFT JOIN gn_usuarios asig ON asig.id = s.gn_usuarios_asignado_id
    LEFT JOIN cnt_prestador_sedes ips ON ips.id = s.cnt_prestador_sede_destino_id
    LEFT JOIN aus_personas p ON p.id = c.aus_personas_id
    LEFT JOIN aseg_afiliados m ON {_OR_MATCH}
    LEFT JOIN gn_ubicaciones g ON g.id = m.afiliacion_ubicaciones_id
    LEFT JOIN closed k ON k.aus_casos_id = c.id
    LEFT JOIN reached r ON r.aus_servicios_id = s.id
    WHERE {_LIVE} AND year(c.fecha_hora_crea) >= 1998""", _CLOSED, _RANKED)

_WIDE_DETAIL = _with(
    ["aus_casos", "aus_caso_servicios", "aus_seguimientos", "aus_servicio_gestiones",
     "aus_personas", "aus_persona_telefonos", "aseg_afiliados", "gn_ubicaciones",
     "gn_usuarios", "cnt_prestadores"], f"""
    SELECT DISTINCT p.mae_tipo_documento_codigo AS tipo_identificacion_afectado,
           p.documento AS identificacion_afectado,
           CAST(m.fecha_nacimiento AS VARCHAR) AS fecha_nacimiento_afectado,
           {_age("m.fecha_nacimiento", "365.2")} AS Edad_actual,
           coalesce(p.mae_sexo_codigo, m.mae_genero_codigo) AS genero_afectado,
           m.mae_estado_afiliacion_valor AS estado_afiliacion,
           m.mae_regimen_valor AS regimen_afiliacion,
           m.mae_grupo_poblacional_valor AS grupo_poblacional,
           CASE coalesce(m.discapacidad, p.discapacidad) WHEN 0 THEN 'NO' ELSE 'SI' END
               AS discapacidad_afectado,
           dep.prefijo || mun.prefijo AS cod_divipola_afiliacion,
           CASE mun.descripcion WHEN 'MEDELLÍN' THEN 'MEDELLIN' ELSE mun.descripcion END
               AS mpio_afiliacion,
           {_REGION.format("mun.mae_region_valor")} AS region_afiliacion,
           cdep.prefijo || cmun.prefijo AS cod_pqrd, cmun.nombre AS municipio_pqrd,
           CAST(c.id AS VARCHAR) AS numero_solicitud_pqrsf, c.radicado AS radicado_SNS,
           c.fecha_hora_crea AS fecha_creacion_caso,
           CASE c.mae_solicitud_riesgo_vidal_valor WHEN 'No aplica' THEN 'Peticion general'
                WHEN 'Regular' THEN 'Simple' ELSE c.mae_solicitud_riesgo_vidal_valor END
               AS riesgo_vida,
           c.mae_solicitud_estado_valor AS estado_caso,
           c.mae_solicitud_origen_valor AS origen_pqrd,
           c.mae_solicitud_tipo_valor AS tipo_solicitud,
           c.mae_solicitud_ente_contro_valor AS ente_control,
           coalesce(c.mae_motivo_especifico_valor, s.mae_servicio_motivo_valor)
               AS motivo_especifico,
           c.mae_tipo_motivo_especifico_valor AS tipo_motivo_especifico,
           c.mae_subtipo_motivo_especifico_valor AS subtipo_motivo_especifico,
           k.closed_at AS fecha_cierre_caso,
           CAST(c.cantidad_servicios AS INTEGER) AS cantidad_servicios,
           CASE s.medicamento WHEN 0 THEN 'NO' WHEN 1 THEN 'SI' END AS medicamento,
           CASE s.servicio_atribuido_ips WHEN 0 THEN 'NO' WHEN 1 THEN 'SI'
                WHEN 3 THEN 'No aplica' END AS servicio_atribuido_ips,
           coalesce(u.documento, pr.numero_documento) AS nit_responsable_respuesta,
           {_cleansed("upper(coalesce(u.nombre, s.cnt_prestador_sede_destino_valor))",
                      NAME_REMOVALS)} AS IPS_responsable_respuesta,
           s.mae_servicio_ambito_valor AS ambito_servicio,
           coalesce(r.cerrado, r.resuelto) AS fecha_cierre_servicio,
           s.ma_tecnologia_codigo AS codigo_servicio_pqrd,
           s.ma_tecnologia_valor AS descripcion_servicio_pqrd,
           {_REOPENED} AS reabierto_Supersalud
    FROM aus_casos c
    LEFT JOIN aus_personas p ON p.id = c.aus_personas_id
    LEFT JOIN aus_persona_telefonos ph ON ph.aus_personas_id = p.id
    LEFT JOIN gn_ubicaciones cmun ON cmun.id = c.gn_ubicaciones_id
    LEFT JOIN gn_ubicaciones cdep ON cdep.id = cmun.gn_ubicaciones_id
    LEFT JOIN aseg_afiliados m ON m.numero_documento = p.documento
    LEFT JOIN gn_ubicaciones mun ON mun.id = m.residencia_ubicacion_id
    LEFT JOIN gn_ubicaciones dep ON dep.id = mun.gn_ubicaciones_id
    LEFT JOIN aus_caso_servicios s ON s.aus_casos_id = c.id
    LEFT JOIN gn_usuarios u ON u.id = s.gn_usuarios_asignado_id
    LEFT JOIN cnt_prestadores pr ON pr.id = s.cnt_prestador_sede_destino_id
    LEFT JOIN closed k ON k.aus_casos_id = c.id
    LEFT JOIN reached r ON r.aus_servicios_id = s.id
    WHERE c.borrado <> 1 AND year(c.fecha_hora_crea) >= 1998""", _CLOSED, _RANKED)


def _consolidated(closed: str, year: int, provider_key: str, name: str, modified: str) -> str:
    return _with(
        ["aus_casos", "aus_caso_servicios", "aus_seguimientos", "aus_servicio_gestiones",
         "aus_personas", "aseg_afiliados", "gn_ubicaciones", "gn_usuarios",
         "cnt_prestadores", "cnt_prestador_sedes"], f"""
        SELECT c.id AS numero_solicitud_pqrsf, c.radicado AS radicado_SNS,
               s.id AS numero_servicio, w.tipo AS tipo_identificacion_afectado,
               w.documento AS identificacion_afectado,
               CAST(w.fecha_nacimiento AS VARCHAR) AS fecha_nacimiento_afectado, w.edad,
               w.genero AS genero_afectado, w.estado_afiliacion, w.regimen_afiliacion,
               w.grupo_poblacional, w.discapacidad AS discapacidad_afectado,
               w.cod_divipola_afiliacion, w.mpio_afiliacion, w.region_afiliacion,
               c.fecha_hora_crea AS fecha_creacion_caso,
               coalesce(k.closed_at, r.resuelto, r.cerrado) AS fecha_cierre_caso,
               {_REOPENED} AS reabierto_supersalud,
               CASE c.mae_solicitud_estado_valor WHEN 'Solucionado' THEN 'Cerrado'
                    ELSE c.mae_solicitud_estado_valor END AS estado_caso,
               c.mae_solicitud_riesgo_vidal_valor AS riesgo_de_vida,
               c.mae_solicitud_origen_valor AS origen_pqrs,
               c.mae_solicitud_tipo_valor AS tipo_solicitud,
               c.mae_solicitud_ente_contro_valor AS ente_control,
               s.mae_estado_valor AS estado_servicio,
               s.ma_tecnologia_codigo AS cod_servicio, s.ma_tecnologia_valor AS des_servicio,
               r.asignado AS fecha_asignacion_servicio,
               coalesce(r.cerrado, r.resuelto) AS fecha_solucion_servicio, {modified}
               CASE WHEN s.medicamento = 1 THEN 'SI' ELSE 'NO' END AS medicamento,
               CASE s.servicio_atribuido_ips WHEN 1 THEN 'SI' WHEN 3 THEN 'No aplica'
                    ELSE 'NO' END AS servicio_atribuido_ips,
               upper(resp.nombre) AS responsable_caso,
               upper(asig.nombre) AS usuario_asignado_servicio,
               {name} AS IPS_responsable_respuesta,
               pr.numero_documento AS nit_responsable_respuesta
        FROM aus_casos c
        LEFT JOIN who w ON w.person_id = c.aus_personas_id
        LEFT JOIN aus_caso_servicios s ON s.aus_casos_id = c.id
        LEFT JOIN closed k ON k.aus_casos_id = c.id
        LEFT JOIN reached r ON r.aus_servicios_id = s.id
        LEFT JOIN gn_usuarios resp ON resp.id = c.gn_usuarios_responsable_id
        LEFT JOIN gn_usuarios asig ON asig.id = s.gn_usuarios_asignado_id
        LEFT JOIN cnt_prestador_sedes site ON site.id = s.cnt_prestador_sede_destino_id
        LEFT JOIN cnt_prestadores pr ON pr.id = site.{provider_key}
        WHERE {_LIVE} AND year(c.fecha_hora_crea) >= {year}""", closed, _REACHED, f"""who AS (
        SELECT p.id AS person_id, p.mae_tipo_documento_codigo AS tipo, p.documento,
               m.fecha_nacimiento, {_age("m.fecha_nacimiento", "365.25")} AS edad,
               coalesce(p.mae_sexo_codigo, m.mae_genero_codigo) AS genero,
               m.mae_estado_afiliacion_valor AS estado_afiliacion,
               m.mae_regimen_valor AS regimen_afiliacion,
               m.mae_grupo_poblacional_valor AS grupo_poblacional,
               CASE WHEN coalesce(m.discapacidad, p.discapacidad) = 0 THEN 'NO' ELSE 'SI' END
                   AS discapacidad,
               dep.prefijo || mun.prefijo AS cod_divipola_afiliacion,
               CASE mun.descripcion WHEN 'MEDELLÍN' THEN 'MEDELLIN' ELSE mun.descripcion END
                   AS mpio_afiliacion,
               upper({_REGION.format("g.mae_region_valor")}) AS region_afiliacion
        FROM aus_personas p
        LEFT JOIN aseg_afiliados m ON m.numero_documento = p.documento
              AND m.mae_tipo_documento_codigo = p.mae_tipo_documento_codigo
        LEFT JOIN gn_ubicaciones mun ON mun.id = m.residencia_ubicacion_id
        LEFT JOIN gn_ubicaciones dep ON dep.id = mun.gn_ubicaciones_id
        LEFT JOIN gn_ubicaciones g ON g.id = m.afiliacion_ubicaciones_id)""")


_SITE_NAME_SHORT = ("CASE WHEN site.id IS NOT NULL THEN "
                    + _cleansed("upper(coalesce(site.nombre, ''))", [";", ",", "\r", "\n"])
                    + " END")
_SITE_NAME_LONG = _cleansed(
    "upper(coalesce(site.nombre, s.cnt_prestador_sede_destino_valor))",
    [";", ",", "\r", "\n", "\t", '"', "&quot", "\r\n", "\n"])


def _tracking(measure: str) -> str:
    closed_state = "mae_solicitud_estado_valor IN ('Cerrado', 'Solucionado')"
    scope = f"{closed_state} AND year(closed_at) IN (1998, 1999)"

    def part(when: str, tag: str, condition: str) -> str:
        return f"""
        SELECT CAST(year({when}) AS INTEGER) AS anio, CAST(month({when}) AS INTEGER) AS mes,
               '{tag}' AS grupo_caso, origen, mae_tipo_documento_codigo, documento,
               municipio_afiliacion, region_afiliacion, {measure} AS Nro_pqrd
        FROM base WHERE {condition} GROUP BY ALL"""

    same = "strftime(created, '%Y%m') = strftime(closed_at, '%Y%m')"
    other = "strftime(created, '%Y%m') <> strftime(closed_at, '%Y%m')"
    body = " UNION ALL ".join([
        part("created", "1-Creados", "year(created) IN (1998, 1999)"),
        part("closed_at", "2-Cerrado el mismo mes",
             f"{scope} AND year(created) IN (1998, 1999) AND {same}"),
        part("closed_at", "3-Cerrado meses anteriores", f"{scope} AND {other}"),
        part("created", "4-Abiertos",
             "mae_solicitud_estado_valor NOT IN ('Cerrado', 'Solucionado') "
             "AND year(created) IN (1999, 2000)"),
    ])
    return _with(
        ["aus_casos", "aus_seguimientos", "aus_personas", "aseg_afiliados",
         "gn_ubicaciones"], body, _CLOSED, f"""base AS (
        SELECT c.id AS case_id, c.fecha_hora_crea AS created, k.closed_at,
               c.mae_solicitud_estado_valor,
               CASE c.mae_solicitud_origen_codigo WHEN 9 THEN 'Supersalud'
                    ELSE 'Otros canales' END AS origen,
               p.mae_tipo_documento_codigo, p.documento, g.nombre AS municipio_afiliacion,
               {_REGION.format("g.mae_region_valor")} AS region_afiliacion
        FROM aus_casos c
        LEFT JOIN closed k ON k.aus_casos_id = c.id
        LEFT JOIN aus_personas p ON p.id = c.aus_personas_id
        LEFT JOIN aseg_afiliados m ON {_OR_MATCH}
        LEFT JOIN gn_ubicaciones g ON g.id = m.afiliacion_ubicaciones_id
        WHERE {_LIVE})""")


_CONTRACT_JOINS = """
    FROM cnt_contrato_detalles d
    JOIN cnt_contrato_sedes cs ON cs.id = d.cnt_contrato_sedes_id
         AND cs.cnt_contratos_id = d.cnt_contratos_id
    JOIN cnt_contratos c ON c.id = d.cnt_contratos_id
    LEFT JOIN cnt_prestadores pr ON pr.id = c.cnt_prestadores_id
    LEFT JOIN cnt_prestador_sedes site ON site.id = cs.cnt_prestador_sedes_id
    LEFT JOIN gn_ubicaciones g ON g.id = site.ubicacion_id
    WHERE d.activo = 1 AND d.tipo_tecnologia IN ({types})"""
_CONTRACT_COLUMNS = """
    pr.numero_documento, pr.razon_social, c.contrato,
    CAST(c.fecha_inicio AS VARCHAR) AS fecha_inicio, CAST(c.fecha_fin AS VARCHAR) AS fecha_fin,
    CASE d.tipo_tecnologia WHEN 1 THEN 'Tecnologia' WHEN 2 THEN 'Medicamento'
         WHEN 3 THEN 'Insumo' WHEN 4 THEN 'Paquete' END AS Desctipo_tecnologia,
    d.ma_servicio_habilitacion_codigo, d.ma_servicio_habilitacion_valor,
    g.nombre, g.mae_region_valor"""
_CONTRACT_TABLES = ["cnt_contratos", "cnt_contrato_sedes", "cnt_contrato_detalles",
                    "cnt_prestadores", "cnt_prestador_sedes", "gn_ubicaciones"]

_TARIFFS = _with(_CONTRACT_TABLES, f"""
    SELECT DISTINCT {_CONTRACT_COLUMNS}, d.ma_tecnologia_codigo AS codigo_tecnologia,
           d.ma_tecnologia_valor, CAST(d.valor_manual AS DOUBLE) AS valor_manual,
           CAST(d.valor_contratado AS DOUBLE) AS valor_contratado, d.complejidad,
           cs.mae_modalidad_contrato_valor
    {_CONTRACT_JOINS.format(types="1, 2, 3, 4")}""")
_NETWORK = _with(_CONTRACT_TABLES, f"""
    SELECT DISTINCT {_CONTRACT_COLUMNS} {_CONTRACT_JOINS.format(types="1, 4")}""")


def _subregion_case(column: str, classes, default: str) -> str:
    arms = " ".join(
        f"WHEN {column} IN ({', '.join(_text(n) for n in names)}) THEN {_text(label)}"
        for label, names in classes.items())
    return f"CASE {arms} ELSE {_text(default)} END"


_AUTHORIZATION = _with(["au_anexos3", "au_anexos4", "au_anexo4_items"], f"""
    SELECT CAST(q.fecha_solicitud AS VARCHAR) AS fecha_solicitud,
           CAST(a.fecha_autorizacion AS VARCHAR) AS fecha_autorizacion,
           CAST(date_diff('day', q.fecha_solicitud, a.fecha_autorizacion) AS INTEGER)
               AS dias_espera,
           a.afiliado_tipo_documento, a.afiliado_numero_documento,
           a.afiliado_primer_apellido, a.afiliado_segundo_apellido,
           a.afiliado_primer_nombre, a.afiliado_segundo_nombre,
           CAST(a.afiliado_fecha_nacimiento AS VARCHAR) AS afiliado_fecha_nacimiento,
           a.diagnostico_principal, a.afiliado_municipio,
           a.mae_modalidad_tecnologia_codigo, a.mae_modalidad_tecnologia_valor,
           i.ma_tecnologia_codigo, i.ma_tecnologia_valor, i.cantidad_autorizada,
           i.fecha_hora_crea, a.numero_autorizacion,
           {_subregion_case("upper(a.afiliado_municipio)", SUBREGIONS, UNCLASSIFIED)}
               AS subregion_ant
    FROM au_anexo4_items i
    JOIN au_anexos4 a ON a.id = i.au_anexos4_id
    JOIN au_anexos3 q ON q.id = a.au_anexos3_id
    WHERE i.ma_tecnologia_codigo IN ('890208', '890308', '890284', '890384')
      AND q.fecha_solicitud >= DATE '1997-01-01' AND q.fecha_solicitud <= DATE '1998-03-31'""")

_PRODUCTIVITY = _with(
    ["aus_casos", "aus_caso_servicios", "aus_seguimientos", "aus_servicio_gestiones",
     "gn_ubicaciones", "gn_usuarios"], f"""
    SELECT *, count(fecha_interaccion) AS interacciones FROM (
        SELECT l.aus_casos_id AS id_caso, l.id, c.fecha_hora_crea AS fecha_creacion_caso,
               upper(u.nombre) AS responsable_caso, c.mae_solicitud_origen_valor AS origen,
               c.mae_solicitud_riesgo_vidal_valor AS riesgo_vida,
               c.mae_solicitud_estado_valor AS estado_caso_servicio,
               g.nombre AS mpio_caso, {_REGION.format("g.mae_region_valor")} AS region,
               l.usuario_crea AS usuario, l.mae_estado_valor AS estado_interaccion,
               'Casos' AS grupo, l.fecha_hora_crea AS fecha_interaccion
        FROM aus_seguimientos l
        LEFT JOIN aus_casos c ON c.id = l.aus_casos_id
        LEFT JOIN gn_ubicaciones g ON g.id = c.gn_ubicaciones_id
        LEFT JOIN gn_usuarios u ON u.id = c.gn_usuarios_responsable_id
        WHERE year(l.fecha_hora_crea) > 1998 AND c.borrado <> 1
        UNION ALL
        SELECT s.aus_casos_id, s.id, c.fecha_hora_crea, upper(u.nombre),
               c.mae_solicitud_origen_valor, c.mae_solicitud_riesgo_vidal_valor,
               s.mae_estado_valor, g.nombre, {_REGION.format("g.mae_region_valor")},
               l.usuario_crea, l.mae_estado_valor, 'Servicios', l.fecha_hora_crea
        FROM aus_servicio_gestiones l
        LEFT JOIN aus_caso_servicios s ON s.id = l.aus_servicios_id
        LEFT JOIN aus_casos c ON c.id = s.aus_casos_id
        LEFT JOIN gn_ubicaciones g ON g.id = c.gn_ubicaciones_id
        LEFT JOIN gn_usuarios u ON u.id = c.gn_usuarios_responsable_id
        WHERE year(l.fecha_hora_crea) > 1998 AND c.borrado <> 1) AS entries
    GROUP BY ALL""")

# Feed -> (table, filter date, event date, output name, source column of each column).
_FEED_SQL = {
    "consulta": ("RIPS_AC_LLAVE", "fecha_hora_crea", "fecha_consulta", [
        ("fecha_consulta", "fecha_consulta"), ("codigo_consulta", "ma_tecnologia_codigo"),
        ("finalidad_consulta", "mae_finalidad_consulta_codigo"),
        ("causa_externa", "mae_causa_externa_codigo"),
        ("dx_principal", "ma_diagnostico_principal_codigo"),
        ("dx_relacionado_1", "ma_diagnostico_relacionado1_codigo"),
        ("dx_relacionado_2", "ma_diagnostico_relacionado2_codigo"),
        ("dx_relacionado_3", "ma_diagnostico_relacionado3_codigo")]),
    "urgencia": ("RIPS_AU_LLAVE", "fecha_ingreso", "fecha_ingreso", [
        ("fecha_ingreso", "fecha_ingreso"), ("causa_externa", "mae_causa_externa_valor"),
        ("dx_salida", "ma_diagnostico_salida_valor"),
        ("dx_relacionado_1", "ma_diagnostico_relacionado1_valor"),
        ("dx_relacionado_2", "ma_diagnostico_relacionado2_valor"),
        ("dx_relacionado_3", "ma_diagnostico_relacionado3_valor"),
        ("destino_salida", "mae_destino_salida_valor"),
        ("estado_salida", "mae_estado_salida_valor"),
        ("causa_muerte", "mae_causa_externa_valor"), ("fecha_salida", "fecha_salida")]),
    "hospitalizacion": ("RIPS_AH_LLAVE", "fecha_ingreso", "fecha_ingreso", [
        ("via_ingreso", "mae_via_ingreso_valor"), ("fecha_ingreso", "fecha_ingreso"),
        ("causa_externa", "mae_causa_externa_valor"),
        ("dx_ingreso", "ma_diagnostico_ingreso_valor"),
        ("dx_egreso", "ma_diagnostico_egreso_valor"),
        ("dx_relacionado_1", "ma_diagnostico_relacionado1_valor"),
        ("dx_relacionado_2", "ma_diagnostico_relacionado2_valor"),
        ("dx_relacionado_3", "ma_diagnostico_relacionado3_valor"),
        ("estado_salida", "EstadoSalida"), ("dx_muerte", "ma_diagnostico_muerte_codigo"),
        ("fecha_salida", "fecha_salida")]),
    "procedimiento": ("RIPS_AP_LLAVE", "fecha_procedimiento", "fecha_procedimiento", [
        ("fecha_procedimiento", "fecha_procedimiento"),
        ("codigo_procedimiento", "ma_tecnologia_codigo"),
        ("ambito", "mae_ambito_atencion_codigo_valor"),
        ("finalidad_procedimiento", "mae_finalidad_procedimiento_valor"),
        ("dx_principal", "ma_diagnostico_principal_valor"),
        ("dx_relacionado_1", "ma_diagnostico_relacionado1_valor")]),
}


def _feed_select(feed: str, timeline: bool) -> str:
    table, filter_date, event_date, columns = _FEED_SQL[feed]

    def value(source: str) -> str:
        return f"CAST({source} AS VARCHAR)" if source.startswith("fecha") else source

    head = [f"'{feed}' AS origen", f"CAST({event_date} AS VARCHAR) AS fecha"]
    if timeline:
        columns = [c for c in columns if c[1] != event_date]
    names = [("codigo_prestador", "codigo_reps"),
             ("tipo_identificacion", "mae_tipo_documento_codigo"),
             ("numero_identificacion", "documento_afiliado"), *columns]
    wanted = [*(head if timeline else []), *[f"{value(s)} AS {o}" for o, s in names]]
    return (f"SELECT {', '.join(wanted)} FROM {table} "
            f"WHERE documento_afiliado = '{PERSON}' AND {filter_date} >= DATE '1998-01-01'")


def _feed(feed: str) -> str:
    return _with([_FEED_SQL[feed][0]], _feed_select(feed, timeline=False))


# Case is mapped one character to one, so the sharp s keeps its form.
_DOCUMENT_TEXT = _cleansed("replace(upper(replace(text, 'ß', chr(1))), chr(1), 'ß')",
                           NAME_REMOVALS)
_CODE = """CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN ' ' ELSE '' END
    || CAST(p_size AS VARCHAR)
    || CASE p_partkey % 3 WHEN 0 THEN 'x9' WHEN 1 THEN '.0' ELSE '' END"""
_CODE_NUMBER = ("coalesce(try_cast(regexp_extract(code, '^ *([0-9]+([.][0-9]*)?)', 1)"
                " AS DOUBLE), 0)")

ORACLE: dict[str, str] = {
    "latest_status": """
        SELECT user_id, event_id, ts, event_type, value, props FROM events
        WHERE event_type = 'error'
        QUALIFY row_number() OVER (PARTITION BY user_id
                                   ORDER BY ts DESC NULLS LAST, event_id DESC) = 1""",
    "first_status": """
        SELECT user_id, event_id, ts, value FROM events WHERE event_type = 'view'
        QUALIFY row_number() OVER (PARTITION BY user_id
                                   ORDER BY ts ASC NULLS FIRST, event_id) = 1""",
    "latest_keep_ties": """
        SELECT l_orderkey, l_shipdate, l_partkey, l_linenumber FROM lineitem l
        WHERE l_returnflag = 'R' AND l_shipdate = (
            SELECT max(x.l_shipdate) FROM lineitem x
            WHERE x.l_orderkey = l.l_orderkey AND x.l_returnflag = 'R')""",
    "latest_one": """
        SELECT l_orderkey, max(l_shipdate) AS l_shipdate FROM lineitem
        WHERE l_returnflag = 'R' GROUP BY l_orderkey""",
    "milestones": f"WITH {_EVENT_REACHED} SELECT user_id, {_FIRSTS} FROM reached",
    "milestones_lookup": f"""
        WITH {_EVENT_REACHED} SELECT c_custkey, c_name, {_FIRSTS}
        FROM customer LEFT JOIN reached ON user_id = c_custkey""",
    "closing_precedence": f"""
        WITH {_EVENT_REACHED}, last AS (
            SELECT user_id, max(ts) AS closed FROM events
            WHERE event_type = 'error' AND user_id % 3 = 0 GROUP BY user_id),
        dated AS (
            SELECT r.user_id, closed, first_click AS ended,
                   CASE WHEN r.user_id % 2 = 0 THEN first_purchase END AS solved
            FROM reached r LEFT JOIN last USING (user_id))
        SELECT user_id, coalesce(closed, solved) AS closing_a,
               coalesce(closed, solved, ended) AS closing_b, closed AS closing_c
        FROM dated""",
    "latest_inner": """
        SELECT c_custkey, c_name, ts, event_id, value
        FROM customer JOIN events ON user_id = c_custkey WHERE event_type = 'purchase'
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "hierarchy_code": _with(["gn_ubicaciones"], """
        SELECT c_custkey, m.nombre, d.nombre AS parent_nombre, d.prefijo || m.prefijo AS code
        FROM customer
        LEFT JOIN gn_ubicaciones m ON m.id = (c_nationkey + 7) % 27
        LEFT JOIN gn_ubicaciones d ON d.id = m.gn_ubicaciones_id"""),
    "role_playing": """
        SELECT cn.n_name AS customer_n_name, sn.n_name AS supplier_n_name, count(*) AS lines
        FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
        LEFT JOIN customer ON c_custkey = o_custkey
        LEFT JOIN supplier ON s_suppkey = l_suppkey
        LEFT JOIN nation cn ON cn.n_nationkey = c_nationkey
        LEFT JOIN nation sn ON sn.n_nationkey = s_nationkey
        GROUP BY ALL""",
    "match_strict": _match(
        "m.numero_documento = p.documento "
        "AND m.mae_tipo_documento_codigo = p.mae_tipo_documento_codigo"),
    "match_document": _match("m.numero_documento = p.documento"),
    "match_type_or_truthy": _match(_OR_MATCH),
    "inner_two_keys": """
        SELECT l.l_orderkey, l.l_suppkey, l_partkey, l_linenumber, site_lines
        FROM lineitem l JOIN (
            SELECT l_orderkey, l_suppkey, count(*) AS site_lines FROM lineitem
            GROUP BY l_orderkey, l_suppkey) s
        ON s.l_orderkey = l.l_orderkey AND s.l_suppkey = l.l_suppkey""",
    "match_strict_folded": _with(["aus_personas", "aseg_afiliados"], """
        SELECT p.id AS person_id, lower(p.mae_tipo_documento_codigo) AS mae_tipo_documento_codigo,
               p.documento || CASE p.id % 2 WHEN 0 THEN 'x\u00e9' ELSE 'XE' END AS documento,
               m.mae_regimen_valor,
               CAST(m.residencia_ubicacion_id AS BIGINT) AS residencia_ubicacion_id
        FROM aus_personas p LEFT JOIN aseg_afiliados m
        ON lower(strip_accents(m.numero_documento || 'Xe')) = lower(strip_accents(
               p.documento || CASE p.id % 2 WHEN 0 THEN 'x\u00e9' ELSE 'XE' END))
        AND lower(strip_accents(m.mae_tipo_documento_codigo)) =
            lower(strip_accents(p.mae_tipo_documento_codigo))"""),
    "provider_chain": _with(
        ["aus_caso_servicios", "cnt_prestador_sedes", "cnt_prestadores"], """
        SELECT s.id, s.aus_casos_id, s.cnt_prestador_sede_destino_id,
               a.numero_documento AS nit_by_id, b.numero_documento AS nit_by_cnt_prestador_id
        FROM aus_caso_servicios s
        LEFT JOIN cnt_prestador_sedes site ON site.id = s.cnt_prestador_sede_destino_id
        LEFT JOIN cnt_prestadores a ON a.id = site.id
        LEFT JOIN cnt_prestadores b ON b.id = site.cnt_prestador_id"""),
    "loaded_tables": """
        SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, n_name
        FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""",
    "count_folded": """
        SELECT min(priority) AS priority, o_orderstatus, count(*) AS cases
        FROM (SELECT CASE o_orderkey % 2 WHEN 0 THEN lower(o_orderpriority)
                     ELSE translate(o_orderpriority, 'EI', '\u00c9\u00cd') END AS priority, o_orderstatus
              FROM orders)
        GROUP BY lower(strip_accents(priority)), o_orderstatus""",
    "count_known_times": _with(["aus_servicio_gestiones"], """
        SELECT mae_estado_valor, count(fecha_hora_crea) AS known
        FROM aus_servicio_gestiones GROUP BY 1"""),
    "distinct_after_fanout": """
        SELECT DISTINCT c_nationkey, c_mktsegment
        FROM customer LEFT JOIN events ON user_id = c_custkey""",
    "year_filters": """
        SELECT o_orderkey, o_orderdate, 'min_year' AS form FROM orders
        WHERE year(o_orderdate) > 1998
        UNION ALL SELECT o_orderkey, o_orderdate, 'years' FROM orders
        WHERE year(o_orderdate) IN (1996, 1998, 1999)
        UNION ALL SELECT o_orderkey, o_orderdate, 'between' FROM orders
        WHERE o_orderdate BETWEEN TIMESTAMP '1997-02-01' AND TIMESTAMP '1997-03-31'
        UNION ALL SELECT o_orderkey, o_orderdate, 'whole_last_day' FROM orders
        WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-02-01' AND DATE '1997-03-31'""",
    "same_month": """
        SELECT l_orderkey, l_linenumber, o_orderdate, l_shipdate,
               (CAST(year(o_orderdate) AS VARCHAR) || CAST(month(o_orderdate) AS VARCHAR))
               = (CAST(year(l_shipdate) AS VARCHAR) || CAST(month(l_shipdate) AS VARCHAR))
                   AS same
        FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""",
    "exclude_codes": _with(["aus_casos"], """
        SELECT id, CAST(mae_solicitud_tipo_codigo AS INTEGER) AS mae_solicitud_tipo_codigo,
               mae_solicitud_estado_valor
        FROM aus_casos c
        WHERE mae_solicitud_tipo_codigo <> 3 AND mae_solicitud_tipo_codigo <> 9
          AND mae_solicitud_tipo_codigo <> 10 AND borrado <> 1
          AND mae_solicitud_estado_valor <> 'Cerrado'
          AND mae_solicitud_estado_valor <> 'Solucionado'"""),
    "case_flags": _with(["aus_casos"], f"""
        SELECT id,
               CASE mae_solicitud_estado_valor WHEN 'Solucionado' THEN 'Cerrado'
                    ELSE mae_solicitud_estado_valor END AS state,
               CASE mae_solicitud_origen_codigo WHEN 9 THEN 'Supersalud'
                    ELSE 'Otros canales' END AS origin,
               CASE mae_solicitud_riesgo_vidal_valor WHEN 'No aplica' THEN 'Peticion general'
                    WHEN 'Regular' THEN 'Simple' ELSE mae_solicitud_riesgo_vidal_valor END
                   AS risk,
               CASE mae_solicitud_tipo_codigo WHEN 0 THEN 'NO' WHEN 1 THEN 'SI'
                    WHEN 3 THEN 'No aplica' END AS flag_or_null,
               CASE mae_solicitud_tipo_codigo WHEN 1 THEN 'SI' WHEN 3 THEN 'No aplica'
                    ELSE 'NO' END AS flag_or_no,
               {_REOPENED} AS reopened
        FROM aus_casos c"""),
    "label_fold": _with(["au_anexos4"], """
        SELECT id, afiliado_municipio,
               lower(strip_accents(afiliado_municipio)) = 'medellin' AS is_medellin,
               lower(strip_accents(afiliado_municipio)) = 'el penol' AS is_penol,
               afiliado_municipio = 'MEDELLIN' AS is_medellin_binary
        FROM au_anexos4"""),
    "loose_compare": f"""
        SELECT p_partkey, code, {_CODE_NUMBER} = 11 AS is_11, {_CODE_NUMBER} = 0 AS is_0,
               {_CODE_NUMBER} <> 0 AS truthy
        FROM (SELECT p_partkey, {_CODE} AS code FROM part) AS coded""",
    "age": f"""
        SELECT o_orderkey, {_age("o_orderdate", "365.25")} AS age_36525,
               {_age("o_orderdate", "365.2")} AS age_3652,
               {_age("o_orderdate", "365.25", "1996-06-01")} AS age_signed,
               CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') AS INTEGER)
                   AS days
        FROM orders""",
    "cleanse_text": f"""
        SELECT doc_id, CAST(length({_DOCUMENT_TEXT}) AS BIGINT) AS length,
               md5({_DOCUMENT_TEXT}) AS digest
        FROM documents""",
    "subregion": f"""
        SELECT c_custkey, c_nationkey, lower(n_name) AS name,
               {_subregion_case("n_name", SUBREGION_SAMPLE, "none")} AS subregion
        FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "case_detail": _CASE_DETAIL,
    "wide_detail": _WIDE_DETAIL,
    "consolidated_ties": _consolidated(
        _CLOSED_TIES, 1998, "id", _SITE_NAME_SHORT,
        "c.fecha_hora_modifica AS fecha_modificacion_caso,"),
    "consolidated_one": _consolidated(
        _CLOSED, 1997, "cnt_prestador_id", _SITE_NAME_LONG, ""),
    "monthly_tracking": _tracking("count(*)"),
    "monthly_tracking_distinct": _tracking("count(DISTINCT case_id)"),
    "productivity": _PRODUCTIVITY,
    "members_by_municipality": _with(["aseg_afiliados", "gn_ubicaciones"], """
        SELECT d.prefijo || m.prefijo AS cod_municipio_afiliacion,
               count(*) AS cantidad_afiliados
        FROM aseg_afiliados a
        LEFT JOIN gn_ubicaciones m ON m.id = a.afiliacion_ubicaciones_id
        LEFT JOIN gn_ubicaciones d ON d.id = m.gn_ubicaciones_id
        WHERE a.mae_estado_afiliacion_valor = 'activo' GROUP BY 1"""),
    # Other spellings of the labels that are compared must change nothing.
    "case_detail_folded": _CASE_DETAIL,
    "monthly_tracking_folded": _tracking("count(*)"),
    "members_by_municipality_folded": _with(["aseg_afiliados", "gn_ubicaciones"], """
        SELECT d.prefijo || m.prefijo AS cod_municipio_afiliacion,
               count(*) AS cantidad_afiliados
        FROM aseg_afiliados a
        LEFT JOIN gn_ubicaciones m ON m.id = a.afiliacion_ubicaciones_id
        LEFT JOIN gn_ubicaciones d ON d.id = m.gn_ubicaciones_id
        WHERE lower(strip_accents(a.mae_estado_afiliacion_valor)) = 'activo' GROUP BY 1"""),
    "hierarchy_roots": """
        SELECT o_orderkey, first_value(o_orderkey) OVER by_customer AS root,
               row_number() OVER by_customer - 1 AS depth, false AS in_cycle
        FROM orders WINDOW by_customer AS (PARTITION BY o_custkey
                                           ORDER BY o_orderdate, o_orderkey)""",
    "label_pruned": """
        SELECT event_id, user_id, event_type FROM events
        WHERE lower(strip_accents(event_type)) IN ('error', 'purchase')""",
    "catalog_tables": """
        SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name,
               CAST(n_regionkey AS BIGINT) AS n_regionkey, r_name
        FROM nation LEFT JOIN region ON r_regionkey = n_regionkey""",
    "contract_tariffs": _TARIFFS,
    "contract_network": _NETWORK,
    "contract_tariffs_folded": _spelt_twice(
        _TARIFFS, "cnt_contrato_detalles", SPELT_TARIFF, SPELT_TARIFF),
    "contract_network_folded": _spelt_twice(
        _NETWORK, "cnt_contrato_detalles", SPELT_TARIFF, SPELT_TARIFF[1:]),
    "wide_detail_folded": _spelt_twice(
        _WIDE_DETAIL, "aus_caso_servicios", SPELT_SERVICE,
        ["descripcion_servicio_pqrd", "ambito_servicio"]),
    "productivity_folded": _spelt_twice(
        _PRODUCTIVITY, "aus_servicio_gestiones", ["mae_estado_valor"],
        ["estado_interaccion"], summed="interacciones"),
    "authorization_wait": _AUTHORIZATION,
    "person_history": _with(
        [table for table, *_ in _FEED_SQL.values()],
        " UNION ALL BY NAME ".join(_feed_select(f, timeline=True) for f in _FEED_SQL)),
    "history_consultations": _feed("consulta"),
    "history_urgent": _feed("urgencia"),
    "history_stays": _feed("hospitalizacion"),
    "history_procedures": _feed("procedimiento"),
    "history_labels": _with([_FEED_SQL["urgencia"][0]], f"""
        SELECT {", ".join(f'{o} AS "{label}"' for o, label in URGENCY_LABELS.items())}
        FROM ({_feed_select("urgencia", timeline=False)}) AS rows"""),
}
# Other ways to the same rows.
for _name, _same in {"milestones_incremental": "milestones", "latest_incremental": "latest_status",
                     "landed_history": "person_history", "landed_wait": "authorization_wait",
                     "consolidated_reduced": "consolidated_one"}.items():
    ORACLE[_name] = ORACLE[_same]
