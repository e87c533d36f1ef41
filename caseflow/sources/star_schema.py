"""The domain tables derived from the star-schema tables used for checks and benches.

Orders play the cases, line items their services and both status logs, customers the
persons and members, suppliers the users, sites and providers, nations and regions the
location hierarchy. Every table grows with the table it is derived from. Codes, NULLs,
dirty names and repeated documents are spread by arithmetic on the keys, so that the
reports meet every case they have to decide.

The statements keep to SQL that Spark and DuckDB share, because the checks define the
same tables on both sides; ``{name}`` stands for an input table and ``{explode}`` for
the row generator of the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseflow.sources.loader import conform
from caseflow.sources.schemas import registry

# Line items have no key; this one is unique but for a handful of rows.
_LINE_ID = "((l_orderkey * 1000000 + l_partkey % 1000000) * 8 + l_linenumber)"

DOMAIN_SQL = {
    "aus_casos": """
        SELECT o_orderkey AS id,
               'RAD-' || CAST(o_orderkey AS STRING) AS radicado,
               CASE WHEN o_orderkey % 50 = 3 THEN NULL ELSE o_custkey END AS aus_personas_id,
               o_orderkey % 113 AS gn_usuarios_responsable_id,
               o_custkey % 27 AS gn_ubicaciones_id,
               CASE o_orderstatus WHEN 'F' THEN 'Cerrado' WHEN 'P' THEN 'Solucionado'
                    ELSE CASE WHEN o_orderkey % 40 = 7 THEN NULL ELSE 'Radicado' END
               END AS mae_solicitud_estado_valor,
               CASE WHEN o_orderkey % 13 = 12 THEN NULL ELSE o_orderkey % 13 END
                   AS mae_solicitud_tipo_codigo,
               'Tipo ' || CAST(o_orderkey % 13 AS STRING) AS mae_solicitud_tipo_valor,
               1 + o_orderkey % 9 AS mae_solicitud_origen_codigo,
               o_orderpriority AS mae_solicitud_origen_valor,
               CASE o_orderpriority WHEN '5-LOW' THEN 'No aplica'
                    WHEN '3-MEDIUM' THEN 'Regular' WHEN '1-URGENT' THEN 'Vital'
                    WHEN '2-HIGH' THEN 'Priorizado' END AS mae_solicitud_riesgo_vidal_valor,
               CASE WHEN o_orderkey % 4 = 0 THEN 'Ente A' END AS mae_solicitud_ente_contro_valor,
               CASE o_orderkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '1' END
                   AS mae_motivo_reabre_codigo,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL
                    ELSE 'Motivo ' || CAST(o_orderkey % 7 AS STRING) END
                   AS mae_motivo_especifico_valor,
               'Tipo motivo ' || CAST(o_orderkey % 5 AS STRING)
                   AS mae_tipo_motivo_especifico_valor,
               'Subtipo ' || CAST(o_orderkey % 11 AS STRING)
                   AS mae_subtipo_motivo_especifico_valor,
               o_orderkey % 2 AS reabierto,
               1 + o_orderkey % 4 AS cantidad_servicios,
               o_orderdate AS fecha_hora_crea,
               o_orderdate + INTERVAL '30' DAY AS fecha_hora_modifica,
               CASE o_orderkey % 20 WHEN 0 THEN 1 WHEN 1 THEN NULL ELSE 0 END AS borrado
        FROM {orders}""",
    "aus_caso_servicios": f"""
        SELECT {_LINE_ID} AS id,
               l_orderkey AS aus_casos_id,
               CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_partkey % 130 END
                   AS gn_usuarios_asignado_id,
               l_suppkey + l_linenumber % 3 AS cnt_prestador_sede_destino_id,
               'Sede; ' || CAST(l_suppkey AS STRING) || ',  norte' || chr(10)
                   AS cnt_prestador_sede_destino_valor,
               CASE l_linestatus WHEN 'F' THEN 'Cerrado' ELSE 'Asignado' END
                   AS mae_estado_valor,
               'Motivo servicio ' || CAST(l_linenumber AS STRING)
                   AS mae_servicio_motivo_valor,
               CASE l_returnflag WHEN 'A' THEN 'Ambulatorio' WHEN 'R' THEN 'Urgencias' END
                   AS mae_servicio_ambito_valor,
               CAST(l_partkey % 400 AS STRING) AS ma_tecnologia_codigo,
               'Servicio ' || CAST(l_partkey % 400 AS STRING) AS ma_tecnologia_valor,
               CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 END AS medicamento,
               CASE WHEN l_linenumber = 6 THEN NULL ELSE l_linenumber % 5 END
                   AS servicio_atribuido_ips,
               l_shipdate AS fecha_hora_crea
        FROM {{lineitem}}""",
    "aus_seguimientos": f"""
        SELECT {_LINE_ID} AS id,
               l_orderkey AS aus_casos_id,
               CASE l_returnflag WHEN 'R' THEN 'CERRADO' WHEN 'A' THEN 'RADICADO'
                    ELSE 'EN TRAMITE' END AS mae_estado_valor,
               'Nota ' || CAST(l_partkey AS STRING) AS observacion,
               l_shipdate AS fecha_hora_crea,
               'usuario' || CAST(l_suppkey % 60 AS STRING) AS usuario_crea
        FROM {{lineitem}}""",
    "aus_servicio_gestiones": f"""
        SELECT {_LINE_ID} AS aus_servicios_id,
               CASE (l_partkey + step * l_linenumber) % 6 WHEN 0 THEN 'Asignado'
                    WHEN 1 THEN 'Estudio' WHEN 2 THEN 'Cerrado' WHEN 3 THEN 'Resuelto'
                    WHEN 4 THEN 'Rechazado' ELSE 'Devuelto' END AS mae_estado_valor,
               'Gestion ' || CAST(step AS STRING) AS observacion,
               CASE WHEN l_partkey % 50 = 1 AND step = 0 THEN NULL
                    ELSE l_shipdate + ((l_suppkey * (step + 1)) % 40) * INTERVAL '1' DAY
               END AS fecha_hora_crea,
               'gestor' || CAST((l_suppkey + step) % 60 AS STRING) AS usuario_crea
        FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate,
                     {{explode}} AS step
              FROM {{lineitem}}) AS steps""",
    "aus_personas": """
        SELECT c_custkey AS id,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'CC' WHEN 'MACHINERY' THEN 'CC'
                    WHEN 'AUTOMOBILE' THEN 'TI' WHEN 'HOUSEHOLD' THEN '1' END
                   AS mae_tipo_documento_codigo,
               CASE WHEN c_custkey % 60 = 59 THEN NULL
                    ELSE CAST(c_custkey - CASE c_custkey % 13 WHEN 12 THEN 1 ELSE 0 END
                              AS STRING) END AS documento,
               CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' END AS mae_sexo_codigo,
               CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS discapacidad
        FROM {customer}""",
    "aus_persona_telefonos": "SELECT user_id AS aus_personas_id FROM {events}",
    "aseg_afiliados": """
        SELECT CASE c_nationkey % 2 WHEN 0 THEN 'CC' ELSE 'TI' END AS mae_tipo_documento_codigo,
               CAST(c_custkey - CASE c_custkey % 10 WHEN 9 THEN 1 ELSE 0 END AS STRING)
                   AS numero_documento,
               DATE '1930-01-01' + CAST((c_custkey * 37) % 30000 AS INT) AS fecha_nacimiento,
               CASE c_custkey % 2 WHEN 0 THEN 'F' ELSE 'M' END AS mae_genero_codigo,
               CASE c_custkey % 5 WHEN 0 THEN 'Activo' WHEN 1 THEN 'activo'
                    WHEN 2 THEN 'activo' WHEN 3 THEN 'Retirado' END
                   AS mae_estado_afiliacion_valor,
               CASE c_custkey % 2 WHEN 0 THEN 'SUBSIDIADO' ELSE 'CONTRIBUTIVO' END
                   AS mae_regimen_valor,
               c_mktsegment AS mae_grupo_poblacional_valor,
               CASE c_custkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS discapacidad,
               c_nationkey AS residencia_ubicacion_id,
               (c_nationkey + 7) % 27 AS afiliacion_ubicaciones_id
        FROM {customer}
        WHERE c_custkey % 7 <> 0""",
    "gn_ubicaciones": """
        SELECT n_nationkey AS id,
               CASE WHEN n_nationkey = 24 THEN NULL ELSE n_regionkey + 100 END
                   AS gn_ubicaciones_id,
               lpad(CAST(n_nationkey AS STRING), 3, '0') AS prefijo,
               n_name AS nombre,
               CASE n_nationkey WHEN 3 THEN 'MEDELLÍN' ELSE n_name END AS descripcion,
               CASE n_regionkey WHEN 2 THEN 'MEDELLIN' WHEN 3 THEN 'Oriente'
                    ELSE 'NORTE' END AS mae_region_valor
        FROM {nation}
        UNION ALL
        SELECT r_regionkey + 100, NULL, lpad(CAST(r_regionkey + 5 AS STRING), 2, '0'),
               r_name, r_name, NULL
        FROM {region}""",
    "gn_usuarios": """
        SELECT s_suppkey AS id,
               'usuario; ' || s_name || chr(9) || '  "' || CAST(s_suppkey AS STRING) || '"'
                   AS nombre,
               CAST(s_suppkey + 5000 AS STRING) AS documento
        FROM {supplier}""",
    "cnt_prestadores": """
        SELECT s_suppkey AS id, 'NIT' || CAST(s_suppkey AS STRING) AS numero_documento,
               s_name AS razon_social
        FROM {supplier}""",
    "cnt_prestador_sedes": """
        SELECT s_suppkey AS id,
               CASE WHEN s_suppkey % 9 = 4 THEN NULL
                    ELSE 'sede ' || s_name || ';&quot' || chr(13) || chr(10) || ', centro' END
                   AS nombre,
               s_nationkey AS ubicacion_id,
               s_suppkey % 8 AS cnt_prestador_id
        FROM {supplier}""",
    "cnt_contratos": """
        SELECT o_orderkey AS id, 'CT-' || CAST(o_orderkey AS STRING) AS contrato,
               CAST(o_orderdate AS DATE) AS fecha_inicio,
               CAST(o_orderdate + INTERVAL '365' DAY AS DATE) AS fecha_fin,
               o_custkey % 120 AS cnt_prestadores_id
        FROM {orders}""",
    "cnt_contrato_sedes": """
        SELECT o_orderkey * 4 + step AS id, o_orderkey AS cnt_contratos_id,
               (o_custkey + step) % 110 AS cnt_prestador_sedes_id,
               CASE step WHEN 0 THEN 'EVENTO' WHEN 1 THEN 'CAPITA' ELSE 'PGP' END
                   AS mae_modalidad_contrato_valor
        FROM (SELECT o_orderkey, o_custkey, {explode} AS step FROM {orders}) AS sites""",
    "cnt_contrato_detalles": """
        SELECT l_orderkey AS cnt_contratos_id,
               l_orderkey * 4 + l_linenumber % 4 AS cnt_contrato_sedes_id,
               (l_partkey + l_linenumber) % 6 AS tipo_tecnologia,
               CASE WHEN l_suppkey % 10 = 0 THEN 0 ELSE 1 END AS activo,
               CAST(100 + l_partkey % 20 AS STRING) AS ma_servicio_habilitacion_codigo,
               'Habilitado ' || CAST(l_partkey % 20 AS STRING) AS ma_servicio_habilitacion_valor,
               CAST(l_partkey AS STRING) AS ma_tecnologia_codigo,
               'Tecnologia ' || CAST(l_partkey AS STRING) AS ma_tecnologia_valor,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS valor_manual,
               CAST(l_quantity AS DECIMAL(18,2)) AS valor_contratado,
               CASE l_returnflag WHEN 'A' THEN 'BAJA' WHEN 'R' THEN 'ALTA' END AS complejidad
        FROM {lineitem}""",
    "au_anexos3": """
        SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS fecha_solicitud FROM {orders}""",
    "au_anexos4": """
        SELECT o_orderkey AS id,
               CASE WHEN o_orderkey % 25 = 4 THEN NULL ELSE o_orderkey END AS au_anexos3_id,
               CAST(o_orderdate + (o_custkey % 30) * INTERVAL '1' DAY AS DATE)
                   AS fecha_autorizacion,
               CASE o_custkey % 2 WHEN 0 THEN 'CC' ELSE 'TI' END AS afiliado_tipo_documento,
               CAST(o_custkey AS STRING) AS afiliado_numero_documento,
               'Apellido' || CAST(o_custkey % 17 AS STRING) AS afiliado_primer_apellido,
               CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'Segundo' END
                   AS afiliado_segundo_apellido,
               'Nombre' || CAST(o_custkey % 19 AS STRING) AS afiliado_primer_nombre,
               CAST(NULL AS STRING) AS afiliado_segundo_nombre,
               DATE '1930-01-01' + CAST((o_custkey * 37) % 30000 AS INT)
                   AS afiliado_fecha_nacimiento,
               'DX' || CAST(o_custkey % 99 AS STRING) AS diagnostico_principal,
               CASE o_custkey % 16 WHEN 0 THEN 'Medellín' WHEN 1 THEN 'BELLO'
                    WHEN 2 THEN 'El Peñol' WHEN 3 THEN 'rionegro' WHEN 4 THEN 'YARUMAL'
                    WHEN 5 THEN 'Amalfi' WHEN 6 THEN 'DABEIBA' WHEN 7 THEN 'Andes'
                    WHEN 8 THEN 'CAUCASIA' WHEN 9 THEN 'Maceo' WHEN 10 THEN 'TURBO'
                    WHEN 11 THEN 'BOGOTA' WHEN 12 THEN 'SAN JUAN DE URA'
                    WHEN 13 THEN 'MEDELLIN' WHEN 14 THEN 'BRICEÑO' END AS afiliado_municipio,
               CAST(o_custkey % 4 AS STRING) AS mae_modalidad_tecnologia_codigo,
               'Modalidad ' || CAST(o_custkey % 4 AS STRING) AS mae_modalidad_tecnologia_valor,
               'AUT-' || CAST(o_orderkey AS STRING) AS numero_autorizacion
        FROM {orders}""",
    "au_anexo4_items": """
        SELECT l_orderkey AS au_anexos4_id,
               CASE l_partkey % 9 WHEN 0 THEN '890208' WHEN 1 THEN '890308'
                    WHEN 2 THEN '890284' WHEN 3 THEN '890384' WHEN 4 THEN '890201'
                    ELSE CAST(l_partkey AS STRING) END AS ma_tecnologia_codigo,
               'Tecnologia ' || CAST(l_partkey % 9 AS STRING) AS ma_tecnologia_valor,
               CAST(l_quantity AS INT) AS cantidad_autorizada,
               l_shipdate AS fecha_hora_crea
        FROM {lineitem}""",
    "RIPS_AC_LLAVE": """
        SELECT CAST(l_suppkey AS STRING) AS codigo_reps, 'CC' AS mae_tipo_documento_codigo,
               CAST(l_partkey % 150 AS STRING) AS documento_afiliado,
               CAST(l_shipdate AS DATE) AS fecha_consulta,
               CAST(l_partkey AS STRING) AS ma_tecnologia_codigo,
               CAST(l_linenumber AS STRING) AS mae_finalidad_consulta_codigo,
               l_linestatus AS mae_causa_externa_codigo,
               'A' || CAST(l_suppkey % 90 AS STRING) AS ma_diagnostico_principal_codigo,
               CASE WHEN l_linenumber > 3 THEN 'B1' END AS ma_diagnostico_relacionado1_codigo,
               CAST(NULL AS STRING) AS ma_diagnostico_relacionado2_codigo,
               CAST(NULL AS STRING) AS ma_diagnostico_relacionado3_codigo,
               l_shipdate + INTERVAL '20' DAY AS fecha_hora_crea
        FROM {lineitem} WHERE l_returnflag = 'R'""",
    "RIPS_AU_LLAVE": """
        SELECT CAST(l_suppkey AS STRING) AS codigo_reps, 'CC' AS mae_tipo_documento_codigo,
               CAST(l_partkey % 150 AS STRING) AS documento_afiliado,
               CAST(l_shipdate AS DATE) AS fecha_ingreso,
               CAST(l_shipdate + INTERVAL '2' DAY AS DATE) AS fecha_salida,
               l_linestatus AS mae_causa_externa_valor,
               'S' || CAST(l_suppkey % 90 AS STRING) AS ma_diagnostico_salida_valor,
               CASE WHEN l_linenumber > 3 THEN 'B1' END AS ma_diagnostico_relacionado1_valor,
               CAST(NULL AS STRING) AS ma_diagnostico_relacionado2_valor,
               CAST(NULL AS STRING) AS ma_diagnostico_relacionado3_valor,
               'Casa' AS mae_destino_salida_valor, 'Vivo' AS mae_estado_salida_valor
        FROM {lineitem} WHERE l_returnflag = 'A'""",
    "RIPS_AH_LLAVE": """
        SELECT CAST(l_suppkey AS STRING) AS codigo_reps, 'CC' AS mae_tipo_documento_codigo,
               CAST(l_partkey % 150 AS STRING) AS documento_afiliado,
               CASE l_linestatus WHEN 'F' THEN 'Urgencias' ELSE 'Remitido' END
                   AS mae_via_ingreso_valor,
               CAST(l_shipdate AS DATE) AS fecha_ingreso,
               CAST(l_shipdate + INTERVAL '9' DAY AS DATE) AS fecha_salida,
               l_linestatus AS mae_causa_externa_valor,
               'I' || CAST(l_suppkey % 90 AS STRING) AS ma_diagnostico_ingreso_valor,
               'E' || CAST(l_suppkey % 70 AS STRING) AS ma_diagnostico_egreso_valor,
               CASE WHEN l_linenumber > 3 THEN 'B1' END AS ma_diagnostico_relacionado1_valor,
               CAST(NULL AS STRING) AS ma_diagnostico_relacionado2_valor,
               CAST(NULL AS STRING) AS ma_diagnostico_relacionado3_valor,
               'Vivo' AS EstadoSalida, CAST(NULL AS STRING) AS ma_diagnostico_muerte_codigo
        FROM {lineitem} WHERE l_returnflag = 'N'""",
    "RIPS_AP_LLAVE": """
        SELECT CAST(event_id % 77 AS STRING) AS codigo_reps,
               'CC' AS mae_tipo_documento_codigo,
               CAST(user_id AS STRING) AS documento_afiliado,
               CAST(ts AS DATE) AS fecha_procedimiento,
               event_type AS ma_tecnologia_codigo,
               'Ambito ' || CAST(event_id % 3 AS STRING) AS mae_ambito_atencion_codigo_valor,
               'Finalidad ' || CAST(event_id % 4 AS STRING)
                   AS mae_finalidad_procedimiento_valor,
               'P' || CAST(event_id % 50 AS STRING) AS ma_diagnostico_principal_valor,
               CASE WHEN event_id % 3 = 0 THEN 'Q1' END AS ma_diagnostico_relacionado1_valor
        FROM {events}""",
}

# Rows generated per input row: three for a site or a service, numbered from 0.
SPARK_EXPLODE = "explode(array(0, 1, 2))"

# Given, so that opening a file does not cost a job to find its schema.
_BASE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
              "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, "
                "l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}
BASE_TABLES = tuple(_BASE_SCHEMAS)


def base_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_BASE_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def domain_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The named domain tables over the star-schema files of ``folder``."""
    schemas = registry()
    statements = {n: DOMAIN_SQL[n].replace("{explode}", SPARK_EXPLODE) for n in names}
    used = {n: [b for b in BASE_TABLES if "{" + b + "}" in sql] for n, sql in statements.items()}
    needed = {b for bases in used.values() for b in bases}
    base = {b: base_table(spark, folder, b) for b in sorted(needed)}
    return {
        n: conform(spark.sql(sql, **{b: base[b] for b in used[n]}), schemas[n], name=n)
        for n, sql in statements.items()
    }
