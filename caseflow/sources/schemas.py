"""Schemas of the input tables, one StructType per table.

Timestamps are without time zone, codes that the data holds both as numbers and as
quoted numbers are integers, and document numbers are strings. Flags with three or
more codes stay integers.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

# Table and column names of the source schema.
_DDL = {
    "aus_casos": """
        id bigint, radicado string, aus_personas_id bigint,
        gn_usuarios_responsable_id bigint, gn_ubicaciones_id bigint,
        mae_solicitud_estado_valor string, mae_solicitud_tipo_codigo int,
        mae_solicitud_tipo_valor string, mae_solicitud_origen_codigo int,
        mae_solicitud_origen_valor string, mae_solicitud_riesgo_vidal_valor string,
        mae_solicitud_ente_contro_valor string, mae_motivo_reabre_codigo string,
        mae_motivo_especifico_valor string, mae_tipo_motivo_especifico_valor string,
        mae_subtipo_motivo_especifico_valor string, reabierto int,
        cantidad_servicios int, fecha_hora_crea timestamp_ntz,
        fecha_hora_modifica timestamp_ntz, borrado int""",
    "aus_caso_servicios": """
        id bigint, aus_casos_id bigint, gn_usuarios_asignado_id bigint,
        cnt_prestador_sede_destino_id bigint, cnt_prestador_sede_destino_valor string,
        mae_estado_valor string, mae_servicio_motivo_valor string,
        mae_servicio_ambito_valor string, ma_tecnologia_codigo string,
        ma_tecnologia_valor string, medicamento int, servicio_atribuido_ips int,
        fecha_hora_crea timestamp_ntz""",
    "aus_seguimientos": """
        id bigint, aus_casos_id bigint, mae_estado_valor string, observacion string,
        fecha_hora_crea timestamp_ntz, usuario_crea string""",
    "aus_servicio_gestiones": """
        aus_servicios_id bigint, mae_estado_valor string, observacion string,
        fecha_hora_crea timestamp_ntz, usuario_crea string""",
    "aus_personas": """
        id bigint, mae_tipo_documento_codigo string, documento string,
        mae_sexo_codigo string, discapacidad int""",
    "aus_persona_telefonos": "aus_personas_id bigint",
    "aseg_afiliados": """
        mae_tipo_documento_codigo string, numero_documento string,
        fecha_nacimiento date, mae_genero_codigo string,
        mae_estado_afiliacion_valor string, mae_regimen_valor string,
        mae_grupo_poblacional_valor string, discapacidad int,
        residencia_ubicacion_id bigint, afiliacion_ubicaciones_id bigint""",
    "gn_ubicaciones": """
        id bigint, gn_ubicaciones_id bigint, prefijo string, nombre string,
        descripcion string, mae_region_valor string""",
    "gn_usuarios": "id bigint, nombre string, documento string",
    "cnt_prestadores": "id bigint, numero_documento string, razon_social string",
    "cnt_prestador_sedes": """
        id bigint, nombre string, ubicacion_id bigint, cnt_prestador_id bigint""",
    "cnt_contratos": """
        id bigint, contrato string, fecha_inicio date, fecha_fin date,
        cnt_prestadores_id bigint""",
    "cnt_contrato_sedes": """
        id bigint, cnt_contratos_id bigint, cnt_prestador_sedes_id bigint,
        mae_modalidad_contrato_valor string""",
    "cnt_contrato_detalles": """
        cnt_contratos_id bigint, cnt_contrato_sedes_id bigint, tipo_tecnologia int,
        activo int, ma_servicio_habilitacion_codigo string,
        ma_servicio_habilitacion_valor string, ma_tecnologia_codigo string,
        ma_tecnologia_valor string, valor_manual decimal(18,2),
        valor_contratado decimal(18,2), complejidad string""",
    "au_anexos3": "id bigint, fecha_solicitud date",
    "au_anexos4": """
        id bigint, au_anexos3_id bigint, fecha_autorizacion date,
        afiliado_tipo_documento string, afiliado_numero_documento string,
        afiliado_primer_apellido string, afiliado_segundo_apellido string,
        afiliado_primer_nombre string, afiliado_segundo_nombre string,
        afiliado_fecha_nacimiento date, diagnostico_principal string,
        afiliado_municipio string, mae_modalidad_tecnologia_codigo string,
        mae_modalidad_tecnologia_valor string, numero_autorizacion string""",
    "au_anexo4_items": """
        au_anexos4_id bigint, ma_tecnologia_codigo string, ma_tecnologia_valor string,
        cantidad_autorizada int, fecha_hora_crea timestamp_ntz""",
    "RIPS_AC_LLAVE": """
        codigo_reps string, mae_tipo_documento_codigo string, documento_afiliado string,
        fecha_consulta date, ma_tecnologia_codigo string,
        mae_finalidad_consulta_codigo string, mae_causa_externa_codigo string,
        ma_diagnostico_principal_codigo string,
        ma_diagnostico_relacionado1_codigo string,
        ma_diagnostico_relacionado2_codigo string,
        ma_diagnostico_relacionado3_codigo string, fecha_hora_crea timestamp_ntz""",
    "RIPS_AU_LLAVE": """
        codigo_reps string, mae_tipo_documento_codigo string, documento_afiliado string,
        fecha_ingreso date, fecha_salida date, mae_causa_externa_valor string,
        ma_diagnostico_salida_valor string, ma_diagnostico_relacionado1_valor string,
        ma_diagnostico_relacionado2_valor string,
        ma_diagnostico_relacionado3_valor string, mae_destino_salida_valor string,
        mae_estado_salida_valor string""",
    "RIPS_AH_LLAVE": """
        codigo_reps string, mae_tipo_documento_codigo string, documento_afiliado string,
        mae_via_ingreso_valor string, fecha_ingreso date, fecha_salida date,
        mae_causa_externa_valor string, ma_diagnostico_ingreso_valor string,
        ma_diagnostico_egreso_valor string, ma_diagnostico_relacionado1_valor string,
        ma_diagnostico_relacionado2_valor string,
        ma_diagnostico_relacionado3_valor string, EstadoSalida string,
        ma_diagnostico_muerte_codigo string""",
    "RIPS_AP_LLAVE": """
        codigo_reps string, mae_tipo_documento_codigo string, documento_afiliado string,
        fecha_procedimiento date, ma_tecnologia_codigo string,
        mae_ambito_atencion_codigo_valor string,
        mae_finalidad_procedimiento_valor string, ma_diagnostico_principal_valor string,
        ma_diagnostico_relacionado1_valor string""",
}

# Other spellings under which a column may arrive: table -> {found: canonical}.
COLUMN_ALIASES = {"aus_personas": {"dicapacidad": "discapacidad"}}


def registry() -> dict[str, StructType]:
    """All table schemas by name. Built on call, since DDL parsing needs a session."""
    return {name: StructType.fromDDL(ddl) for name, ddl in _DDL.items()}


def table_names() -> list[str]:
    return list(_DDL)
