"""Small invented domain tables holding every case the reports have to decide."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from caseflow.sources import registry

AS_OF = "2025-05-01"
# Born so that 365.2 and 365.25 days a year disagree: 40 and 39 years.
EDGE_BIRTH = dt.date(2025, 5, 1) - dt.timedelta(days=14608)


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def _case(id, person, created, state="Radicado", **more):
    row = {
        "id": id, "radicado": f"R{id}", "aus_personas_id": person,
        "gn_usuarios_responsable_id": 6, "gn_ubicaciones_id": 1,
        "mae_solicitud_estado_valor": state, "mae_solicitud_tipo_codigo": 1,
        "mae_solicitud_tipo_valor": "Queja", "mae_solicitud_origen_codigo": 9,
        "mae_solicitud_origen_valor": "Web", "mae_solicitud_riesgo_vidal_valor": "Regular",
        "reabierto": 0, "cantidad_servicios": 1, "fecha_hora_crea": ts(created), "borrado": 0,
    }
    return {**row, **more}


def _service(id, case, user=None, site=50, **more):
    row = {"id": id, "aus_casos_id": case, "gn_usuarios_asignado_id": user,
           "cnt_prestador_sede_destino_id": site,
           "cnt_prestador_sede_destino_valor": "Sede; uno,", "mae_estado_valor": "Abierto",
           "mae_servicio_motivo_valor": "Demora", "ma_tecnologia_codigo": "T1",
           "fecha_hora_crea": ts("2023-01-01")}
    return {**row, **more}


def _log(id, case, state, when, user="u1"):
    return {"id": id, "aus_casos_id": case, "mae_estado_valor": state,
            "fecha_hora_crea": when and ts(when), "usuario_crea": user}


def _step(service, state, when, user="g1"):
    return {"aus_servicios_id": service, "mae_estado_valor": state,
            "fecha_hora_crea": when and ts(when), "usuario_crea": user}


def _person(id, tipo, document, disability=None, sex=None):
    return {"id": id, "mae_tipo_documento_codigo": tipo, "documento": document,
            "discapacidad": disability, "mae_sexo_codigo": sex}


def _member(tipo, document, state="activo", disability=None, home=1, place=2, birth=EDGE_BIRTH):
    return {"mae_tipo_documento_codigo": tipo, "numero_documento": document,
            "mae_estado_afiliacion_valor": state, "discapacidad": disability,
            "residencia_ubicacion_id": home, "afiliacion_ubicaciones_id": place,
            "fecha_nacimiento": birth, "mae_genero_codigo": "M"}


def _authorization(id, request, municipality, granted="2024-03-10"):
    return {"id": id, "au_anexos3_id": request, "fecha_autorizacion": day(granted),
            "afiliado_municipio": municipality, "numero_autorizacion": f"A{id}"}


MUNICIPALITIES = ["Medellín", "rionegro", "Yarumal", "AMALFI", "Dabeiba", "andes", "CAUCASIA",
                  "Maceo", "TURBO", "BOGOTA", None, "MEDELLIN"]

ROWS = {
    "aus_casos": [
        _case(10, 1, "2023-03-05 10:00:00", "Cerrado", reabierto=1,
              mae_motivo_reabre_codigo="1", mae_solicitud_riesgo_vidal_valor="No aplica"),
        _case(11, 2, "2023-05-01", "Solucionado", reabierto=1, mae_motivo_reabre_codigo="2",
              mae_solicitud_origen_codigo=1, mae_motivo_especifico_valor="Costo"),
        _case(12, 4, "2024-02-01", mae_solicitud_riesgo_vidal_valor="Vital"),
        _case(13, 1, "2024-02-01", borrado=1),
        _case(14, 1, "2024-02-01", borrado=None),
        _case(15, 1, "2024-02-01", mae_solicitud_tipo_codigo=3),
        _case(16, 1, "2024-02-01", mae_solicitud_tipo_codigo=None),
        _case(17, None, "2024-03-01", None, gn_ubicaciones_id=3),
        _case(18, 7, "2021-12-30", "cerrado"),
        _case(19, 6, "2023-12-31 23:59:59"),
    ],
    "aus_caso_servicios": [
        _service(1000, 10, user=5, medicamento=0, servicio_atribuido_ips=0),
        _service(1001, 11, site=51, medicamento=1, servicio_atribuido_ips=1),
        _service(1002, 11, site=99, servicio_atribuido_ips=3,
                 mae_servicio_motivo_valor="Trato"),
        _service(1003, 18),
        _service(1004, 10, medicamento=7),
    ],
    "aus_seguimientos": [
        _log(1, 10, "RADICADO", "2023-03-05 10:00:00"),
        _log(2, 10, "CERRADO", "2023-03-20 08:00:00"),
        _log(3, 10, "CERRADO", "2023-03-20 08:00:00", "u2"),
        _log(4, 10, "CERRADO", None),
        _log(5, 11, "CERRADO", "2023-06-01"),
        _log(6, 11, "CERRADO", "2023-07-10"),
        _log(7, 18, "Cerrado", "2022-01-02"),
        _log(8, 13, "CERRADO", "2024-05-01"),
        _log(9, 12, "EN TRAMITE", "2024-02-02"),
        _log(10, 777, "CERRADO", "2024-02-02"),
        _log(11, 12, "CERRADO", None),
        _log(12, 12, "CERRADO", None),
    ],
    "aus_servicio_gestiones": [
        _step(1000, "Asignado", None),
        _step(1000, "Asignado", "2023-03-07"),
        _step(1000, "Asignado", "2023-03-06"),
        _step(1000, "Estudio", "2023-03-08"),
        _step(1000, "Cerrado", "2023-03-15"),
        _step(1000, "Resuelto", "2023-03-14"),
        _step(1001, "Estudio", "2023-05-09"),
        _step(1002, "Resuelto", "2024-05-12", "g2"),
        _step(1002, "Resuelto", "2024-05-12", "g2"),
        _step(1003, "Rechazado", "2022-01-01"),
        _step(4444, "Cerrado", "2024-01-01"),
    ],
    "aus_personas": [
        _person(1, "CC", "100", 0, "F"),
        _person(2, "1", "200"),
        _person(3, "0", "200"),
        _person(4, "CC", "300", 1),
        _person(5, None, "100"),
        _person(6, "CC", "600"),
        _person(7, "TI", "200", 0),
        _person(8, "CC", None),
        _person(9, "CC", ""),
    ],
    "aus_persona_telefonos": [{"aus_personas_id": 1}, {"aus_personas_id": 1}],
    "aseg_afiliados": [
        _member("CC", "100"),
        _member("CC", "200", "Activo", 1, home=3, place=3),
        _member("TI", "200", "Retirado", 0, place=1),
        _member("CC", "600", place=404),
        _member("CC", ""),
        _member("CC", None, None),
    ],
    "gn_ubicaciones": [
        {"id": 101, "prefijo": "05", "nombre": "ANTIOQUIA", "descripcion": "ANTIOQUIA"},
        {"id": 1, "gn_ubicaciones_id": 101, "prefijo": "001", "nombre": "Medellín",
         "descripcion": "MEDELLÍN", "mae_region_valor": "MEDELLIN"},
        {"id": 2, "gn_ubicaciones_id": 101, "prefijo": "088", "nombre": "Bello",
         "descripcion": "BELLO", "mae_region_valor": "Norte"},
        {"id": 3, "prefijo": "999", "nombre": "Suelto", "descripcion": "medellin",
         "mae_region_valor": "Medellín"},
    ],
    "gn_usuarios": [
        {"id": 5, "nombre": 'Ana; \t "Ruiz",  Paz\r\n', "documento": "U5"},
        {"id": 6, "nombre": "Luis", "documento": "U6"},
    ],
    "cnt_prestadores": [
        {"id": 50, "numero_documento": "NIT50", "razon_social": "Clinica A"},
        {"id": 7, "numero_documento": "NIT7", "razon_social": "Clinica B"},
    ],
    "cnt_prestador_sedes": [
        {"id": 50, "nombre": "Sede, norte;\n", "ubicacion_id": 1, "cnt_prestador_id": 7},
        {"id": 51, "nombre": None, "ubicacion_id": 2, "cnt_prestador_id": 50},
    ],
    "cnt_contratos": [
        {"id": 1, "contrato": "C1", "cnt_prestadores_id": 7},
        {"id": 2, "contrato": "C2", "cnt_prestadores_id": 404},
    ],
    "cnt_contrato_sedes": [
        {"id": 11, "cnt_contratos_id": 1, "cnt_prestador_sedes_id": 50,
         "mae_modalidad_contrato_valor": "EVENTO"},
        {"id": 21, "cnt_contratos_id": 2, "cnt_prestador_sedes_id": 51,
         "mae_modalidad_contrato_valor": "CAPITA"},
    ],
    "cnt_contrato_detalles": [
        {"cnt_contratos_id": contract, "cnt_contrato_sedes_id": site, "tipo_tecnologia": kind,
         "activo": active, "ma_servicio_habilitacion_codigo": "H1",
         "ma_tecnologia_codigo": code, "valor_manual": Decimal("10.50")}
        for contract, site, kind, active, code in [
            (1, 11, 1, 1, "T1"), (1, 11, 1, 1, "T1"), (1, 11, 1, 1, "T2"), (1, 11, 2, 1, "M1"),
            (1, 11, 3, 1, "I1"), (1, 11, 1, 0, "T9"), (2, 21, 4, 1, "P1"), (2, 11, 4, 1, "X"),
            (1, 11, 5, 1, "Z"), (1, 11, None, 1, "N"),
        ]
    ],
    "au_anexos3": [
        {"id": 1, "fecha_solicitud": day("2024-03-01")},
        {"id": 2, "fecha_solicitud": day("2025-03-31")},
        {"id": 3, "fecha_solicitud": day("2025-04-01")},
    ],
    "au_anexos4": [
        *[_authorization(i, 1, name) for i, name in enumerate(MUNICIPALITIES)],
        _authorization(90, 2, "BELLO", "2025-03-30"),
        _authorization(91, 3, "BELLO"),
        _authorization(92, None, "BELLO"),
    ],
    "au_anexo4_items": [
        *[{"au_anexos4_id": i, "ma_tecnologia_codigo": "890208", "cantidad_autorizada": 1}
          for i in [*range(len(MUNICIPALITIES)), 90, 91, 92]],
        {"au_anexos4_id": 0, "ma_tecnologia_codigo": "999999"},
        {"au_anexos4_id": 0, "ma_tecnologia_codigo": "890384"},
    ],
    "RIPS_AC_LLAVE": [
        # Selected by the time the row was made, whatever the clinical date.
        {"documento_afiliado": "555", "fecha_consulta": day("2010-01-01"),
         "fecha_hora_crea": ts("2016-01-01"), "ma_tecnologia_codigo": "C1"},
        {"documento_afiliado": "555", "fecha_consulta": day("2016-01-01"),
         "fecha_hora_crea": ts("2014-12-31 23:59:59"), "ma_tecnologia_codigo": "C2"},
        {"documento_afiliado": "A55", "fecha_consulta": day("2016-01-01"),
         "fecha_hora_crea": ts("2016-01-01")},
    ],
    "RIPS_AU_LLAVE": [
        {"documento_afiliado": "555", "fecha_ingreso": day("2015-01-01"),
         "mae_causa_externa_valor": "Caida", "fecha_salida": day("2015-01-03")},
    ],
    "RIPS_AH_LLAVE": [
        {"documento_afiliado": "555", "fecha_ingreso": day("2014-12-31")},
        {"documento_afiliado": "555", "fecha_ingreso": day("2017-06-01"),
         "EstadoSalida": "Vivo"},
    ],
    "RIPS_AP_LLAVE": [
        {"documento_afiliado": "777", "fecha_procedimiento": day("2017-06-01")},
    ],
}


def write(spark, folder: str) -> None:
    for name, schema in registry().items():
        rows = [tuple(row.get(f.name) for f in schema.fields) for row in ROWS[name]]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")
