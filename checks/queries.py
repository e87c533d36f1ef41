"""Every operator and report as a query over the star-schema tables.

Reports run on the domain tables derived in ``caseflow.sources.star_schema``, with binary
label comparison so that SQL can follow them. Dates are given out as text and decimals
as doubles, which both engines render alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow import plans
from caseflow.functions import (
    BINARY,
    DEFAULT_COLLATION,
    age_years,
    ci_eq,
    ci_in,
    cleanse_text,
    coalesce_milestones,
    decode,
    exclude_codes,
    flag,
    geo_code,
    loose_eq,
    mysql_truthy,
    not_deleted,
    period_filter,
    same_period,
    wait_days,
)
from caseflow.operators import (
    classify,
    count_by,
    first_per_key,
    flatten_hierarchy,
    hierarchy_roots,
    latest_per_key,
    lookup,
    mapping_table,
    match_member,
    merge_latest,
    merge_milestones,
    milestone_state,
    milestones,
    milestones_of,
    tagged_union,
)
from caseflow.plans.authorization_wait import TABLES as AUTHORIZATION_TABLES
from caseflow.plans.case_detail import TABLES as CASE_TABLES
from caseflow.plans.consolidated import TABLES as CONSOLIDATED_TABLES
from caseflow.plans.contracts import TABLES as CONTRACTS_TABLES
from caseflow.plans.members import TABLES as MEMBERS_TABLES
from caseflow.plans.monthly_tracking import TABLES as TRACKING_TABLES
from caseflow.plans.person_history import TABLES as HISTORY_TABLES
from caseflow.plans.productivity import TABLES as PRODUCTIVITY_TABLES
from caseflow.plans.wide_detail import NAME_REMOVALS
from caseflow.plans.wide_detail import TABLES as WIDE_TABLES
from caseflow.session import shared_folder
from caseflow.sources import label_spellings, land_history, land_requests, landed, load_tables
from caseflow.sources.star_schema import base_table, domain_tables

Query = Callable[[SparkSession, str], DataFrame]

EVENT_TYPES = ["signup", "view", "click", "purchase", "error"]
AS_OF = "2025-05-01"
PERSON = "7"


def _portable(df: DataFrame) -> DataFrame:
    rendered = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.DateType):
            rendered[field.name] = F.col(field.name).cast("string")
        elif isinstance(field.dataType, T.DecimalType):
            rendered[field.name] = F.col(field.name).cast("double")
    return df.withColumns(rendered) if rendered else df


# Status logs ---------------------------------------------------------------------------

def latest_status(spark, folder):
    events = base_table(spark, folder, "events")
    return latest_per_key(events, ["user_id"], "ts", ["event_id"],
                          where=F.col("event_type") == "error")


def first_status(spark, folder):
    events = base_table(spark, folder, "events")
    return first_per_key(events, ["user_id"], "ts", ["event_id"],
                         where=F.col("event_type") == "view",
                         cols=["event_id", "ts", "value"])


def latest_keep_ties(spark, folder):
    lines = base_table(spark, folder, "lineitem")
    return latest_per_key(lines, ["l_orderkey"], "l_shipdate", [],
                          where=F.col("l_returnflag") == "R",
                          cols=["l_shipdate", "l_partkey", "l_linenumber"], ties="all")


def latest_one(spark, folder):
    lines = base_table(spark, folder, "lineitem")
    return latest_per_key(lines, ["l_orderkey"], "l_shipdate", [],
                          where=F.col("l_returnflag") == "R", cols=["l_shipdate"])


def _event_milestones(spark, folder):
    names = {e: f"first_{e}" for e in EVENT_TYPES}
    return milestones(base_table(spark, folder, "events"), "user_id", "event_type", "ts", names)


def milestone_pivot(spark, folder):
    return _event_milestones(spark, folder)


def milestones_lookup(spark, folder):
    customers = base_table(spark, folder, "customer").select("c_custkey", "c_name")
    reached = _event_milestones(spark, folder)
    return lookup(customers, reached, "c_custkey", "user_id",
                  [f"first_{e}" for e in EVENT_TYPES])


def closing_precedence(spark, folder):
    reached = _event_milestones(spark, folder)
    last = latest_per_key(base_table(spark, folder, "events"), ["user_id"], "ts", [],
                          where=(F.col("event_type") == "error") & (F.col("user_id") % 3 == 0),
                          cols=["ts"])
    rows = lookup(reached, last, "user_id", "user_id", {"closed": "ts"})
    dates = {"closed": F.col("closed"),
             "solved": F.when(F.col("user_id") % 2 == 0, F.col("first_purchase")),
             "ended": F.col("first_click")}
    return rows.select(
        "user_id",
        coalesce_milestones(dates, ["closed", "solved"]).alias("closing_a"),
        coalesce_milestones(dates, ["closed", "solved", "ended"]).alias("closing_b"),
        coalesce_milestones(dates, ["closed"]).alias("closing_c"))


def latest_inner(spark, folder):
    customers = base_table(spark, folder, "customer").select("c_custkey", "c_name")
    bought = latest_per_key(base_table(spark, folder, "events"), ["user_id"], "ts", ["event_id"],
                            where=F.col("event_type") == "purchase",
                            cols=["ts", "event_id", "value"])
    return lookup(customers, bought, "c_custkey", "user_id", ["ts", "event_id", "value"],
                  how="inner")


# Lookups and matching ------------------------------------------------------------------

def hierarchy_code(spark, folder):
    places = flatten_hierarchy(
        domain_tables(spark, folder, ["gn_ubicaciones"])["gn_ubicaciones"],
        "id", "gn_ubicaciones_id", ["prefijo", "nombre"])
    customers = base_table(spark, folder, "customer").select(
        "c_custkey", ((F.col("c_nationkey") + 7) % 27).cast("long").alias("place_id"))
    rows = lookup(customers, places, "place_id", "id",
                  ["prefijo", "nombre", "parent_prefijo", "parent_nombre"])
    return rows.select("c_custkey", "nombre", "parent_nombre",
                       geo_code(F.col("parent_prefijo"), F.col("prefijo")).alias("code"))


def role_playing(spark, folder):
    lines = base_table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    orders, nation = base_table(spark, folder, "orders"), base_table(spark, folder, "nation")
    customers, suppliers = base_table(spark, folder, "customer"), base_table(spark, folder, "supplier")
    # The customer's nation is put on the orders, so that line items are joined once; then
    # they are counted, and suppliers and names come to what is left.
    placed = lookup(orders.select("o_orderkey", "o_custkey"), customers, "o_custkey", "c_custkey",
                    ["c_nationkey"])
    rows = lookup(lines, placed, "l_orderkey", "o_orderkey", ["c_nationkey"])
    counts = count_by(rows, ["l_suppkey", "c_nationkey"], name="lines")
    counts = lookup(counts, suppliers, "l_suppkey", "s_suppkey", ["s_nationkey"])
    counts = count_by(counts, ["c_nationkey", "s_nationkey"], weight="lines", name="lines")
    counts = lookup(counts, nation, "c_nationkey", "n_nationkey", ["n_name"], prefix="customer_")
    counts = lookup(counts, nation, "s_nationkey", "n_nationkey", ["n_name"], prefix="supplier_")
    return count_by(counts, ["customer_n_name", "supplier_n_name"], weight="lines", name="lines")


def _match(mode: str) -> Query:
    def query(spark, folder):
        tables = domain_tables(spark, folder, ["aus_personas", "aseg_afiliados"])
        persons = tables["aus_personas"].select(
            F.col("id").alias("person_id"), "mae_tipo_documento_codigo", "documento")
        members = tables["aseg_afiliados"].select(
            "numero_documento", F.col("mae_tipo_documento_codigo").alias("member_tipo"),
            "mae_regimen_valor", "residencia_ubicacion_id")
        return match_member(persons, members, "documento", "mae_tipo_documento_codigo", mode,
                            "numero_documento", "member_tipo")
    return query


def match_strict_folded(spark, folder):
    """Documents and types that agree but for case and accents, under the default."""
    tables = domain_tables(spark, folder, ["aus_personas", "aseg_afiliados"])
    ending = F.when(F.col("id") % 2 == 0, "x\u00e9").otherwise("XE")
    persons = tables["aus_personas"].select(
        F.col("id").alias("person_id"),
        F.lower("mae_tipo_documento_codigo").alias("mae_tipo_documento_codigo"),
        F.concat("documento", ending).alias("documento"))
    members = tables["aseg_afiliados"].select(
        F.concat("numero_documento", F.lit("Xe")).alias("numero_documento"),
        F.col("mae_tipo_documento_codigo").alias("member_tipo"),
        "mae_regimen_valor", "residencia_ubicacion_id")
    return match_member(persons, members, "documento", "mae_tipo_documento_codigo", "strict",
                        "numero_documento", "member_tipo", DEFAULT_COLLATION)


def inner_two_keys(spark, folder):
    lines = base_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_partkey", "l_linenumber")
    sites = count_by(lines, ["l_orderkey", "l_suppkey"], name="site_lines")
    return lines.join(sites, ["l_orderkey", "l_suppkey"], "inner")


def provider_chain(spark, folder):
    tables = domain_tables(spark, folder, ["aus_caso_servicios", "cnt_prestador_sedes",
                                           "cnt_prestadores"])
    sites, providers = tables["cnt_prestador_sedes"], tables["cnt_prestadores"]
    # One flat row per site with the document by either key, joined to the services once.
    flat = sites.select("id", "cnt_prestador_id")
    for key in ("id", "cnt_prestador_id"):
        flat = lookup(flat, providers, key, "id", {f"nit_by_{key}": "numero_documento"})
    rows = tables["aus_caso_servicios"].select(
        "id", "aus_casos_id", "cnt_prestador_sede_destino_id")
    return lookup(rows, flat, "cnt_prestador_sede_destino_id", "id",
                  ["nit_by_id", "nit_by_cnt_prestador_id"], sized_by=[sites, providers])


def loaded_tables(spark, folder):
    """Tables read, checked and cast by the loader, one of them looked up in the other."""
    schemas = {
        "supplier": T.StructType.fromDDL("s_suppkey bigint, s_name string, s_nationkey bigint"),
        "nation": T.StructType.fromDDL("n_nationkey bigint, n_name string"),
    }
    tables = load_tables(spark, folder, list(schemas), schemas=schemas)
    return lookup(tables["supplier"], tables["nation"], "s_nationkey", "n_nationkey", ["n_name"])


def count_folded(spark, folder):
    """Groups of labels in two spellings each, counted under the default collation."""
    orders = base_table(spark, folder, "orders")
    label = F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderpriority")).otherwise(
        F.translate("o_orderpriority", "EI", "\u00c9\u00cd"))
    rows = orders.select(label.alias("priority"), "o_orderstatus")
    return count_by(rows, ["priority", "o_orderstatus"], name="cases",
                    collation=DEFAULT_COLLATION)


def count_known_times(spark, folder):
    log = domain_tables(spark, folder, ["aus_servicio_gestiones"])["aus_servicio_gestiones"]
    return count_by(log, ["mae_estado_valor"], non_null="fecha_hora_crea", name="known")


def distinct_after_fanout(spark, folder):
    # Joining the events first could only repeat rows that DISTINCT removes again.
    return base_table(spark, folder, "customer").select("c_nationkey", "c_mktsegment").distinct()


# Kept state, hierarchies, landed tables -------------------------------------------------

def _event_batches(events):
    """The log in parts by month of the year, not in the order of time; one comes twice."""
    parts = [events.where(F.month("ts") % 3 == n) for n in (2, 0, 1)]
    return [*parts, parts[0]]


def milestones_incremental(spark, folder):
    names = {e: f"first_{e}" for e in EVENT_TYPES}
    states = [milestone_state(part, ["user_id"], "event_type", "ts", names)
              for part in _event_batches(base_table(spark, folder, "events"))]
    return milestones_of(merge_milestones(states, ["user_id"]), ["user_id"])


def latest_incremental(spark, folder):
    states = [latest_per_key(part, ["user_id"], "ts", ["event_id"],
                             where=F.col("event_type") == "error")
              for part in _event_batches(base_table(spark, folder, "events"))]
    return merge_latest(states, ["user_id"], "ts", ["event_id"]).select(states[0].columns)


def hierarchy_roots_query(spark, folder):
    """Each order hangs on the customer's order before it."""
    orders = base_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    linked = orders.withColumn("before", F.lag("o_orderkey").over(by))
    return hierarchy_roots(linked, "o_orderkey", "before")


def label_pruned(spark, folder):
    """A folded label that the scan can test."""
    events = base_table(spark, folder, "events")
    known = label_spellings({"events": events}, ["event_type"])
    return events.where(ci_in(F.col("event_type"), ["ERROR", "Purchase"], known)).select(
        "event_id", "user_id", "event_type")


def catalog_tables(spark, folder):
    """Tables that are named with their database."""
    spark.sql("CREATE DATABASE IF NOT EXISTS caseflow_checks")
    for name in ("nation", "region"):
        spark.sql(f"DROP TABLE IF EXISTS caseflow_checks.{name}")
        spark.catalog.createTable(f"caseflow_checks.{name}", f"{folder}/{name}.parquet", "parquet")
    schemas = {
        "nation": T.StructType.fromDDL("n_nationkey bigint, n_name string, n_regionkey bigint"),
        "region": T.StructType.fromDDL("r_regionkey bigint, r_name string"),
    }
    tables = load_tables(spark, names=list(schemas), namespace="caseflow_checks", schemas=schemas)
    return lookup(tables["nation"], tables["region"], "n_regionkey", "r_regionkey", ["r_name"])


def landed_history(spark, folder):
    target = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    land_history(domain_tables(spark, folder, HISTORY_TABLES), target)
    return _portable(plans.person_history(
        landed(spark, target, HISTORY_TABLES), PERSON, since="1998-01-01"))


def landed_wait(spark, folder):
    target = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    land_requests(domain_tables(spark, folder, AUTHORIZATION_TABLES), target)
    return _portable(plans.authorization_wait(
        landed(spark, target, AUTHORIZATION_TABLES), start="1997-01-01", end="1998-03-31",
        collation=BINARY))


# Filters and expressions ---------------------------------------------------------------

def year_filters(spark, folder):
    orders = base_table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    day = F.col("o_orderdate")
    forms = {
        "min_year": orders.where(period_filter(day, min_year=1999)),
        "years": orders.where(period_filter(day, years=[1996, 1998, 1999])),
        "between": orders.where(period_filter(day, start="1997-02-01", end="1997-03-31")),
        "whole_last_day": orders.where(
            period_filter(day, start="1997-02-01", end="1997-03-31", inclusive_end=True)),
    }
    return tagged_union(forms, "form")


def same_month(spark, folder):
    lines = base_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = base_table(spark, folder, "orders")
    rows = lookup(lines, orders, "l_orderkey", "o_orderkey", ["o_orderdate"])
    return rows.select("l_orderkey", "l_linenumber", "o_orderdate", "l_shipdate",
                       same_period(F.col("o_orderdate"), F.col("l_shipdate")).alias("same"))


def exclude_codes_query(spark, folder):
    cases = domain_tables(spark, folder, ["aus_casos"])["aus_casos"]
    kept = cases.where(exclude_codes(F.col("mae_solicitud_tipo_codigo"), [3, 9, 10])
                       & not_deleted(F.col("borrado"))
                       & exclude_codes(F.col("mae_solicitud_estado_valor"),
                                       ["Cerrado", "Solucionado"]))
    return kept.select("id", "mae_solicitud_tipo_codigo", "mae_solicitud_estado_valor")


def case_flags(spark, folder):
    cases = domain_tables(spark, folder, ["aus_casos"])["aus_casos"]
    state = F.col("mae_solicitud_estado_valor")
    return cases.select(
        "id",
        decode(state, {"Solucionado": "Cerrado"}, keep_other=True).alias("state"),
        decode(F.col("mae_solicitud_origen_codigo"), {9: "Supersalud"},
               default="Otros canales").alias("origin"),
        decode(F.col("mae_solicitud_riesgo_vidal_valor"),
               {"No aplica": "Peticion general", "Regular": "Simple"}, keep_other=True)
        .alias("risk"),
        decode(F.col("mae_solicitud_tipo_codigo"), {0: "NO", 1: "SI", 3: "No aplica"})
        .alias("flag_or_null"),
        decode(F.col("mae_solicitud_tipo_codigo"), {1: "SI", 3: "No aplica"}, default="NO")
        .alias("flag_or_no"),
        flag(F.col("reabierto") == 1, F.col("mae_motivo_reabre_codigo") == "1")
        .alias("reopened"))


def label_fold(spark, folder):
    cases = domain_tables(spark, folder, ["au_anexos4"])["au_anexos4"]
    city = F.col("afiliado_municipio")
    return cases.select(
        "id", "afiliado_municipio",
        ci_eq(city, "MEDELLIN").alias("is_medellin"),
        ci_eq(city, "el penol").alias("is_penol"),
        ci_eq(city, "MEDELLIN", BINARY).alias("is_medellin_binary"))


def loose_compare(spark, folder):
    parts = base_table(spark, folder, "part")
    code = F.concat(
        F.when(F.col("p_partkey") % 4 == 0, "A").when(F.col("p_partkey") % 4 == 1, " ")
        .otherwise(""),
        F.col("p_size").cast("string"),
        F.when(F.col("p_partkey") % 3 == 0, "x9").when(F.col("p_partkey") % 3 == 1, ".0")
        .otherwise(""))
    return parts.select("p_partkey", code.alias("code")).select(
        "p_partkey", "code",
        loose_eq(F.col("code"), 11).alias("is_11"),
        loose_eq(F.col("code"), 0).alias("is_0"),
        mysql_truthy(F.col("code")).alias("truthy"))


def age(spark, folder):
    born = F.col("o_orderdate")
    return base_table(spark, folder, "orders").select(
        "o_orderkey",
        age_years(born, AS_OF, 365.25).alias("age_36525"),
        age_years(born, AS_OF, 365.2).alias("age_3652"),
        age_years(born, "1996-06-01", 365.25).alias("age_signed"),
        wait_days(born, F.lit(AS_OF)).alias("days"))


def cleanse(spark, folder):
    documents = base_table(spark, folder, "documents")
    clean = cleanse_text(F.col("text"), NAME_REMOVALS)
    return documents.select("doc_id", clean.alias("clean")).select(
        "doc_id", F.length("clean").cast("long").alias("length"), F.md5("clean").alias("digest"))


SUBREGION_SAMPLE = {
    "north": [f"NATION_{n}" for n in (0, 3, 6, 9)],
    "south": [f"NATION_{n}" for n in (1, 4, 7, 10, 13)],
    "coast": [f"NATION_{n}" for n in (2, 5, 8)],
}


def subregion(spark, folder):
    nation = base_table(spark, folder, "nation")
    classes = mapping_table(spark, SUBREGION_SAMPLE)
    customers = base_table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    named = lookup(customers, nation, "c_nationkey", "n_nationkey", {"name": "n_name"})
    named = named.withColumn("name", F.lower("name"))
    return classify(named, "name", classes, "none", name="subregion")


# Reports -------------------------------------------------------------------------------

def _report(plan_tables, build) -> Query:
    def query(spark, folder):
        return _portable(build(domain_tables(spark, folder, plan_tables)))
    return query


case_detail = _report(
    CASE_TABLES, lambda t: plans.case_detail(t, min_year=1998, collation=BINARY))
wide_detail = _report(
    WIDE_TABLES,
    lambda t: plans.wide_detail(t, min_year=1998, as_of=AS_OF, collation=BINARY))
consolidated_ties = _report(
    CONSOLIDATED_TABLES,
    lambda t: plans.consolidated(
        t, **{**plans.KEEP_TIES, "min_year": 1998}, as_of=AS_OF, collation=BINARY))
consolidated_one = _report(
    CONSOLIDATED_TABLES,
    lambda t: plans.consolidated(
        t, **{**plans.ONE_ROW, "min_year": 1997}, as_of=AS_OF, collation=BINARY))
TRACKING = {"created_years": [1998, 1999], "closed_years": [1998, 1999],
            "same_month_created_years": [1998, 1999], "open_years": [1999, 2000]}
monthly_tracking = _report(
    TRACKING_TABLES,
    lambda t: plans.monthly_tracking(t, **TRACKING, collation=BINARY))
monthly_tracking_distinct = _report(
    TRACKING_TABLES,
    lambda t: plans.monthly_tracking(
        t, **TRACKING, count_distinct_cases=True, collation=BINARY))
productivity = _report(
    PRODUCTIVITY_TABLES,
    lambda t: plans.productivity(t, min_year=1999, collation=BINARY))
members_by_municipality = _report(
    MEMBERS_TABLES, lambda t: plans.members_by_municipality(t, collation=BINARY))
contract_tariffs = _report(
    CONTRACTS_TABLES, lambda t: plans.contract_tariffs(t, grouping=BINARY))
contract_network = _report(
    CONTRACTS_TABLES, lambda t: plans.contract_network(t, grouping=BINARY))
consolidated_reduced = _report(
    CONSOLIDATED_TABLES,
    lambda t: plans.consolidated(
        t, **{**plans.ONE_ROW, "min_year": 1997}, as_of=AS_OF, collation=BINARY,
        reduce_first=True))
authorization_wait = _report(
    AUTHORIZATION_TABLES,
    lambda t: plans.authorization_wait(
        t, start="1997-01-01", end="1998-03-31", collation=BINARY))
person_history = _report(
    HISTORY_TABLES, lambda t: plans.person_history(t, PERSON, since="1998-01-01"))


def _respelt(tables):
    """The labels that reports compare but do not show, in other case and with accents."""
    odd = {"aus_seguimientos": "aus_casos_id", "aus_servicio_gestiones": "aus_servicios_id"}
    out = dict(tables)
    for name, key in ((n, k) for n, k in odd.items() if n in tables):
        label = F.col("mae_estado_valor")
        other = F.translate(F.lower(label), "aeo", "\u00e1\u00e9\u00f3")
        out[name] = tables[name].withColumn("mae_estado_valor", F.when(
            F.col(key) % 2 == 1, other).otherwise(F.upper(label)))
    tipo = "mae_tipo_documento_codigo"
    out["aseg_afiliados"] = tables["aseg_afiliados"].withColumn(tipo, F.lower(tipo))
    return out


def _spelt_twice(tables, name, columns):
    """Every row of a table again, with other spellings of labels that the report shows."""
    again = tables[name].withColumns(
        {c: F.translate(F.upper(c), "AEO", "\u00c1\u00c9\u00d3") for c in columns})
    return {**tables, name: tables[name].unionAll(again)}


SPELT_TARIFF = ["ma_tecnologia_valor", "ma_servicio_habilitacion_valor"]
SPELT_SERVICE = ["ma_tecnologia_valor", "mae_servicio_ambito_valor"]
contract_tariffs_folded = _report(CONTRACTS_TABLES, lambda t: plans.contract_tariffs(
    _spelt_twice(t, "cnt_contrato_detalles", SPELT_TARIFF)))
contract_network_folded = _report(CONTRACTS_TABLES, lambda t: plans.contract_network(
    _spelt_twice(t, "cnt_contrato_detalles", SPELT_TARIFF)))
wide_detail_folded = _report(WIDE_TABLES, lambda t: plans.wide_detail(
    _spelt_twice(t, "aus_caso_servicios", SPELT_SERVICE), min_year=1998, as_of=AS_OF))
productivity_folded = _report(PRODUCTIVITY_TABLES, lambda t: plans.productivity(
    _spelt_twice(t, "aus_servicio_gestiones", ["mae_estado_valor"]), min_year=1999))
case_detail_folded = _report(
    CASE_TABLES, lambda t: plans.case_detail(_respelt(t), min_year=1998))
monthly_tracking_folded = _report(
    TRACKING_TABLES, lambda t: plans.monthly_tracking(_respelt(t), **TRACKING))
members_by_municipality_folded = _report(MEMBERS_TABLES, plans.members_by_municipality)


def _feed(name: str) -> Query:
    return _report(
        HISTORY_TABLES,
        lambda t: plans.feed_history(t, PERSON, since="1998-01-01")[name])


history_labels = _report(
    HISTORY_TABLES,
    lambda t: plans.feed_history(t, PERSON, since="1998-01-01", labels=True)["urgencia"])

QUERIES: dict[str, Query] = {
    "latest_status": latest_status,
    "first_status": first_status,
    "latest_keep_ties": latest_keep_ties,
    "latest_one": latest_one,
    "milestones": milestone_pivot,
    "milestones_lookup": milestones_lookup,
    "closing_precedence": closing_precedence,
    "latest_inner": latest_inner,
    "hierarchy_code": hierarchy_code,
    "role_playing": role_playing,
    "match_strict": _match("strict"),
    "match_document": _match("document"),
    "match_type_or_truthy": _match("type_or_truthy"),
    "inner_two_keys": inner_two_keys,
    "match_strict_folded": match_strict_folded,
    "provider_chain": provider_chain,
    "loaded_tables": loaded_tables,
    "count_known_times": count_known_times,
    "count_folded": count_folded,
    "distinct_after_fanout": distinct_after_fanout,
    "year_filters": year_filters,
    "same_month": same_month,
    "exclude_codes": exclude_codes_query,
    "case_flags": case_flags,
    "label_fold": label_fold,
    "loose_compare": loose_compare,
    "age": age,
    "cleanse_text": cleanse,
    "subregion": subregion,
    "case_detail": case_detail,
    "wide_detail": wide_detail,
    "consolidated_ties": consolidated_ties,
    "consolidated_one": consolidated_one,
    "monthly_tracking": monthly_tracking,
    "monthly_tracking_distinct": monthly_tracking_distinct,
    "productivity": productivity,
    "members_by_municipality": members_by_municipality,
    "case_detail_folded": case_detail_folded,
    "milestones_incremental": milestones_incremental,
    "latest_incremental": latest_incremental,
    "hierarchy_roots": hierarchy_roots_query,
    "label_pruned": label_pruned,
    "catalog_tables": catalog_tables,
    "landed_history": landed_history,
    "landed_wait": landed_wait,
    "consolidated_reduced": consolidated_reduced,
    "contract_tariffs_folded": contract_tariffs_folded,
    "contract_network_folded": contract_network_folded,
    "wide_detail_folded": wide_detail_folded,
    "productivity_folded": productivity_folded,
    "monthly_tracking_folded": monthly_tracking_folded,
    "members_by_municipality_folded": members_by_municipality_folded,
    "contract_tariffs": contract_tariffs,
    "contract_network": contract_network,
    "authorization_wait": authorization_wait,
    "person_history": person_history,
    "history_consultations": _feed("consulta"),
    "history_urgent": _feed("urgencia"),
    "history_stays": _feed("hospitalizacion"),
    "history_procedures": _feed("procedimiento"),
    "history_labels": history_labels,
}
