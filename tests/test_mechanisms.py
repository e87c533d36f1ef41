"""Kept state, hierarchies, bit sets, spellings and landed tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from caseflow import plans
from caseflow.functions import ci_eq, ci_in
from caseflow.operators import (
    StateTable,
    hierarchy_roots,
    keep_marked,
    key_marks,
    latest_per_key,
    merge_latest,
    merge_milestones,
    milestone_state,
    milestones,
    milestones_of,
)
from caseflow.operators import skew
from caseflow.plans import common
from caseflow.sources import label_spellings, land_history, land_requests, landed, star_schema
from caseflow.sources import spellings as spelling_source
from caseflow.plans.person_history import TABLES as HISTORY_TABLES
from caseflow.sources.landing import MONTH, of_person
from tests.conftest import DATA, plan_of

STATES = {"A": "a_at", "B": "b_at"}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def day(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def entries(spark):
    generator = random.Random(11)
    data = [(generator.choice([1, 2, 3, 4, None]), generator.choice(["A", "a", "B", "C", None]),
             day(generator.choice([None, *range(20)])), i) for i in range(300)]
    return spark.createDataFrame(data, "k int, state string, t timestamp_ntz, id int").cache()


def parts_of(df):
    """Three batches that know nothing of the order of time, and the first one again."""
    parts = [df.where(F.col("id") % 3 == n) for n in (1, 2, 0)]
    return [*parts, parts[0]]


@pytest.mark.parametrize("unknown", ["ignore", "first"])
@pytest.mark.parametrize("collation", ["binary", "UNICODE_CI_AI"])
def test_merged_milestones_equal_those_of_the_whole_log(entries, unknown, collation):
    states = [milestone_state(p, ["k"], "state", "t", STATES, collation)
              for p in parts_of(entries)]
    merged = milestones_of(merge_milestones(states, ["k"]), ["k"], unknown)
    whole = milestones(entries, "k", "state", "t", STATES, collation=collation, unknown=unknown)
    assert rows(merged) == rows(whole)
    with pytest.raises(ValueError):
        milestones_of(states[0], ["k"], "last")


def test_merged_newest_rows_equal_those_of_the_whole_log(entries):
    states = [latest_per_key(p, ["k"], "t", ["id"]) for p in parts_of(entries)]
    assert rows(merge_latest(states, ["k"], "t", ["id"])) == rows(
        latest_per_key(entries, ["k"], "t", ["id"]).select(states[0].columns))


def test_a_state_table_takes_batches_again_and_compacts(spark, entries, tmp_path):
    table = StateTable(spark, str(tmp_path / "state"),
                       lambda states: merge_milestones(states, ["k"]))
    with pytest.raises(ValueError):
        table.read()
    parts = parts_of(entries)
    for name, part in zip(("01", "02", "03"), parts):
        table.add(name, milestone_state(part, ["k"], "state", "t", STATES))
    table.add("02", milestone_state(parts[1], ["k"], "state", "t", STATES))
    whole = rows(milestones(entries, "k", "state", "t", STATES))
    assert rows(milestones_of(table.read(), ["k"])) == whole
    table.compact()
    table.compact()
    assert rows(milestones_of(table.read(), ["k"])) == whole
    assert "_batch=b03" in str(sorted((tmp_path / "state" / "base").iterdir()))
    with pytest.raises(ValueError):
        table.add("03", milestone_state(parts[2], ["k"], "state", "t", STATES))
    # What is late comes under a new name.
    late = spark.createDataFrame([(9, "A", day(1), 1), (1, "A", day(-5), 2)], entries.schema)
    table.add("04", milestone_state(late, ["k"], "state", "t", STATES))
    assert rows(milestones_of(table.read(), ["k"])) == rows(
        milestones(entries.unionAll(late), "k", "state", "t", STATES))
    table.compact()
    assert len(table._live()) == 2 and table._live()[1].count() == 0


def test_roots_of_long_chains_trees_and_cycles(spark):
    chain = [(i, i - 1 if i else None) for i in range(1000)]
    tree = [(2000 + i, 2000 + (i - 1) // 3 if i else None) for i in range(200)]
    cycle = [(3000, 3002), (3001, 3000), (3002, 3001), (3003, 3000), (3004, 3003), (3005, 3005)]
    odd = [(4000, 9999), (4001, 4000), (None, 1)]
    shuffled = chain + tree + cycle + odd
    random.Random(1).shuffle(shuffled)
    found = {r.n: (r.root, r.depth, r.in_cycle) for r in hierarchy_roots(
        spark.createDataFrame(shuffled, "n int, up int"), "n", "up").collect()}
    assert len(found) == len(shuffled) - 1
    assert all(found[i] == (0, i, False) for i in range(1000))

    def depth(i):
        return 0 if i == 0 else 1 + depth((i - 1) // 3)

    assert all(found[2000 + i] == (2000, depth(i), False) for i in range(200))
    assert all(found[n] == (None, None, True) for n, _ in cycle)
    assert (found[4000], found[4001]) == ((4000, 0, False), (4000, 1, False))
    empty = hierarchy_roots(spark.createDataFrame([], "n int, up int"), "n", "up")
    assert empty.columns == ["n", "root", "depth", "in_cycle"] and not rows(empty)


def test_marked_rows_are_kept_and_few_others(spark):
    kept = spark.createDataFrame([(i * 7,) for i in range(500)] + [(None,)], "k long")
    log = spark.createDataFrame([(i, i) for i in range(5000)] + [(None, -1)], "k long, id int")
    found = keep_marked(log, "k", key_marks(kept, "k"))
    assert found.columns == ["k", "id"]
    wanted = rows(log.join(kept, ["k"], "left_semi"))
    assert set(wanted) <= set(rows(found)) and len(rows(found)) <= len(wanted) + 2
    narrow = log.withColumn("k", F.col("k").cast("int"))
    assert rows(keep_marked(narrow, "k", key_marks(kept, "k"))) == rows(found)
    # A set that is too small lets more through, but loses nothing.
    small = rows(keep_marked(log, "k", key_marks(kept, "k", 64), 64))
    assert set(wanted) <= set(small)
    assert key_marks(kept, "k", 64).count() == 1
    none = keep_marked(log, "k", key_marks(kept.where("false"), "k"))
    assert rows(none) == []


def test_every_bit_of_a_map_is_found(spark):
    bits = 3 * 7 * 4096 + 5
    keys = spark.range(400_000).select(F.col("id").alias("k"))
    marks = key_marks(keys, "k", bits)
    assert marks.count() == 4
    assert keep_marked(keys, "k", marks, bits).count() == 400_000
    half = key_marks(keys.where("k < 60000"), "k", bits)
    # 60,000 keys over these bits set 50 % of them.
    assert 0.45 < keep_marked(keys.where("k >= 200000"), "k", half, bits).count() / 200_000 < 0.55


def test_reduction_comes_before_any_shuffle_of_the_logs(spark):
    folder = DATA.replace("0.001", "0.01")
    tables = star_schema.domain_tables(spark, folder, list(star_schema.DOMAIN_SQL))
    cases = common.live_cases(tables).where("year(fecha_hora_crea) = 1998")
    small = common.reduced(tables, cases)
    for name, key, wanted in (("aus_seguimientos", "aus_casos_id", cases),
                              ("aus_caso_servicios", "aus_casos_id", cases)):
        kept = small[name].join(wanted.select(F.col("id").alias(key)), [key], "left_semi")
        plain = tables[name].join(wanted.select(F.col("id").alias(key)), [key], "left_semi")
        assert kept.count() == plain.count()
        assert small[name].count() <= plain.count() * 1.01 + 2 < tables[name].count() / 3
        # Above the read of the log there is the test, and no exchange.
        plan = plan_of(small[name])
        probe = plan[:plan.index("BroadcastExchange")]
        assert "BroadcastHashJoin" in probe and "hashpartitioning" not in probe
    log = small["aus_servicio_gestiones"].count()
    assert 0 < log < tables["aus_servicio_gestiones"].count() / 3


def scanned(df):
    """Rows that the scans of an executed plan gave out, and the plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName().startswith("AdaptiveSparkPlan") else plan

    def walk(node):
        own = node.metrics().get("numOutputRows").get().value() if node.nodeName().startswith(
            "Scan parquet") else 0
        children = node.children()
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(plan), plan.toString()


def test_folded_labels_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "log")
    labels = F.element_at(F.array(*[F.lit(v) for v in (
        "Abierto", "ABIERTO", "CERRADO", "Cerrádo", "Estudio")]),
        (F.col("id") / 4000).cast("int") + 1)
    spark.range(20_000).select("id", labels.alias("mae_estado_valor")).coalesce(1).write.option(
        "parquet.block.size", 16 << 10).option("parquet.page.row.count.limit", 1000).parquet(path)
    log = spark.read.parquet(path)
    known = label_spellings({"log": log})
    assert known == "UNICODE_CI_AI" and known.of("mae_estado_valor", ["cerrado"]) == [
        "CERRADO", "Cerrádo"]
    folded = log.where(ci_eq(F.col("mae_estado_valor"), "cerrado"))
    listed = log.where(ci_eq(F.col("mae_estado_valor"), "cerrado", known))
    assert rows(listed) == rows(folded) and listed.count() == 8000
    all_rows, _ = scanned(folded)
    some_rows, plan = scanned(listed)
    assert "PushedFilters: [In(mae_estado_valor, [CERRADO,Cerrádo])]" in plan
    assert some_rows < all_rows == 20_000
    # Labels that are nowhere, several labels, and columns that are not known.
    nobody = ci_in(F.col("mae_estado_valor"), ["nowhere"], known)
    assert log.where(nobody).count() == 0 and log.where(~nobody).count() == 20_000
    both = ci_in(F.col("mae_estado_valor"), ["ESTUDIO", "abierto"], known)
    assert log.where(both).count() == 12_000
    other = log.withColumnRenamed("mae_estado_valor", "x")
    assert other.where(ci_eq(F.col("x"), "cerrado", known)).count() == 8000


def test_reports_are_the_same_with_known_spellings(spark, tables):
    known = label_spellings(tables)
    assert rows(plans.monthly_tracking(tables)) == rows(
        plans.monthly_tracking(tables, collation=known))
    assert rows(plans.case_detail(tables)) == rows(plans.case_detail(tables, collation=known))
    assert rows(plans.members_by_municipality(tables)) == rows(
        plans.members_by_municipality(tables, collation=known))
    assert "In(mae_estado_valor" in plan_of(plans.case_detail(tables, collation=known)) or (
        "EqualTo(mae_estado_valor" in plan_of(plans.case_detail(tables, collation=known)))


def test_columns_with_too_many_labels_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(spelling_source, "MOST_SPELLINGS", 3)
    df = spark.createDataFrame([(str(i), "x") for i in range(9)], "a string, b string")
    known = label_spellings({"t": df}, ["a", "b"])
    assert known.of("a", ["1"]) is None and known.of("b", ["X"]) == ["x"]
    with pytest.raises(ValueError):
        label_spellings({"t": df}, ["c"])


def test_history_of_a_person_reads_one_folder(spark, tables, tmp_path):
    folder = str(tmp_path / "history")
    feeds = {n: tables[n] for n in HISTORY_TABLES}
    land_history(feeds, folder, folders=8)
    again = landed(spark, folder, HISTORY_TABLES)
    for name in feeds:
        assert rows(again[name].select(feeds[name].columns)) == rows(feeds[name])
    people = {r[0] for f in feeds.values() for r in f.select("documento_afiliado").collect()}
    for person in [*filter(None, people), "nobody"]:
        found = plans.person_history(again, person, since="1900-01-01")
        assert rows(found) == rows(plans.person_history(tables, person, since="1900-01-01"))
        planned = plan_of(plans.person_history(again, person, since="1900-01-01"))
        assert planned.count("PartitionFilters: [isnotnull(_person_of_8") == len(feeds)
    # The scans give out the rows of one folder of each feed, not all of them.
    person = min(filter(None, people))
    read, _ = scanned(plans.person_history(again, person, since="1900-01-01"))
    held = sum(feed.where(of_person(feed, person)).count() for feed in again.values())
    assert read <= held < sum(feed.count() for feed in again.values())


def test_waiting_times_read_the_months_of_the_period(spark, tables, tmp_path):
    folder = str(tmp_path / "requests")
    land_requests(tables, folder)
    names = ["au_anexos3", "au_anexos4", "au_anexo4_items"]
    again = landed(spark, folder, names)
    for name in names:
        assert rows(again[name].drop(MONTH)) == rows(tables[name])
    for period in (("2024-01-01", "2025-03-31"), ("2024-02-10", "2024-02-20")):
        found = plans.authorization_wait(again, start=period[0], end=period[1])
        assert rows(found) == rows(
            plans.authorization_wait(tables, start=period[0], end=period[1]))
        planned = plan_of(plans.authorization_wait(again, start=period[0], end=period[1]))
        assert planned.count(f"PartitionFilters: [isnotnull({MONTH}") == 3


def test_a_document_of_many_persons_and_members_stays_bounded(spark, tables, monkeypatch):
    """What goes to every task is a list of keys, however many persons are behind one."""
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    persons = spark.range(1000, 1400).selectExpr(
        "id", "'CC' AS mae_tipo_documento_codigo", "'' AS documento", "'F' AS mae_sexo_codigo",
        "0 AS discapacidad")
    base = tables["aseg_afiliados"]
    members = base.where("numero_documento IS NOT NULL").limit(1).crossJoin(
        spark.range(30).select("id").withColumnRenamed("id", "_n")).withColumn(
        "numero_documento", F.lit("")).withColumn(
        "mae_tipo_documento_codigo", F.lit("CC")).drop("_n")
    cases = tables["aus_casos"].where("id = 10").crossJoin(
        spark.range(1000, 1400).select(F.col("id").alias("_p"))).withColumn(
        "aus_personas_id", F.col("_p")).withColumn("id", F.col("_p")).drop("_p")
    crowd = {**tables,
             "aus_personas": tables["aus_personas"].unionByName(
                 persons.select([F.col(f.name).cast(f.dataType) for f in
                                 tables["aus_personas"].schema])),
             "aseg_afiliados": base.unionByName(members.select(base.columns)),
             "aus_casos": tables["aus_casos"].unionByName(
                 cases.select([F.col(f.name).cast(f.dataType) for f in
                               tables["aus_casos"].schema]))}
    detail = plans.case_detail(crowd, match="document")
    blank = base.where("numero_documento = ''").count()
    assert detail.where("numero_solicitud_pqrsf >= 1000").count() == 400 * (30 + blank)
