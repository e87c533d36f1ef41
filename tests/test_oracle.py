"""Every registered query against its SQL, as planned here and as planned at scale."""

import pytest

import __spark_entry__ as entry
from caseflow import plans
from caseflow.operators import skew
from caseflow.sources import star_schema
from checks.compare import compare, connect
from checks.oracle import ORACLE
from checks.queries import QUERIES
from tests.conftest import DATA, plan_of

SPLIT = ["case_detail", "wide_detail", "consolidated_ties", "consolidated_one",
         "monthly_tracking", "monthly_tracking_distinct", "productivity", "contract_tariffs",
         "contract_network", "authorization_wait", "match_strict", "match_document",
         "match_type_or_truthy", "role_playing", "provider_chain", "case_detail_folded",
         "match_strict_folded", "contract_tariffs_folded", "wide_detail_folded",
         "productivity_folded"]


@pytest.fixture(scope="module")
def connection():
    with connect(DATA) as found:
        yield found


def test_entry_points_agree():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.items() <= entry.queries().items()
    assert ORACLE.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, connection, name):
    count, problem = compare(spark, connection, DATA, name)
    assert not problem and count > 0


@pytest.mark.parametrize("name", SPLIT)
def test_query_equals_sql_with_hot_keys_split(spark, connection, monkeypatch, name):
    """Everything with two rows is hot, no dimension is broadcast."""
    monkeypatch.setattr(skew, "BROADCAST_LIMIT", 0)
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    count, problem = compare(spark, connection, DATA, name)
    assert not problem and count > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_plans_stay_on_the_jvm_without_nested_loops(spark, name):
    plan = plan_of(QUERIES[name](spark, DATA))
    for operator in ("NestedLoop", "Cartesian", "Python", "InPandas"):
        assert operator not in plan


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def test_plans_are_compiled_as_whole_stages(spark):
    """Projections, filters, joins and hash aggregates all carry the codegen mark."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name, query in QUERIES.items():
            lines = [line.lstrip(" :+-") for line in plan_of(query(spark, DATA)).splitlines()]
            outside = [line for line in lines if line.startswith(
                ("Project", "Filter", "Generate", "HashAggregate", "SortMergeJoin",
                 "BroadcastHashJoin"))]
            assert not outside, (name, outside)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")



def test_building_a_report_runs_no_job(spark):
    """Beyond the reading of file footers: hot keys are counted within the report's plan."""
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    tables = star_schema.domain_tables(spark, DATA, list(star_schema.DOMAIN_SQL))
    context.setJobGroup("building", "")
    plans.case_detail(tables)
    plans.wide_detail(tables)
    plans.consolidated(tables, **plans.KEEP_TIES)
    plans.monthly_tracking(tables)
    plans.productivity(tables)
    plans.contract_tariffs(tables)
    plans.authorization_wait(tables)
    assert not tracker.getJobIdsForGroup("building")
    context.setLocalProperty("spark.jobGroup.id", None)


def test_hot_keys_are_counted_without_a_single_partition(spark):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    assert "SinglePartition" not in plan_of(skew.hot_keys(lines, ["l_suppkey"]))


def test_latest_rows_are_not_sort_aggregated(spark):
    for name in ("latest_status", "first_status", "latest_inner"):
        assert "SortAggregate" not in plan_of(QUERIES[name](spark, DATA))


def test_reducing_to_the_kept_cases_first_changes_nothing(spark):
    tables = star_schema.domain_tables(spark, DATA, list(star_schema.DOMAIN_SQL))
    day = {"as_of": "2025-05-01"}
    for build, options in ((plans.case_detail, {}), (plans.wide_detail, day),
                           (plans.consolidated, {**plans.KEEP_TIES, **day})):
        options = {**options, "min_year": 2000}
        plain = sorted(map(repr, build(tables, **options).collect()))
        assert plain and plain == sorted(
            map(repr, build(tables, **options, reduce_first=True).collect()))
