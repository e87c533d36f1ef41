import datetime as dt

import pytest
from pyspark.sql import functions as F

from caseflow.functions import (
    BINARY,
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
    mysql_number,
    mysql_truthy,
    not_deleted,
    period_filter,
    same_period,
    simple_upper,
    wait_days,
    with_labels,
)
from caseflow.plans.wide_detail import NAME_REMOVALS
from tests.conftest import plan_of


def strings(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "s string")


def column(df, expression):
    return [r[0] for r in df.select(expression).collect()]


@pytest.mark.parametrize("text, number", [
    ("CC", 0.0), ("1", 1.0), ("2CC", 2.0), ("", 0.0), ("0", 0.0), ("  7 ", 7.0),
    ("-3.5x", -3.5), (".5", 0.5), ("1e2", 100.0), ("1e", 1.0), ("+4", 4.0), (None, None),
])
def test_numeric_prefix(spark, text, number):
    rows = strings(spark, text)
    assert column(rows, mysql_number(F.col("s"))) == [number]
    assert column(rows, mysql_truthy(F.col("s"))) == [None if number is None else number != 0]


def test_loose_eq_survives_letters(spark):
    rows = strings(spark, "12", "A12", "12abc", " 12.0", None)
    assert column(rows, loose_eq(F.col("s"), 12)) == [True, False, True, True, None]


def test_labels_compare_without_case_and_accents(spark):
    rows = strings(spark, "MEDELLÍN", "medellin", "PEÑOL", None)
    assert column(rows, ci_eq(F.col("s"), "Medellin")) == [True, True, False, None]
    assert column(rows, ci_eq(F.col("s"), "penol")) == [False, False, True, None]
    assert column(rows, ci_eq(F.col("s"), "medellin", BINARY)) == [False, True, False, None]
    assert column(rows, ci_in(F.col("s"), ["peñol", "x"])) == [False, False, True, None]


def test_simple_upper_keeps_sharp_s(spark):
    rows = strings(spark, "straße", "ñandú", "ß", "", None)
    assert column(rows, simple_upper(F.col("s"))) == ["STRAßE", "ÑANDÚ", "ß", "", None]


def test_decode_defaults(spark):
    rows = spark.createDataFrame([(0,), (1,), (9,), (None,)], "c int")
    col = F.col("c")
    assert column(rows, decode(col, {0: "NO", 1: "SI"})) == ["NO", "SI", None, None]
    assert column(rows, decode(col, {1: "SI"}, default="NO")) == ["NO", "SI", "NO", "NO"]
    names = strings(spark, "MEDELLIN", "Medellín", "X", None)
    assert column(names, decode(F.col("s"), {"MEDELLIN": "V"}, keep_other=True)) == [
        "V", "Medellín", "X", None]
    assert column(names, decode(F.col("s"), {"MEDELLIN": "V"}, keep_other=True,
                                collation="UNICODE_CI_AI")) == ["V", "V", "X", None]


def test_flag_counts_unknown_as_no(spark):
    rows = spark.createDataFrame([(1, "1"), (1, "2"), (0, "1"), (1, None)], "a int, b string")
    assert column(rows, flag(F.col("a") == 1, F.col("b") == "1")) == ["SI", "NO", "NO", "NO"]


def test_cleanse_order_counts(spark):
    rows = strings(spark, 'a ;b', 'x, y\r\n\tz"', "p&quot;q", "two  gaps   here", None)
    # Deleting ";" or "," joins two spaces, which the last step then deletes. The entity
    # is upper-cased before its pattern is looked for, so it stays.
    assert column(rows, cleanse_text(F.col("s"), NAME_REMOVALS)) == [
        "A B", "X YZ", "P&QUOTQ", "TWOGAPS HERE", None]
    assert column(strings(spark, "a ; b"), cleanse_text(F.col("s"), NAME_REMOVALS)) == ["AB"]
    assert column(strings(spark, "a-b]c^d\\e"),
                  cleanse_text(F.col("s"), ["-", "]", "^", "\\"], upper=False)) == ["abcde"]


def test_cleanse_equals_one_replace_after_another(spark):
    rows = strings(spark, "a;;,  b\t c\r\n&quot;", " ; ; ", '"  "', "&qu;ot x")
    step_by_step = F.upper(F.col("s"))
    for pattern in [p for p in NAME_REMOVALS if p]:
        step_by_step = F.replace(step_by_step, F.lit(pattern), F.lit(""))
    assert (column(rows, cleanse_text(F.col("s"), NAME_REMOVALS))
            == column(rows, step_by_step))


def test_age(spark):
    born = dt.date(2025, 5, 1) - dt.timedelta(days=14608)
    rows = spark.createDataFrame([(born,), (dt.date(2021, 5, 1),), (None,)], "d date")
    assert column(rows, age_years(F.col("d"), "2025-05-01", 365.25)) == [39, 4, None]
    assert column(rows, age_years(F.col("d"), "2025-05-01", 365.2)) == [40, 4, None]
    assert column(rows, age_years(F.col("d"), "2021-04-01", 365.25))[1] == 0
    assert column(rows, age_years(F.col("d")))[1] >= 4


def test_wait_days_ignore_time_of_day(spark):
    rows = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 2, 1))],
        "a timestamp_ntz, b timestamp_ntz")
    assert column(rows, wait_days(F.col("a"), F.col("b"))) == [1]


def test_geo_code_needs_both_parts(spark):
    rows = spark.createDataFrame([("05", "001"), (None, "1"), ("05", None)], "d string, m string")
    assert column(rows, geo_code(F.col("d"), F.col("m"))) == ["05001", None, None]


def test_milestone_precedence(spark):
    rows = spark.createDataFrame([(None, 2, 3), (1, 2, 3)], "a int, b int, c int")
    cols = {n: F.col(n) for n in "abc"}
    assert column(rows, coalesce_milestones(cols, ["a", "c", "b"])) == [3, 1]


def test_with_labels(spark):
    rows = strings(spark, "x")
    assert with_labels(rows, {"s": "Código prestador"}).columns == ["Código prestador"]
    with pytest.raises(ValueError):
        with_labels(rows, {"nope": "x"})


STAMPS = ["1998-12-31 23:59:59", "1999-01-01 00:00:00", "2000-06-01 12:00:00",
          "2000-12-31 23:59:59.999999", "2001-01-01 00:00:00", "2003-02-03 00:00:00"]


@pytest.fixture(scope="module")
def stamps(spark):
    rows = [(dt.datetime.fromisoformat(s),) for s in STAMPS] + [(None,)]
    return spark.createDataFrame(rows, "t timestamp_ntz")


def test_period_filter_equals_year_tests(stamps):
    t = F.col("t")

    def kept(condition):
        return sorted(r.t for r in stamps.where(condition).collect())

    assert kept(period_filter(t, min_year=2000)) == kept(F.year(t) > 1999)
    assert kept(period_filter(t, years=[1999, 2000])) == kept(F.year(t).isin(1999, 2000))
    assert kept(period_filter(t, years=[1998, 2000, 2003])) == kept(
        F.year(t).isin(1998, 2000, 2003))
    assert kept(period_filter(t, years=[])) == []
    # A closed bound at midnight loses the last day unless it is taken in whole.
    closed = period_filter(t, start="2000-01-01", end="2000-12-31")
    whole = period_filter(t, start="2000-01-01", end="2000-12-31", inclusive_end=True)
    assert (len(kept(closed)), len(kept(whole))) == (1, 2)
    with pytest.raises(ValueError):
        period_filter(t)


def test_period_filter_reaches_the_scan(spark, tables):
    cases = tables["aus_casos"].where(period_filter(F.col("fecha_hora_crea"), min_year=2023))
    assert "GreaterThanOrEqual(fecha_hora_crea,2023-01-01" in plan_of(cases)
    requests = tables["au_anexos3"].where(period_filter(F.col("fecha_solicitud"), years=[2024]))
    assert "GreaterThanOrEqual(fecha_solicitud,2024-01-01)" in plan_of(requests)


def test_same_period_equals_text_comparison(spark):
    days = [dt.datetime(y, m, 9) for y in (2022, 2023) for m in (1, 2, 11, 12)]
    pairs = spark.createDataFrame([(a, b) for a in days for b in days] + [(days[0], None)],
                                  "a timestamp_ntz, b timestamp_ntz")
    text = (F.concat(F.year("a").cast("string"), F.month("a").cast("string"))
            == F.concat(F.year("b").cast("string"), F.month("b").cast("string")))
    same = same_period(F.col("a"), F.col("b"))
    assert pairs.where(~same.eqNullSafe(text)).count() == 0


def test_unknown_codes_are_dropped(spark):
    rows = spark.createDataFrame([(0,), (1,), (3,), (None,)], "c int")
    assert column(rows.where(not_deleted(F.col("c"))), "c") == [0, 3]
    assert column(rows.where(exclude_codes(F.col("c"), [3, 9])), "c") == [0, 1]
