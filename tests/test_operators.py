import datetime as dt

import pandas
import pytest
from pyspark.sql import functions as F

from caseflow.data.subregions import SUBREGIONS
from caseflow.operators import (
    classify,
    count_by,
    distinct_rows,
    first_per_key,
    flatten_hierarchy,
    hot_keys,
    latest_per_key,
    lookup,
    mapping_table,
    match_member,
    milestones,
    pack_texts,
    plain_key,
    skew_join,
    tagged_union,
    unpack_texts,
)
from caseflow.functions import collation_class
from caseflow.functions.semantics import not_plain, plain_class, plain_spelling
from caseflow.operators import skew
from tests.conftest import DATA, plan_of


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def at(hour):
    return dt.datetime(2024, 1, 1, hour) if hour is not None else None


LOG = [(1, "a", 3, 1), (1, "a", 5, 2), (1, "a", 5, 3), (1, "b", None, 4), (1, "b", 4, 5),
       (2, "b", None, 6), (None, "a", 1, 7), (None, "a", 2, 8), (3, "c", 9, 9)]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([(k, s, at(h), i) for k, s, h, i in LOG],
                                 "k int, state string, t timestamp_ntz, id int")


def test_latest_takes_the_highest_tie_break_and_nulls_last(log):
    assert rows(latest_per_key(log, ["k"], "t", ["id"], cols=["id"])) == [
        (1, 3), (2, 6), (3, 9), (None, 8)]
    assert rows(latest_per_key(log, ["k"], "t", ["id"], where=F.col("state") == "a",
                               cols=["t", "id"])) == [(1, at(5), 3), (None, at(2), 8)]


def test_latest_keeps_ties(log):
    kept = latest_per_key(log, ["k"], "t", [], cols=["id"], ties="all")
    assert rows(kept) == [(1, 2), (1, 3), (2, 6), (3, 9), (None, 8)]
    assert "WindowGroupLimit" in plan_of(kept)


def test_first_takes_nulls_first(log):
    assert rows(first_per_key(log, ["k"], "t", ["id"], cols=["id"])) == [
        (1, 4), (2, 6), (3, 9), (None, 7)]
    assert rows(first_per_key(log, ["k"], "t", [], cols=["t"])) == [
        (1, None), (2, None), (3, at(9)), (None, at(1))]
    assert rows(first_per_key(log, ["k"], "t", [], cols=["id"], ties="all")) == [
        (1, 4), (2, 6), (3, 9), (None, 7)]


def test_whole_rows_need_a_tie_break(log):
    with pytest.raises(ValueError):
        latest_per_key(log, ["k"], "t", [])
    with pytest.raises(ValueError):
        latest_per_key(log, ["k"], "t", ["id"], ties="some")


def test_latest_time_only_is_a_hash_aggregate(log):
    plan = plan_of(latest_per_key(log, ["k"], "t", [], cols=["t"]))
    assert "HashAggregate" in plan and "Window" not in plan and "Sort" not in plan


def test_milestones_equal_one_lookup_per_state(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    states = ["signup", "view", "click", "purchase", "error"]
    pivot = milestones(events, "user_id", "event_type", "ts", states)
    single = events.select("user_id").distinct()
    for state in states:
        first = first_per_key(events, ["user_id"], "ts", ["event_id"],
                              where=F.col("event_type") == state, cols=["ts", "event_id"])
        single = lookup(single, first, "user_id", "user_id", {state: "ts"})
    assert rows(pivot) == rows(single.select("user_id", *states))


def test_milestones_scan_and_shuffle_once(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    plan = plan_of(milestones(events, "user_id", "event_type", "ts", ["view", "click"]))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert "PushedFilters: [In(event_type" in plan


def test_milestones_ignore_null_times_and_other_states(log):
    reached = milestones(log, "k", "state", "t", {"a": "first_a", "b": "first_b"})
    assert rows(reached) == [(1, at(3), at(4)), (2, None, None), (None, at(1), None)]
    assert rows(milestones(log, "k", "state", "t", ["a"], agg="max")) == [
        (1, at(5)), (None, at(2))]
    folded = milestones(log, "k", "state", "t", {"A": "x"}, collation="UNICODE_CI_AI")
    assert rows(folded) == [(1, at(3)), (None, at(1))]


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(1, "Ana"), (2, "Luis"), (2, "Eva")], "id int, name string")


def test_lookup_roles_and_repeated_keys(spark, users):
    facts = spark.createDataFrame([(10, 1, 2), (11, None, 1), (12, 9, 9)],
                                  "f int, owner int, helper int")
    both = lookup(facts, users, "owner", "id", ["name"], prefix="owner_")
    both = lookup(both, users, "helper", "id", {"helper_name": "name"})
    assert both.columns == ["f", "owner", "helper", "owner_name", "helper_name"]
    assert rows(both.select("f", "owner_name", "helper_name")) == [
        (10, "Ana", "Eva"), (10, "Ana", "Luis"), (11, None, "Ana"), (12, None, None)]
    unique = lookup(facts, users, "helper", "id", ["name"], require_unique=True)
    assert rows(unique.select("f", "name")) == [(10, "Eva"), (11, "Ana"), (12, None)]
    assert lookup(facts, users, "owner", "id", ["name"], how="inner").count() == 1
    with pytest.raises(ValueError):
        lookup(both, users, "owner", "id", {"helper_name": "name"})


def test_lookup_broadcasts_only_small_dimensions(spark, monkeypatch):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", "l_suppkey")
    suppliers = spark.read.parquet(f"{DATA}/supplier.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = lookup(lines, suppliers, "l_suppkey", "s_suppkey", ["s_name"])
        assert "BroadcastHashJoin" in plan_of(small)
        monkeypatch.setattr(skew, "BROADCAST_LIMIT", 0)
        large = lookup(lines, suppliers, "l_suppkey", "s_suppkey", ["s_name"])
        assert "SortMergeJoin" in plan_of(large)
        assert rows(small) == rows(large)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hierarchy(spark):
    places = spark.createDataFrame(
        [(1, None, "root"), (2, 1, "mid"), (3, 2, "leaf"), (4, 99, "lost")],
        "id int, up int, name string")
    assert rows(flatten_hierarchy(places, "id", "up", ["name"])) == [
        (1, "root", None), (2, "mid", "root"), (3, "leaf", "mid"), (4, "lost", None)]
    deep = flatten_hierarchy(places, "id", "up", ["name"], depth=3)
    assert deep.columns == ["id", "name", "parent_name", "parent_parent_name"]
    assert (3, "leaf", "mid", "root") in rows(deep)


def matched(tables, mode, collation="binary"):
    persons = tables["aus_personas"].select("id", "mae_tipo_documento_codigo", "documento")
    members = tables["aseg_afiliados"].select(
        "numero_documento", F.col("mae_tipo_documento_codigo").alias("mtipo"),
        F.col("mae_estado_afiliacion_valor").alias("state"))
    return match_member(persons, members, "documento", "mae_tipo_documento_codigo", mode,
                        "numero_documento", "mtipo", collation)


def test_match_modes(tables):
    def found(mode):
        return rows(matched(tables, mode).select("id", "state"))

    assert found("strict") == [
        (1, "activo"), (2, None), (3, None), (4, None), (5, None), (6, "activo"),
        (7, "Retirado"), (8, None), (9, "activo")]
    assert found("type_or_truthy") == [
        (1, "activo"), (2, "Activo"), (2, "Retirado"), (3, None), (4, None), (5, None),
        (6, "activo"), (7, "Retirado"), (8, None), (9, "activo")]
    assert found("document") == [
        (1, "activo"), (2, "Activo"), (2, "Retirado"), (3, "Activo"), (3, "Retirado"),
        (4, None), (5, "activo"), (6, "activo"), (7, "Activo"), (7, "Retirado"), (8, None),
        (9, "activo")]


def test_match_never_nests_loops(tables):
    for mode in ("strict", "document", "type_or_truthy"):
        plan = plan_of(matched(tables, mode))
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_match_under_collation(spark):
    persons = spark.createDataFrame([(1, "cc", "ab1")], "id int, t string, d string")
    members = spark.createDataFrame([("AB1", "CC", "x")], "md string, mt string, v string")

    def value(collation):
        found = match_member(persons, members, "d", "t", "strict", "md", "mt", collation)
        return found.first().v

    assert (value("binary"), value("UNICODE_CI_AI")) == (None, "x")


def test_count_by_and_weight(spark):
    data = spark.createDataFrame([("a", 1), ("a", None), ("b", None)], "g string, v int")
    assert rows(count_by(data, ["g"])) == [("a", 2), ("b", 1)]
    assert rows(count_by(data, ["g"], non_null="v", name="x")) == [("a", 1), ("b", 0)]
    pre = count_by(data, ["g", "v"], name="w")
    assert rows(count_by(pre, ["g"], weight="w")) == [("a", 2), ("b", 1)]


def test_tagged_union(spark):
    one = spark.createDataFrame([(1, "x")], "a bigint, b string")
    two = spark.createDataFrame([("y", 2)], "b string, a int")
    union = tagged_union({"1": one, "2": two}, "tag")
    assert union.columns == ["a", "b", "tag"]
    assert rows(union) == [(1, "x", "1"), (2, "y", "2")]
    with pytest.raises(TypeError):
        tagged_union({"2": two, "1": one.select("b", "a")}, "tag")
    with pytest.raises(TypeError):
        tagged_union({"1": one, "3": one.select("a", F.lit(1).alias("b"))}, "tag")
    with pytest.raises(ValueError):
        tagged_union({"1": one, "2": two.drop("b")}, "tag")


def test_subregion_lists():
    sizes = [len(names) for names in SUBREGIONS.values()]
    assert sizes == [10, 23, 17, 10, 19, 23, 6, 6, 11]
    names = [n for group in SUBREGIONS.values() for n in group]
    assert len(set(names)) == len(names) == 125


def test_classify(spark):
    places = spark.createDataFrame([("medellín",), ("MEDELLIN",), ("El Peñol",), ("x",), (None,)],
                                   "m string")
    mapping = mapping_table(spark, SUBREGIONS)
    exact = classify(places, "m", mapping, "none")
    assert dict(rows(exact)) == {"medellín": "Valle de Aburrá", "MEDELLIN": "none",
                                 "El Peñol": "Oriente", "x": "none", None: "none"}
    folded = classify(places, "m", mapping, "none", fold=True)
    assert dict(rows(folded))["MEDELLIN"] == "Valle de Aburrá"
    assert "BroadcastHashJoin" in plan_of(exact)


# Skewed joins --------------------------------------------------------------------------

@pytest.fixture(scope="module")
def skewed(spark):
    """A third of each side under one key, NULL keys, keys of one side only."""
    left = [(7, i) for i in range(300)] + [(i % 50 + 100, i) for i in range(500)]
    left += [(None, i) for i in range(100)] + [(999, 1)]
    right = [(7, i) for i in range(40)] + [(i % 60 + 90, i) for i in range(60)] + [(None, 1)]
    right += [(100, i) for i in range(45)]
    return (spark.createDataFrame(left, "k int, l int"),
            spark.createDataFrame(right, "k int, r int"))


def hot(df):
    return hot_keys(df, ["k"], min_rows=20)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("split", ["left", "right", "both"])
def test_split_join_equals_plain_join(skewed, how, split):
    left, right = skewed
    joined = skew_join(left, right, ["k"], how,
                       hot_left=hot(left) if split != "right" else None,
                       hot_right=hot(right) if split != "left" else None)
    plain = skew_join(left, right, ["k"], how)
    assert joined.columns == plain.columns == ["k", "l", "r"]
    assert rows(joined) == rows(plain)
    assert rows(joined) == rows(left.join(right, ["k"], how))


def test_hot_keys_are_cut_into_parts(skewed):
    left, right = skewed
    assert rows(hot(left)) == [(7, 15)]
    assert rows(hot(right)) == [(100, 3), (7, 2)]
    assert rows(hot_keys(left, ["k"], min_rows=301)) == []


def test_many_null_keys_are_spread(spark):
    left = spark.createDataFrame([(None, i) for i in range(200)] + [(1, 1)], "k int, l int")
    right = spark.createDataFrame([(1, 5), (None, 6)], "k int, r int")
    found = hot(left)
    assert found.count() == 0
    joined = skew_join(left, right, ["k"], "left", hot_left=found)
    assert rows(joined) == rows(left.join(right, ["k"], "left"))


def test_parts_are_spread_and_repeatable(skewed):
    left, _ = skewed
    marked = left.join(hot(left).withColumnRenamed("_parts", "_left_parts"), ["k"], "left")
    part = skew._part(["k", "l"], ["k"], "_left_parts", spread_nulls=True).alias("part")
    parts = marked.select("k", "l", part)
    sizes = [r["count"] for r in parts.where("k = 7").groupBy("part").count().collect()]
    assert len(sizes) == 15 and max(sizes) < 60
    assert parts.where("k is null").select("part").distinct().count() > 50
    assert parts.where("k >= 100").select("part").distinct().count() == 1
    assert rows(parts) == rows(marked.repartition(7).select("k", "l", part))


def test_spellings_that_compare_equal_are_one_key(spark):
    rows_ = [("cc",)] * 40 + [("CC",)] * 40
    df = spark.createDataFrame(rows_, "k string").select(F.collate("k", "UNICODE_CI_AI").alias("k"))
    assert [r["_parts"] for r in hot_keys(df, ["k"], min_rows=50).collect()] == [2]


def test_many_rows_of_one_key_in_a_small_file_are_split(spark, tmp_path):
    spark.range(2_000_001).select(F.lit(7).alias("k")).write.parquet(str(tmp_path / "t"))
    assert rows(hot_keys(spark.read.parquet(str(tmp_path / "t")), ["k"])) == [(7, 3)]


def test_the_list_of_hot_keys_is_bounded_and_keeps_the_heaviest(spark, monkeypatch):
    monkeypatch.setattr(skew, "MAX_HOT", 5)
    sizes = {k: 10 + k for k in range(40)}
    df = spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)], "k int")
    found = rows(hot_keys(df, ["k"], min_rows=10))
    assert [k for k, _ in found] == [35, 36, 37, 38, 39]
    # With fewer buckets than keys, the heaviest buckets are still counted by key.
    monkeypatch.setattr(skew, "BUCKETS", 3)
    assert rows(hot_keys(df, ["k"], min_rows=10)) == found


def test_keys_without_weight_cost_no_second_pass(spark, tmp_path):
    spark.range(5000).select(F.col("id").alias("k")).write.parquet(str(tmp_path / "t"))
    found = hot_keys(spark.read.parquet(str(tmp_path / "t")), ["k"])
    assert rows(found) == []
    plan = plan_of(found)
    first = plan[plan.index("Final Plan"):plan.index("Initial Plan")]
    assert first.count("FileScan") <= 1


def test_parts_made_from_shown_columns_keep_equal_rows_together(spark):
    left = spark.createDataFrame([(7, "a"), (8, "b"), (9, "c")], "k int, l string")
    right = spark.createDataFrame(
        [(7, i % 13, i) for i in range(200)] + [(8, 1, 1), (8, 1, 2)], "k int, shown int, id int")
    joined = skew_join(left, right, ["k"], "left", hot_right=hot(right),
                       spread_right=["shown"], keep_part=True)
    kept = joined.select("k", "l", "shown", "_right_part").distinct()
    assert kept.where("k = 7").select("_right_part").distinct().count() > 3
    expected = left.join(right, ["k"], "left").select("k", "l", "shown").distinct()
    assert rows(kept.drop("_right_part")) == rows(expected)
    with pytest.raises(ValueError):
        skew_join(left, right, ["k"], "left", keep_part=True)


def test_distinct_rows_under_a_collation(spark):
    data = [("Abc", 1, "x"), ("ABC", 1, "X"), ("ábc", 1, "x"), ("abc", 2, "x"),
            (None, 1, "x"), (None, 1, "X"), ("Abc", 1, None), ("Abc", 1, "x")]
    df = spark.createDataFrame(data, "a string, n int, b string")
    assert len(rows(distinct_rows(df))) == 7
    folded = rows(distinct_rows(df, "UNICODE_CI_AI"))
    assert folded == sorted(
        [("ABC", 1, "X"), ("Abc", 1, None), (None, 1, "X"), ("abc", 2, "x")], key=repr)


def test_classes_of_a_collation_agree_for_equal_spellings(spark):
    pairs = [("Café", "CAFE"), ("Ñandú", "nandu"), ("9a", "9A"), ("ß", "SS"),
             ("\u0001x", "x"), ("zz", "ZZ"), ("", ""), ("-1", "-1"), ("ﬁn", "FIN")]
    df = spark.createDataFrame(pairs, "a string, b string")
    equal = df.where(F.collate("a", "UNICODE_CI_AI") == F.collate("b", "UNICODE_CI_AI"))
    assert equal.count() >= 7
    assert equal.where(collation_class(F.col("a")) != collation_class(F.col("b"))).count() == 0
    spread = spark.createDataFrame([(c,) for c in "0aBcz9é-"], "a string")
    assert spread.select(collation_class(F.col("a"))).distinct().count() == 7


def test_plain_spellings_agree_with_the_collation(spark):
    """Every character of Unicode alone, after an l and inside a text, and odd texts."""
    known = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    odd = ["col\u00b7lab", "collab", "L\u0387", "l\u0307\u00b7", "\u0140a", "\u00b7", "Stra\u00dfe",
           "STRASSE", "\u2026", "...", "a\x00b", "AB", "\u00bd", "1\u20442", "\ufb01n", "f\u0131n",
           "FIN", "e\u0301", "\uff25", "", "\x01", "\u200d", " ", "\u00a0", "\u4e2d", "\u0418\u0306",
           "\u0419", "\u0627\u0653", "\u0622", "\U0001d400", "\ufdd1L", "\ufffd"]
    texts = [t for c in known for t in (c, f"x{c}Y")] + odd
    schema = "a string"
    df = spark.createDataFrame(pandas.DataFrame({"a": texts}), schema)
    spelt = df.select("a", plain_spelling(F.col("a")).alias("p")).select(
        "a", "p", F.col("p").rlike(not_plain()).alias("other"))
    # A text with a plain spelling equals it; one without equals none of those.
    assert spelt.where(~F.col("other") & (F.collate("a", "UNICODE_CI_AI") != F.col("p"))).count() == 0
    plain = spelt.where("NOT other").select(F.collate("p", "UNICODE_CI_AI").alias("k")).distinct()
    others = spelt.where("other").select(F.collate("a", "UNICODE_CI_AI").alias("k"))
    assert others.join(plain, "k", "left_semi").count() == 0
    # Different plain spellings are different texts.
    per_class = spelt.where("NOT other").groupBy(F.collate("p", "UNICODE_CI_AI").alias("k"))
    assert per_class.agg(F.countDistinct("p").alias("n")).where("n > 1").count() == 0


def test_rows_are_folded_by_bytes_and_odd_texts_by_the_collation(spark):
    data = [("Stra\u00dfe", "\u4e2d", 1), ("STRASSE", "\u4e2d", 1), ("strasse", "x", 1),
            ("STRASSE", "X", 1), ("\u0419", None, 1), ("\u0439", None, 1), ("\u0439", "", 1),
            ("a\x01", "b", 1), ("a", "\x01b", 1), ("a", None, 1), ("a", "\x02", 1)]
    df = spark.createDataFrame(data, "a string, b string, n int")
    expected = [("STRASSE", "X", 1), ("STRASSE", "\u4e2d", 1), ("\u0419", None, 1), ("\u0439", "", 1),
                ("a", "\x01b", 1), ("a", None, 1), ("a", "\x02", 1)]
    assert rows(distinct_rows(df, "UNICODE_CI_AI")) == sorted(expected, key=repr)
    # Sorted by one binary key of all the texts.
    assert "[n#" in (by := plan_of(distinct_rows(df, "UNICODE_CI_AI")).split("Sort ")[1])
    assert by.split("]")[0].count(" ASC") == 3 and "_key#" in by.split("]")[0]
    for first in (True, False):
        counted = rows(count_by(df, ["a", "b"], collation="UNICODE_CI_AI", spelt_first=first))
        assert sum(r[-1] for r in counted) == len(data) and len(counted) == len(expected)
    weighted = count_by(df, ["a"], weight="n", collation="UNICODE_CI_AI", spelt_first=False)
    assert sum(r[-1] for r in rows(weighted)) == len(data)


def test_packed_texts_come_back_as_they_were(spark):
    data = [(1, "a", None, ""), (2, None, None, None), (3, "x\x01y", "\x02", "z"),
            (4, "\x02", None, "\x01"), (5, "", "", ""), (6, "\u00d1and\u00fa", "\U0001d400", " ")]
    df = spark.createDataFrame(data, "n int, a string, b string, c string")
    packed = pack_texts(df, ["a", "b", "c"], "p")
    assert packed.columns == ["n", "p", "p_as_is"]
    assert rows(unpack_texts(packed, ["a", "b", "c"], "p")) == sorted(data, key=repr)
    missing = spark.createDataFrame([(7,)], "n int").join(packed, ["n"], "left")
    assert rows(unpack_texts(missing, ["a", "b", "c"], "p")) == [(7, None, None, None)]


def test_texts_folded_before_are_folded_no_more(spark):
    data = [("Stra\u00dfe", "\u4e2d", "x", 1), ("STRASSE", "\u4e2d", "X", 1), ("a\x01", "b", "x", 1),
            ("A", "\x01b", "x", 1), ("a", None, "x", 1), ("a", "\x02", "x", 1), ("a", "", "y", 1),
            ("\u0419", "", "y", 1), ("\u0439", "", "Y", 1)]
    df = spark.createDataFrame(data, "a string, b string, c string, n int")
    plain = distinct_rows(df, "UNICODE_CI_AI")
    keyed = distinct_rows(plain_key(df, ["a", "b"], "k"), "UNICODE_CI_AI", alike={"k": ["a", "b"]})
    assert keyed.columns == df.columns
    assert rows(keyed) == rows(plain) and len(rows(plain)) == 6
    binary = distinct_rows(plain_key(df, ["a", "b"], "k"), alike={"k": ["a", "b"]})
    assert rows(binary) == rows(df.distinct())


def test_classes_of_several_texts_agree_for_equal_spellings(spark):
    pairs = [("Caf\u00e9", "CAFE", "x"), ("\u0419", "\u0439", "x"), ("\u00df", "SS", None),
             ("a\x01", "A", ""), (None, None, "x")]
    df = spark.createDataFrame(pairs, "a string, b string, c string")
    assert df.where(plain_class(["a", "c"]) != plain_class(["b", "c"])).count() == 0
    assert df.select(plain_class(["a", "c"])).distinct().count() == 5
