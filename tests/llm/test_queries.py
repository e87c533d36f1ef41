"""Registered queries against their SQL, learnt scores on held-out rows, the pipeline."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from caseflow.llm import oracle, quality, queries, toxicity
from caseflow.llm.quality import isotonic
from caseflow.llm.tables import read
from checks import compare
from tests.conftest import DATA
from tests.llm import reference as plain

LARGER = DATA.replace("0.001", "0.01")


@pytest.mark.parametrize("name", list(oracle.ORACLE))
def test_query_equals_sql(spark, monkeypatch, name):
    monkeypatch.setitem(compare.QUERIES, name, queries.QUERIES[name])
    monkeypatch.setitem(compare.ORACLE, name, oracle.ORACLE[name])
    with compare.connect(DATA) as connection:
        count, problem = compare.compare(spark, connection, DATA, name)
    assert not problem and count > 0


def test_every_operator_has_one_query():
    numbers = [int(name[2:].split("_")[0]) for name in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14))


def documents(spark, folder=DATA):
    return [(r.doc_id, r.text) for r in read(spark, folder, "documents").collect()]


def test_near_duplicate_query(spark):
    found = queries.QUERIES["op4_simhash_near_dedup"](spark, DATA).collect()
    assert sorted(map(tuple, found)) == sorted(plain.near_duplicates(documents(spark)))


def test_line_query(spark):
    found = queries.QUERIES["op8_line_dedup"](spark, DATA).collect()
    assert sorted(map(tuple, found)) == sorted(plain.remove_repeated(documents(spark)))


def test_language_model_query(spark):
    found = queries.QUERIES["op9_language_model"](spark, LARGER).collect()
    rows = documents(spark, LARGER)
    expected = plain.unigram(rows, lambda i: plain.fold(i, 5) != 1)
    for r in found:
        assert r.held_out == (plain.fold(r.doc_id, 5) == 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == expected[r.doc_id][:3]
        assert r.base_score == pytest.approx(expected[r.doc_id][3], rel=1e-9)
    held_out = [r for r in found if r.held_out]
    assert sum(r.score for r in held_out) > sum(r.base_score for r in held_out)


@pytest.mark.parametrize("name, label, remainder, folds, least", [
    ("op3_toxicity", "toxic", 0, 5, 0.9), ("op10_quality_classifier", "quality", 1, 3, 0.97)])
def test_scores_on_held_out_documents(spark, name, label, remainder, folds, least):
    found = queries.QUERIES[name](spark, LARGER).collect()
    labels = {r.doc_id: r[label] for r in read(spark, LARGER, "labels").collect()}
    assert len(found) == read(spark, LARGER, "documents").count()
    right = []
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (plain.fold(r.doc_id, folds) == remainder)
        if r.held_out and r.doc_id in labels:
            right.append(r.predicted == labels[r.doc_id])
    assert np.mean(right) >= least


AWKWARD = [(1, ""), (2, None), (2, None), (None, "fine words here"), (4, "fine " * 40_000),
           (5, "idiot scum")]


def test_scores_of_awkward_rows(spark):
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string").selectExpr(
        "*", "9 AS Score", "'q' AS _text", "1 AS _statistics", "2 AS _label")
    labels = spark.createDataFrame([(1, 0, 1), (5, 1, 0), (5, None, None), (None, 1, 1), (8, 1, 1)],
                                   "doc_id long, toxic int, quality int")
    weights, bias = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, weights, bias).collect()
    assert len(scored) == len(AWKWARD) and all(0 <= r.score <= 1 for r in scored)
    rated = quality.quality_scores(docs, labels).collect()
    assert len(rated) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rated)
    for none in (docs.limit(0), docs):
        weights, bias = toxicity.fit(none, labels.limit(0))
        assert not weights.any()
        assert toxicity.score(none, weights, bias, name="p").count() == none.count()
        rated = quality.quality_scores(none, labels.limit(0)).collect()
        assert {r.score for r in rated} <= {0.5}


def test_isotonic_pools_neighbours_out_of_order():
    assert isotonic(np.array([1.0, 1, 2, 1]), np.array([0.0, 1, 1, 1])).tolist() == [
        0, 2 / 3, 2 / 3, 1]


def test_pipeline_stage_by_stage(spark):
    docs = read(spark, DATA, "documents")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in read(spark, DATA, "benchmark").collect()]
    stages = dict(corpus_pipeline.STAGES)
    scores = {r.doc_id: r.predicted for r in queries.op3_toxicity(spark, DATA).collect()}
    kept = docs
    for name in list(stages)[:-1]:
        before = [(r.doc_id, r.text) for r in kept.collect()]
        kept = corpus_pipeline.saved(stages[name](spark, kept, DATA))
        after = [(r.doc_id, r.text) for r in kept.collect()]
        assert kept.columns == columns
        if name == "toxicity":
            expected = [row for row in before if not scores[row[0]]]
        elif name == "line_dedup":
            expected = [row[:2] for row in plain.remove_repeated(before)]
        elif name == "simhash_near_dedup":
            ids = {c for _, _, c in plain.near_duplicates(before)}
            expected = [row for row in before if row[0] in ids]
        else:
            dirty = {id for id, *_, bad in plain.contamination(before, items) if bad}
            expected = [row for row in before if row[0] not in dirty]
        assert sorted(after) == sorted(expected), name
    last = stages["source_mixing"](spark, kept, DATA)
    tokens = {r.doc_id: len(plain.words(r.text)) for r in kept.collect()}
    rows = last.collect()
    assert {*columns, "domain", "n_tokens", "copies"} == set(last.columns)
    assert all(tokens[r.doc_id] == r.n_tokens for r in rows)
    with duckdb.connect() as connection:
        connection.register("documents", kept.toPandas())
        expected = connection.sql(oracle.OP6).fetchall()
    names = ("doc_id", "domain", "lang", "source", "n_tokens", "copies")
    assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(expected)
    whole = corpus_pipeline.run(spark, DATA)
    assert sorted((r.doc_id, r.copies) for r in whole.collect()) == sorted(
        (r.doc_id, r.copies) for r in rows)


def test_stages_with_awkward_rows_and_columns(spark):
    rows = [(1, "", "en", "s1", 0), (2, None, None, None, None), (2, None, None, None, None),
            (None, "fine words here " * 5, "en", "src1", 80), (4, "long " * 30_000, "de", "src2", 1),
            (5, "a\nb\nc\nd\ne\nf", "fr", "src3", 11), (6, "a\nb\nc\nd\ne\nf", "fr", "src3", 11)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "*", "1 AS n_words", "2 AS matches", "3 AS items", "4 AS _score", "5 AS n_lines",
        "6 AS _removed", "7 AS contaminated", "8 AS copies", "9 AS component_id")
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, DATA)
        own = [c for c in docs.columns if name != "source_mixing" or c != "copies"]
        extra = own[len(corpus_pipeline.DOCUMENTS):]
        values = kept.select(*extra).distinct().collect()
        expected = tuple(i + 1 for i, c in enumerate(docs.columns[5:]) if c in extra)
        assert [tuple(v) for v in values] == [expected], name
        if name not in ("simhash_near_dedup", "source_mixing"):
            assert kept.columns == docs.columns and kept.count() == len(rows)
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
