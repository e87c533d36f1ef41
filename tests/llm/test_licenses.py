"""License scans against a plain search for words."""

import random
import re

import pytest
from pyspark.sql import functions as F

from caseflow.llm import license_scan, queries
from caseflow.llm.license_scan import LOOSE_K, NOTICES, PHRASES, TEMPLATES, Template, licenses
from caseflow.llm.tables import read
from tests.conftest import DATA
from tests.llm.test_exact import docs_of, key

NOTICE = NOTICES[0].text


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def whole_places(text, phrase):
    have, want = words(text), words(phrase)
    return [i for i in range(len(have)) if have[i:i + len(want)] == want]


def plain_row(doc_id, text):
    places = {t.label: whole_places(text, t.text) for t in PHRASES}
    starts = sorted(i for found in places.values() for i in found)
    labels = ",".join(sorted(label for label, found in places.items() if found))
    return (doc_id, len(words(text)), len(starts), starts[0] if starts else None,
            starts[-1] if starts else None, labels)


def scanned(spark, rows, **options):
    return {r.doc_id: r for r in licenses(docs_of(spark, rows), **options).collect()}


AWKWARD = [
    (1, "Released under the MIT License."), (2, "the mit licenses"), (3, None), (4, ""),
    (5, "mit"), (6, "MIT\nlicense mit-LICENSE, mit license"), (7, "CC BY-NC 4.0"),
    (8, "gnu general public"), (9, "GNU GENERAL public license GNU general public LICENSE"),
    (10, "x " * 511 + "mit license"), (11, "x " * 510 + "mit license"),
    (12, "x " * 1022 + "gnu general public license " + "y " * 2000 + "cc by"),
    (None, "cc by"), (None, "cc by"), (13, "ünï cc by cc by cc by"), (14, "cc cc by by"),
    (15, "mit license " * 700), (16, "... !!"),
]


def test_places_of_phrases_equal_a_plain_search(spark):
    found = licenses(docs_of(spark, AWKWARD), PHRASES).collect()
    ours = []
    for r in found:
        starts = [s.first for s in r.spans]
        assert all(s.share == 1.0 and s.words == len(TEMPLATES[s.template].words())
                   for s in r.spans)
        ours.append((r.doc_id, r.n_words, len(starts), min(starts, default=None),
                     max(starts, default=None), ",".join(sorted({s.label for s in r.spans}))))
    assert sorted(ours, key=key) == sorted((plain_row(*row) for row in AWKWARD), key=key)


def test_query_equals_a_plain_search_over_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, DATA, "documents").collect()]
    found = queries.QUERIES["op11_license_scans"](spark, DATA).collect()
    ours = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
            for r in found]
    assert sorted(ours, key=key) == sorted((plain_row(*row) for row in rows), key=key)
    assert any(r.n_base for r in found)
    for r in found:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert (r.score > 0) == bool(r.labels) and 0 <= r.score <= 1


def test_edited_notices_are_found_on_merged_diagonals(spark):
    generator = random.Random(5)
    rows, clean = [], []
    for i in range(8):
        text = words(NOTICE)
        for _ in range(i):
            at = generator.randrange(len(text))
            if generator.random() < 0.5:
                text.insert(at, f"new{at}")
            else:
                del text[at]
        before = [f"w{generator.randrange(9999)}" for _ in range(i * 50)]
        rows.append((i, " ".join(before + text + before)))
        clean.append((100 + i, " ".join(generator.sample(words(NOTICE), 80))))
    found = scanned(spark, rows + clean)
    for i in range(8):
        (span,) = [s for s in found[i].spans if s.label == "mit"]
        grams = len(words(NOTICE)) - LOOSE_K + 1
        assert span.share >= 1 - i * LOOSE_K / grams - 1e-9
        assert abs(span.first - 50 * i) <= 5 and abs(span.words - len(words(NOTICE))) <= 12
        assert not found[100 + i].spans
    assert found[0].spans[0].share == 1.0


def test_two_copies_of_a_notice_are_two_spans(spark):
    found = scanned(spark, [(1, f"{NOTICE} between {NOTICE}"), (2, NOTICE[:300])])
    assert [s.first for s in found[1].spans] == [0, len(words(NOTICE)) + 1]
    assert not found[2].spans


def test_grams_that_only_hash_alike_are_no_hits(spark, monkeypatch):
    """Templates whose hashes are those of other words are met by hash, but not by words."""
    docs = docs_of(spark, [(1, "the mit license and cc by"), (2, "no such words")])
    real = license_scan._positions

    def other_words(docs, templates):
        return real(docs, templates).withColumn(
            "template_words", F.array(F.lit("other"), F.lit("words")))

    monkeypatch.setattr(license_scan, "_positions", other_words)
    assert [(r.doc_id, r.n_words, r.spans) for r in licenses(docs, PHRASES).orderBy("doc_id")
            .collect()] == [(1, 6, []), (2, 3, [])]


def test_empty_tables_and_refused_templates(spark):
    empty = licenses(docs_of(spark, []))
    assert empty.columns == ["doc_id", "n_words", "spans"] and not empty.collect()
    for templates in ((), (Template("x", "one"),), (Template("x", "a b c d", whole=False),)):
        with pytest.raises(ValueError):
            licenses(docs_of(spark, []), templates)


def test_clashing_columns_and_text_ids(spark):
    rows = spark.createDataFrame([("a", "mit license", 1, 2, 3, 4)],
                                 "name string, body string, row int, id int, template int, at int")
    (found,) = licenses(rows, id="name", text="body").collect()
    assert found.name == "a" and [s.label for s in found.spans] == ["mit"]
