"""The stored positional index: what it keeps, and what is found against brute force."""

import random

from caseflow.llm import decontaminate
from tests.llm import reference as plain

ITEMS = "item_id long, text string"


def _documents(seed):
    generator = random.Random(seed)
    words = ["a", "b", "c", "é", "d7", "E"]
    rows = [(i, " ".join(generator.choices(words, k=generator.randrange(0, 60))))
            for i in range(40)]
    return rows + [(40, None), (41, ""), (42, "--"), (3, rows[3][1])]


def _spans(rows, items, window):
    """(document, item, start) of every window of every item, by looking everywhere."""
    found = set()
    for at, (_, text) in enumerate(rows):
        own = plain.words(text, plain.ALNUM_WORDS) if text else []
        for item, wanted in items:
            sought = plain.words(wanted, plain.ALNUM_WORDS)
            for i in range(max(1, len(sought) - window + 1) if sought else 0):
                part = sought[i : i + window]
                found |= {(at, item, j) for j in range(len(own) - len(part) + 1)
                          if own[j : j + len(part)] == part}
    return found


def test_segments_of_any_size_give_what_looking_everywhere_gives(spark):
    rows = _documents(5)
    items = [(1, "a b c a"), (2, "É d7"), (3, "e"), (4, " ".join(["a", "c"] * 30)), (5, "zz a b")]
    docs = spark.createDataFrame([(n, *row) for n, row in enumerate(rows)],
                                 "n long, doc_id long, text string")
    asked = spark.createDataFrame(items, ITEMS)
    expected = _spans(rows, items, 3)
    for size in (1, 200, 1 << 20):
        corpus = decontaminate.index(docs, keep=["n"], segment_bytes=size)
        found = decontaminate.find(corpus, asked, window=3, block_words=12).collect()
        assert sorted(r.n for r in found) == list(range(len(rows)))
        places = {(r.n, int(m["item"]), j) for r in found for m in r.matches
                  for j in range(m["start"], m["end"])}
        lengths = {item: min(3, len(plain.words(text, plain.ALNUM_WORDS)))
                   for item, text in items}
        assert places == {(n, item, j + k) for n, item, j in expected
                          for k in range(lengths[item])}


def test_one_index_serves_several_query_sets_and_is_deleted(spark):
    docs = spark.createDataFrame([(1, "one two three", "x"), (2, "three two", "y")],
                                 "doc_id long, text string, n_words string")
    corpus = decontaminate.index(docs)
    for text, hit in (("two three", {1}), ("two", {1, 2}), ("four", set())):
        found = decontaminate.find(corpus, spark.createDataFrame([(9, text)], ITEMS))
        assert {r.doc_id for r in found.where("size(matches) > 0").collect()} == hit
        assert found.columns == ["doc_id", "text", "n_words", "matches"]
        assert {r.n_words for r in found.collect()} == {2, 3}
    corpus.remove()


def test_columns_with_working_names_are_kept(spark):
    docs = spark.createDataFrame([(1, "one two", 5, None)],
                                 "doc_id long, text string, _term long, _segment string")
    items = spark.createDataFrame([(9, "two")], ITEMS)
    row = decontaminate.matches(docs, items, keep=["doc_id", "_term"]).first()
    assert (row["_term"], row["n_words"], row["matches"][0]["start"]) == (5, 2, 1)
    assert decontaminate.matches(docs, items).first()["_segment"] is None
