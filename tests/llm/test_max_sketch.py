"""Ranked search against a plain scoring of all documents."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caseflow.llm import max_sketch
from tests.llm.test_exact import DOCS, docs_of, key
from tests.llm.test_licenses import words


def plain_search(docs, items, k):
    bags = [(doc_id, Counter(words(text))) for doc_id, text in docs]
    bags = [(doc_id, bag) for doc_id, bag in bags if bag]
    n, total = len(bags), sum(sum(bag.values()) for _, bag in bags)
    df = Counter(term for _, bag in bags for term in bag)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item_id, terms in {(i, tuple(sorted(set(words(t))))) for i, t in items}:
        scored = []
        for doc_id, bag in bags:
            m = 50 + 50 * sum(bag.values()) * n // total
            score = sum(weight[t] * (10 ** 9 * bag[t] // (1000 * bag[t] + 20 * m))
                        for t in terms if t in bag)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, null, doc_id) in enumerate(sorted(scored)[:k], 1):
            out.append((item_id, rank, None if null else doc_id, -score))
    return out


def searched(spark, docs, items, k):
    index = max_sketch.build(docs_of(spark, docs))
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr(
        "*", "1 AS query", "2 AS doc_id", "3 AS rank", "4 AS terms")
    return max_sketch.search(index, asked, k)


def corpus(seed, size):
    """Short texts over a skewed vocabulary, with repeated texts and rows."""
    generator = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shares = [1 / (i + 1) for i in range(400)]
    docs = []
    for i in range(size):
        text = " ".join(generator.choices(vocabulary, shares, k=generator.randrange(1, 80)))
        docs += [(i, text)] * (1 + (i % 17 == 0))
    docs += [(size + i, docs[3][1]) for i in range(size // 3)]
    items = [(i, " ".join(generator.choices(vocabulary, k=generator.randrange(1, 20))))
             for i in range(12)]
    generator.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("k", [1, 7, 50])
def test_ranks_equal_a_plain_scoring(spark, k):
    docs, items = corpus(k, 300)
    found = searched(spark, docs, items, k).collect()
    assert sorted(map(tuple, found), key=key) == sorted(plain_search(docs, items, k), key=key)


def test_awkward_documents_and_items(spark):
    docs = DOCS + [(40, "W één"), (-3, "x"), (None, "x"), (41, "ÉÉN x " * 9)]
    items = [(1, "Wort7 X"), (1, "Wort7 X"), (1, "x wort7"), (1, "one"), (None, "één x"), (2, None),
             (3, ""), (4, "!!"), (5, "nowhere"), (6, " ".join(f"x{i}" for i in range(3000)) + " x")]
    found = searched(spark, docs, items, 4).collect()
    assert sorted(map(tuple, found), key=key) == sorted(plain_search(docs, items, 4), key=key)


def test_small_batches_and_rare_stops_change_nothing(spark, monkeypatch):
    docs, items = corpus(9, 200)
    index = max_sketch.build(docs_of(spark, docs))
    asked = spark.createDataFrame(items, "item_id long, text string")
    whole = max_sketch.search(index, asked, 5).collect()
    monkeypatch.setattr(max_sketch, "BATCH_TERMS", 40)
    assert sorted(map(tuple, max_sketch.search(index, asked, 5).collect())) == sorted(
        map(tuple, whole))


def test_bounds_are_never_below_the_scores_and_most_documents_are_passed_over(spark):
    docs, items = corpus(4, 400)
    index = max_sketch.build(docs_of(spark, docs))
    rows = index.table.toArrow().combine_chunks().to_batches()[0]
    batch = max_sketch._Documents(rows, index.documents, index.terms)
    import numpy as np
    import pyarrow as pa
    hashes = [next(max_sketch._query_terms(iter([pa.RecordBatch.from_arrays(
        [pa.array([i]), pa.array([t])], ["item_id", "text"])]))).column("terms")[0].as_py()
        for i, t in items]
    lists = sorted({tuple(h) for h in hashes})
    vocabulary = np.unique(np.array([h for x in lists for h in x], dtype=np.int64).view(np.uint64))
    asked = max_sketch._Batch(lists, vocabulary, max_sketch._weights(index, vocabulary))
    bounds = batch.bounds(asked, 0, len(batch))
    for q in range(len(asked.numbers)):
        own = slice(asked.starts[q], asked.starts[q + 1])
        exact = batch.scores(np.arange(len(batch)), asked.terms[asked.of[own]], asked.weight[own])
        assert (bounds[q] >= exact).all()
        assert ((bounds[q] >= np.sort(exact)[-5]).mean()) < 0.5


def test_empty_tables(spark):
    docs, items = corpus(2, 5)
    assert not searched(spark, [], items, 5).collect()
    assert not searched(spark, [(1, None), (2, "")], items, 5).collect()
    none = searched(spark, docs, [], 5)
    assert none.columns == ["item_id", "rank", "doc_id", "score"] and not none.collect()


def test_lengths_beyond_64_bits_are_exact():
    import numpy as np
    n = np.array([1, 10 ** 7], dtype=np.int64)
    documents, terms = 5 * 10 ** 11, 10 ** 15
    assert max_sketch._lengths(n, documents, terms).tolist() == [
        50 + 50 * int(x) * documents // terms for x in n]


def test_a_shared_text_does_not_make_a_task_of_its_own(spark):
    docs = docs_of(spark, [(i, "same text of many rows") for i in range(2000)])
    index = max_sketch.build(docs.repartition(8, F.col("doc_id")))
    asked = spark.createDataFrame([(1, "many text")], "item_id long, text string")
    # Every document holds the terms, so that their weight is floor(1000 ln(4002/4001)) = 0.
    assert not max_sketch.search(index, asked, 3).collect()
