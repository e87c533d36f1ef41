"""Packed counts, keys and answers of the language model."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseflow.llm import suffix_tree
from caseflow.llm.words import BLANKS, pieces


def texts(n):
    generator = random.Random(n)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [" ".join(generator.choices(words, weights, k=generator.randint(0, 50))) + f" o{i}"
            for i in range(n)] + ["", "w0"]


def filter_of(keys):
    slots = np.zeros(suffix_tree.FILTER_SLOTS, dtype=bool)
    slots[(keys & np.uint64(suffix_tree.FILTER_SLOTS - 1)).astype(np.int64)] = True
    return np.packbits(slots, bitorder="little").view(np.uint64)


def test_a_block_asks_in_one_row_a_part_and_for_entries_of_kept_contexts_only():
    column = pa.array(texts(40))
    words, contexts, entries = set(), set(), set()
    for piece in pieces(column, BLANKS):
        sequence, first = suffix_tree._sequences(piece)
        words |= set(sequence.tolist()) - {int(suffix_tree.START)}
        codes, runs, known = suffix_tree._levels(sequence, first, 1)
        contexts |= set(codes[0][known[0]].tolist())
        entries |= set(zip(codes[0][known[0]].tolist(), runs[0][known[0]].tolist()))
    kept = sorted(contexts)[::3]
    keys = np.array(kept, dtype=np.uint64) ^ suffix_tree._CONTEXT
    table = pa.table({"_block": np.full(len(column), 7), "_text": column})
    every = np.full(suffix_tree.FILTER_SLOTS >> 6, ~np.uint64(0))
    asked = suffix_tree._asked(table, filter_of(keys), every, 1, 3)
    assert asked.num_rows == 8 and set(asked.column("_block").to_pylist()) == {7}
    found = suffix_tree._unpacked(asked.column("_rows"), 1)[0].tolist()
    expected = words | set(keys.tolist()) | {run for code, run in entries if code in kept}
    assert len(found) == len(set(found))
    assert set(found) - {int(suffix_tree.START)} == expected


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_answers_are_those_of_a_dictionary(n):
    generator = np.random.default_rng(n)
    keys = generator.integers(0, 1 << 64, n, dtype=np.uint64)
    keys[: n // 4] &= np.uint64(0xFFF)  # many with the same first bits
    values = {}
    for key, value in zip(keys.tolist(), range(n)):
        values.setdefault(key, float(value))
    answers = suffix_tree.Answers(keys, np.arange(n, dtype=float))
    wanted = np.r_[keys, generator.integers(0, 5000, 3000, dtype=np.uint64)]
    expected = [values.get(k, np.nan) for k in wanted.tolist()]
    np.testing.assert_array_equal(answers.find(wanted), expected)
    order = suffix_tree._order(keys)
    np.testing.assert_array_equal(order, np.argsort(keys, kind="stable"))


def test_scores_are_the_same_in_any_number_of_parts_and_blocks(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts(200))), "doc_id long, text string")
    docs = docs.union(docs.limit(5)).repartition(3, "doc_id")
    train = F.col("doc_id") % 5 != 1
    one = sorted(map(tuple, suffix_tree.score(docs, train).collect()))
    for name, value in (("PART_BYTES", 2000), ("BLOCK_BYTES", 3000), ("COUNTED", 500),
                        ("PACKED_ROWS", 100), ("PIECE_BYTES", 900)):
        monkeypatch.setattr(suffix_tree, name, value)
    many = sorted(map(tuple, suffix_tree.score(docs, train).collect()))
    assert len(one) == len(many) == 207
    for a, b in zip(one, many):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-12)


def test_a_bit_set_has_all_keys(spark):
    keys = spark.range(-500, 500).select((F.xxhash64("id")).alias("key")).repartition(3)
    bits = suffix_tree._filter(keys).value
    here = np.array([r.key for r in keys.collect()]).view(np.uint64)
    np.testing.assert_array_equal(bits, filter_of(here))
    assert not suffix_tree._filter(keys.limit(0)).value.any()
