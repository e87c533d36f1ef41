"""Product codes against plain Lloyd rounds."""

import hashlib
import math
import random
from collections import defaultdict

import pytest

from caseflow.llm import vector_codes
from caseflow.llm.tables import read
from tests.conftest import DATA
from tests.llm.test_exact import key

SCHEMA = "vec_id long, label string, embedding array<double>"


def plain_codes(rows, parts, entries, rounds, scale):
    kept = []
    for vec_id, label, vector in rows:
        if vector and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, label, [math.floor(x * scale) for x in vector]))
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts

    def cut(vector, p):
        return vector[p * width:(p + 1) * width]

    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]

    def near(book, part):
        return min((sum((a - b) ** 2 for a, b in zip(e, part)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, _, v in kept:
                members[near(books[p], cut(v, p))[1]].append(cut(v, p))
            for e, own in members.items():
                books[p][e] = [sum(column) // len(own) for column in zip(*own)]
    out, errors = [], defaultdict(int)
    for vec_id, label, v in kept:
        found = [near(books[p], cut(v, p)) for p in range(parts)]
        error = sum(d for d, _ in found)
        errors[label] += error
        out.append((vec_id, "".join(f"{i:02x}" for _, i in found), error, label))
    digest = hashlib.sha256(",".join(
        str(x) for book in books for e in book for x in e).encode()).hexdigest()

    def fits(x):
        return x if x < 1 << 63 else None

    return [(i, code, fits(error), fits(errors[label]), digest) for i, code, error, label in out]


def check(spark, rows, **options):
    options = {"parts": 4, "entries": 5, "rounds": 4, "scale": 4096, **options}
    df = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "1 AS code", "2 AS _values", "3 AS position", "4 AS entry")
    found = [tuple(r) for r in vector_codes.coded(df, **options).collect()]
    assert sorted(found, key=key) == sorted(plain_codes(rows, **options), key=key)
    return found


def vectors(seed, count, width=8, size=1.0):
    generator = random.Random(seed)
    centres = [[generator.gauss(0, size) for _ in range(width)] for _ in range(6)]
    return [(i, f"l{i % 3}" if i % 7 else None,
             [c + generator.gauss(0, size / 3) for c in generator.choice(centres)])
            for i in range(count)]


def test_codes_equal_plain_rounds(spark):
    check(spark, vectors(1, 300))


@pytest.mark.parametrize("rounds", [0, 1, 2, 9])
def test_any_number_of_rounds(spark, rounds):
    check(spark, vectors(2, 120), rounds=rounds)


def test_copies_fewer_rows_than_entries_and_ties(spark):
    rows = [(i, "a", [0.0] * 8) for i in range(200)] + vectors(3, 40)
    rows += [(1, "b", [1.0] * 8), (1, "b", [1.0] * 8), (None, None, [2.0] * 8)]
    check(spark, rows)
    check(spark, vectors(4, 3))
    check(spark, [(1, "a", [-1e-9, 1e-9, 0.5, -0.5])] * 3)


def test_vectors_that_take_no_part(spark):
    bad = [(-1, "a", None), (-2, "a", []), (-3, "a", [1.0] * 7 + [None]),
           (-4, "a", [float("nan")] * 8), (-5, "b", [float("inf")] * 8)]
    found = check(spark, bad + vectors(5, 50))
    assert len(found) == 50
    assert check(spark, bad) == []
    assert check(spark, []) == []
    odd = spark.createDataFrame([(0, "a", [1.0] * 8), (1, "a", [1.0] * 12), (2, "a", [1.0] * 9),
                                 (3, "a", [1e300] * 8)], SCHEMA)
    assert [r.vec_id for r in vector_codes.coded(odd, parts=4, entries=2).collect()] == [0]


def test_large_components_are_exact(spark):
    check(spark, vectors(6, 60, size=1e4))
    # Squares beyond what a double or a long holds; errors beyond a long are null.
    found = check(spark, vectors(7, 30, size=1e12))
    assert any(r[2] is None for r in found)


def test_parts_move_only_when_their_entry_changes(spark, monkeypatch):
    written = []
    real = vector_codes.handed_on

    def counted(df):
        out = real(df)
        if "members" in out.columns:
            written.append(out.where("part IS NOT NULL").count())
        return out

    monkeypatch.setattr(vector_codes, "handed_on", counted)
    check(spark, vectors(8, 400), rounds=6)
    assert len(written) == 5 and sum(written) < 400 * 4
    assert written[-1] < written[0]


def test_hot_entries_are_spread_over_salts(spark):
    whole = vector_codes.whole_vectors(spark.createDataFrame(
        [(i, "a", [0.5] * 8) for i in range(1000)], SCHEMA), 4, 4096)
    assert vector_codes._salts(whole.select("_values"), 4, 16) == 4
    placed = whole.select("_values").mapInArrow(
        vector_codes._placing(tuple(vector_codes.np.zeros((2, 2), dtype=int) for _ in range(4)), 4),
        vector_codes._MEMBERS)
    counts = {r.salt: r["count"] for r in placed.groupBy("salt").count().collect()}
    assert set(counts) == {0, 1, 2, 3} and max(counts.values()) < 1.2 * min(counts.values())


def test_refused_settings(spark):
    rows = spark.createDataFrame([], SCHEMA)
    for options in ({"parts": 0}, {"entries": 257}, {"entries": 0}, {"rounds": -1}):
        with pytest.raises(ValueError):
            vector_codes.coded(rows, **options)


def test_whole_table_equals_plain_rounds(spark):
    rows = [(r.vec_id, r.label, r.embedding) for r in read(spark, DATA, "embeddings").collect()]
    found = vector_codes.coded(read(spark, DATA, "embeddings")).collect()
    assert sorted(map(tuple, found)) == sorted(plain_codes(rows[:], 8, 16, 6, 4096))
