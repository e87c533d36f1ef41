"""Operators against plain versions, on small inputs with awkward rows."""

import math
import random

import numpy as np
import pytest

from caseflow.llm import (
    chat, components, decontaminate, line_chunks, mixing, simhash, suffix_tree, topk, url_rules)
from caseflow.llm.tables import fold
from caseflow.llm.words import BLANKS, pieces
from tests.llm import reference as plain

# Near copies, an exact copy, texts without words, non-ASCII words, repeated rows, null ids.
BASE = " ".join(f"Wort{i * 7 % 31}" for i in range(120))
DOCS = [(5, BASE), (3, BASE.replace("Wort7 ", "other ", 1)), (9, BASE), (None, BASE),
        (11, ""), (12, None), (13, "\t \n"), (None, ""), (20, "één twee drie"), (20, "één twee drie"),
        (21, "ÉÉN Twee\tdrie"), (30, "x " * 30_000), (31, "one word more " * 9)]
DOC_SCHEMA = "doc_id long, text string"


def docs_of(spark, rows, extra=True):
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    return df.selectExpr(
        "*", "1 AS Score", "'x' AS n_Words", "2 AS _id", "3 AS _text", "4 AS _row", "5 AS _key",
        "6 AS _print", "7 AS epochs", "8 AS _order") if extra else df


def key(row):
    return tuple((v is None, str(v)) for v in row)


def same(df, expected):
    assert sorted(map(tuple, df.collect()), key=key) == sorted(expected, key=key)


def test_words_are_found_and_hashed_alike_wherever_they_stand():
    import pyarrow as pa
    texts = ["The cat", None, "", " THE  cat sat ", "ünï the", "a" * 5000 + " the"]
    seen = {}
    for limit in (4, 1 << 20):
        for piece in pieces(pa.array(texts), BLANKS, limit):
            for text in range(piece.texts):
                own = piece.text == text
                found = [piece.bytes[a:b].tobytes().decode()
                         for a, b in zip(piece.starts[own], piece.ends[own])]
                assert found == plain.words(texts[piece.first + text])
                for word, hashed in zip(found, piece.hashes()[own].tolist()):
                    assert seen.setdefault(word, hashed) == hashed
    assert len(set(seen.values())) == len(seen)


def test_components_of_chains_stars_and_loops(spark):
    generator = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)]
    links += [(200, 201), (201, 202), (202, 200), (300, 300)]
    generator.shuffle(links)
    found = components.connected_components(spark.createDataFrame(links, "a long, b long"))
    expected = [(i, 0) for i in range(41)] + [(i, 100) for i in range(100, 140)]
    same(found, expected + [(i, 200) for i in range(200, 203)])
    assert components.connected_components(
        spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    found = simhash.near_duplicates(docs_of(spark, DOCS))
    same(found, plain.near_duplicates(DOCS))
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_bit_slices_find_every_pair_and_large_buckets_are_cut(spark):
    generator = random.Random(5)
    centres = [generator.getrandbits(64) for _ in range(40)]
    values = set(centres)
    for centre in centres * 8:
        flipped = centre
        for bit in generator.sample(range(64), generator.randint(1, 6)):
            flipped ^= 1 << bit
        values.add(flipped)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    pairs = [(i, j) for i in range(len(values)) for j in range(i)
             if ((values[i] ^ values[j]) % (1 << 64)).bit_count() <= 4]
    expected = plain.components(len(values), pairs)
    prints = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    for block in (2048, 3):
        links = simhash.near_links(prints, block=block)
        roots = dict(map(tuple, components.connected_components(links).collect()))
        assert [roots.get(v, v) for v in values] == [values[r] for r in expected]


def test_one_document_of_each_group_stays(spark):
    kept = simhash.drop_near_duplicates(docs_of(spark, DOCS))
    assert kept.columns == docs_of(spark, DOCS).columns
    assert kept.select("_id", "_text", "_row").distinct().collect() == [(2, 3, 4)]
    kept = kept.select("doc_id", "text")
    by_id = dict(DOCS)
    ids = {c for _, _, c in plain.near_duplicates(DOCS)}
    same(kept, [(i, by_id[i]) for i in ids])
    nameless = [(None, "only here " * 9), (None, "only here " * 9), (None, BASE)]
    assert simhash.drop_near_duplicates(docs_of(spark, nameless)).count() == 2


ITEMS = [(1, "one word more one word more one word more one word more one two"),
         (2, "ÉÉN twee"), (3, None), (4, "..."), (None, "wort7 wort14"), (2, "drie"), (10, "x")]


@pytest.mark.parametrize("block", [1 << 19, 1])
def test_contamination(spark, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.with_contamination(
        decontaminate.matches(docs_of(spark, DOCS), items, block_words=block))
    same(found.select("doc_id", "n_words", "n_hit", "items", "contaminated"),
         plain.contamination(DOCS, ITEMS))
    assert decontaminate.matches(docs_of(spark, []), items).count() == 0
    none = decontaminate.with_contamination(
        decontaminate.matches(docs_of(spark, DOCS), items.limit(0)))
    assert {(r.n_hit, r.contaminated) for r in none.collect()} == {(0, False)}


def test_words_near_each_other_in_any_order(spark):
    rows = [(1, "alpha filler beta gamma"), (2, "gamma beta filler filler alpha"),
            (3, "alpha beta " + "filler " * 9 + "gamma"), (4, "alpha beta")]
    items = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    docs = docs_of(spark, rows)
    found = decontaminate.matches(docs, items, within=4).where("size(matches) > 0")
    spans = {r.doc_id: [tuple(m) for m in r.matches] for r in found.collect()}
    assert spans == {1: [("7", 0, 4)], 2: [("7", 0, 5)]}
    assert decontaminate.matches(docs, items).where("size(matches) > 0").count() == 0


def test_repeated_line_chunks_go_but_for_the_first(spark):
    generator = random.Random(1)
    passage = "\n".join(f"shared line {i} " + "z" * i for i in range(12))
    long_line = " ".join(f"w{i}" for i in range(60))

    def own(n):
        return "\n".join(f"own {generator.random()}" for _ in range(n))

    rows = [(i, "\n".join([own(5), passage, own(3), long_line, own(2)])) for i in range(6)]
    rows += [(20, passage + "\n" + passage), (21, ""), (22, None), (23, "\n\n\n"),
             (24, long_line), (None, long_line), (25, "a\n" * 3000)]
    found = line_chunks.remove_repeated(docs_of(spark, rows)).select(
        "doc_id", "text", "n_lines", "n_removed")
    expected = plain.remove_repeated(rows)
    same(found, expected)
    assert sum(r[3] for r in expected[1:6]) >= 5 * 9
    assert line_chunks.remove_repeated(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("count, words", [(2, 40), (3, 20), (5, 12), (10, 10), (4, 3), (2, 1)])
def test_nearly_all_lines_of_repeated_passages_go(spark, count, words):
    """Against runs of lines that an earlier text has, found without any cuts."""
    generator = random.Random(count)

    def line(n):
        return " ".join(f"w{generator.randrange(10 ** 6)}" for _ in range(n))

    rows = []
    for i in range(60):
        passage = [line(words) for _ in range(count)]
        for copy in range(2 + i % 2):
            around = [[line(6) for _ in range(generator.randrange(6))] for _ in range(2)]
            rows.append((10 * i + copy, "\n".join([*around[0], *passage, *around[1]])))
    found = line_chunks.remove_repeated(docs_of(spark, rows)).collect()
    expected = plain.repeated_lines(rows)
    wanted = sum(map(len, expected.values()))
    assert wanted == sum(count * (1 + i % 2) for i in range(60))
    for r in found:
        assert r.n_removed <= len(expected[r.doc_id])
    assert sum(r.n_removed for r in found) >= 0.9 * wanted


def test_rows_that_repeat_keep_the_same_lines(spark):
    rows = [(1, "p\nq\nr\ns\nt")] * 3 + [(2, "p\nq\nr\ns\nt")]
    found = line_chunks.remove_repeated(docs_of(spark, rows)).collect()
    assert len({(r.text, r.n_removed) for r in found if r.doc_id == 1}) == 1
    assert all(r.n_removed == 0 for r in found if r.doc_id == 1)


def test_top_k_with_ties_holes_and_repeats(spark):
    generator = np.random.default_rng(4)
    rows = [(i, generator.normal(size=8).round(2).tolist()) for i in range(150)]
    rows += [(i + 200, rows[i][1]) for i in range(20)] + [rows[7], (None, rows[1][1])]
    rows += [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8),
             (403, [float("inf")] * 8), (404, []), (405, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.selectExpr("*", "0 AS score", "0 AS query_id")
    whole = [(i, np.floor(256 * np.array(v, dtype=float))) for i, v in rows
             if i is not None and (i < 400 or i >= 404)]
    for l2 in (False, True):
        expected = []
        for q, v in [w for w in whole if w[0] % 25 == 0] + [whole[-1]][:0]:
            scores = sorted((-int(-((v - x) ** 2).sum() if l2 else v @ x), i)
                            for i, x in whole if i != q and len(x) == len(v))
            expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])]
        found = topk.top_k(df.where("vec_id % 25 = 0"), df, 5, l2=l2, tile_rows=50)
        same(found, expected)
    assert topk.top_k(df.limit(0), df, 5).count() == 0
    assert topk.top_k(df, df.limit(0), 5).count() == 0


@pytest.mark.parametrize("size", [1.0, 5e3, 1e12, 1e200])
def test_top_k_of_any_components_is_exact(spark, size):
    generator = np.random.default_rng(6)
    rows = [(i, (generator.normal(size=6) * (size if i % 3 else 1.0)).tolist())
            for i in range(90)]
    rows += [(0, rows[1][1]), (0, rows[0][1]), (7, rows[5][1]), (200, []), (250, []), (201, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    most = (1 << 63) - 1
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    for l2 in (False, True):
        expected = []
        for q, v in {(i, tuple(v)) for i, v in whole if i % 50 == 0}:
            scores = []
            for i, x in whole:
                if i != q and len(x) == len(v):
                    score = (-sum((a - b) ** 2 for a, b in zip(v, x)) if l2
                             else sum(a * b for a, b in zip(v, x)))
                    scores.append((-max(-most + 1, min(most, score)), i))
            expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:5])]
        asked = df.where("vec_id % 50 = 0")
        found = topk.top_k(asked, df, 5, l2=l2, tile_rows=20)
        same(found, expected)
        same(topk.top_k(asked.repartition(3), df.repartition(7), 5, l2=l2, tile_rows=2), expected)


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("", "/bad", "block"),
         ("a.example.net", "/", "block"), ("a.example.net", "/en/x", "allow"),
         ("org", "/fr/", "allow"), ("org", "/fr/", "block"), ("Example.COM", "/De/", "block")]
URLS = ["http://example.net/en/1", "HTTP://A.EXAMPLE.NET/en/1", "http://b.a.example.net/en/xy",
        "http://notexample.net/en/", "http://net/", "http://net", "http://x.org/fr/?q", "x://org#/fr/",
        "http://example.com/De/", "http://example.com/de/", "http://aexample.com/De/", None, "",
        "no scheme", "://", "http:///bad", "http://q/bad/1", "http://éx.org/fr/é", "http://a..net/"]


@pytest.mark.parametrize("block", [200_000, 2])
def test_url_rules(spark, block):
    rules = spark.createDataFrame(RULES + [(None, "/", "block")],
                                  "host string, path string, verdict string")
    rows = list(enumerate(URLS * 3))
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "7 AS Rule", "8 AS _key")

    def judged(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, path = plain.lower(rest[:end]), rest[end:].split("?")[0].split("#")[0]
        lowered = [(plain.lower(h), p, v) for h, p, v in RULES]
        return (host, path, *plain.verdict(host, path, lowered))

    same(url_rules.judge(pages, rules, block_rules=block).select(
        "page_id", "host", "path", "rule", "verdict"), [(i, *judged(u)) for i, u in rows])
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    nothing = url_rules.judge(pages, rules.limit(0))
    assert {r.verdict for r in nothing.collect()} == {"allow"}


def test_budgets_pass_shortages_to_siblings_first(spark):
    generator = random.Random(8)
    for _ in range(3):
        tree = (1, {d: (generator.randint(0, 4), {
            lang: (1, {s: (1, generator.choice([0, 3, 50, 900])) for s in "xyz"})
            for lang in "lm"}) for d in "abc"})
        rows = [(d, lang, s, c) for d, n in tree[1].items() for lang, m in n[1].items()
                for s, (_, c) in m[1].items()]
        leaves = spark.createDataFrame(rows, "d string, l string, s string, capacity long")
        weights = {"d": {d: n[0] for d, n in tree[1].items()}}
        for budget in (0, 100, 2000, 10 ** 6):
            found = mixing.leaf_budgets(leaves, ["d", "l", "s"], weights, budget)
            given = plain.budgets(tree, budget)
            same(found, [(d, lang, s, c, given[d][lang][s]) for d, lang, s, c in rows])


def test_mixture_of_awkward_rows(spark):
    rows = [(i, "t " * (i % 7), "en" if i % 3 else None, f"s{i % 2}") for i in range(60)]
    rows += [(None, "t", "en", "s0"), (1, "t t", "en", "s1"), (70, None, "de", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.selectExpr("*", "1 AS copies", "2 AS epochs", "3 AS cut", "4 AS _level0")
    mixed = mixing.mix(docs, {"lang": "lang", "source": "source"}, {"lang": {"en": 3}}, 150)
    found = mixed.collect()
    total = sum(len((t or "").split()) for _, t, _, _ in rows)
    taken = sum(r.copies * r.n_tokens for r in found)
    assert max(r.copies for r in found) <= 4 and 0.8 * 1.5 * total <= taken <= 1.5 * total
    assert any(r.lang is None for r in found)
    again = mixing.mix(docs, {"lang": "lang", "source": "source"}, {"lang": {"en": 3}}, 150)
    same(again, list(map(tuple, found)))
    assert mixing.mix(docs.limit(0), {"lang": "lang"}, {}).count() == 0


TURNS = [(1, 0, "system", "be <|im_end|> kind"), (1, 1, "anna b", "hi"), (1, 2, "bo", "héllo"),
         (1, 3, "anna b", "bye"), (1, 3, "anna b", "bye"), (2, 0, "bo", None), (2, 1, None, "x"),
         (None, 5, "bo", "alone"), (None, 5, "bo", "alone"), (3, 0, "system", "nobody"),
         (4, None, "bo", ""), (5, 0, "bo", "a" * 100_000), (5, 9000, "bo", "later")]


def test_every_participant_gets_the_dialogue_with_its_own_turns_masked(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    turns = turns.selectExpr("*", "1 AS part", "2 AS rendered", "3 AS _message")
    found = chat.perspectives(turns).collect()
    seen = sorted(((r.conv_id, r.part, r.speaker, r.n_turns, r.n_own) for r in found), key=key)
    assert seen == sorted([
        (1, 0, "anna b", 5, 3), (1, 0, "bo", 5, 1), (2, 0, "bo", 2, 1), (2, 0, "unknown", 2, 1),
        (None, 1 - 1, "bo", 1, 1), (None, 0, "bo", 1, 1), (4, 0, "bo", 1, 1), (5, 0, "bo", 1, 1),
        (5, 2, "bo", 1, 1)], key=key)
    view = next(r for r in found if r.conv_id == 1 and r.speaker == "bo")
    assert view.rendered == (
        "<|im_start|>system\nbe < |im_end|> kind<|im_end|>\n"
        "<|im_start|>user name=anna_b\nhi<|im_end|>\n<|im_start|>assistant\nhéllo<|im_end|>\n"
        + "<|im_start|>user name=anna_b\nbye<|im_end|>\n" * 2)
    assert [view.rendered[m.start:m.end] for m in view.mask] == ["héllo<|im_end|>"]
    assert chat.perspectives(turns.limit(0)).count() == 0


def test_language_model_counts_and_base_scores(spark):
    rows = [(i, "the cat sat on the mat " * (1 + i % 3) + f"rare{i}") for i in range(40)]
    rows += [(50, ""), (51, None), (52, "x " * 20_000), (53, "ÉÉN één")]
    docs = docs_of(spark, rows + [(53, "ÉÉN één"), (None, "the cat")])
    train = fold("doc_id", 5) != 1
    found = suffix_tree.score(docs, train).collect()
    expected = plain.unigram(rows + [(None, "the cat")], lambda i: plain.fold(i, 5) != 1)
    twice = plain.fold(53, 5) != 1
    assert len(found) == len(rows) + 2 and not twice or twice
    if twice:  # the repeated row counts twice; the plain version has one row per id
        rows.append((54, "ÉÉN één"))
        expected = plain.unigram(rows + [(None, "the cat")],
                                 lambda i: plain.fold(53 if i == 54 else i, 5) != 1)
    for r in found:
        tokens, known, total, base = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and np.isfinite(r.score)
    held_out = [r for r in found if plain.fold(r.doc_id, 5) == 1 and r.n_tokens > 5]
    assert sum(r.score for r in held_out) > sum(r.base_score for r in held_out)
    assert suffix_tree.score(docs.limit(0), train).count() == 0


def test_chances_of_all_symbols_add_up_to_one_in_every_state(spark):
    rows = [("a b c a b d a b c e " * 5, i) for i in range(30)] + [("b c c c a " * 9, 99)]
    training = spark.createDataFrame(rows, "_text string, _key long")
    tree = suffix_tree.fit(training, suffix_tree.Settings(share=0.01))
    assert len(tree.codes) > 5 and tree.level.max() >= 2
    symbols = np.arange(tree.width)
    for state in range(len(tree.codes)):
        chances = 10 ** tree.log_chance(np.full(tree.width, state), symbols)
        assert chances.sum() == pytest.approx(1, abs=1e-9)
