"""Operators do the whole job whatever the size of the input and the layout of its files."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caseflow.llm import chat, simhash, suffix_tree
from tests.conftest import DATA
from tests.llm import reference as plain


def test_contexts_of_a_count_are_learnt_in_a_corpus_of_any_size(spark):
    rows = [(1, "x y " * 500_000)] + [(i, "alpha beta gamma") for i in range(2, 42)]
    docs = spark.createDataFrame(rows + [(99, "alpha beta gamma")], "doc_id long, text string")
    found = {r.doc_id: r for r in suffix_tree.score(docs, F.col("doc_id") < 99).collect()}
    # beta, gamma and the end are each next to certain after what stands before them.
    assert found[99].base_score < -15 and found[99].score > -6


def test_parts_of_a_dialogue_joined_are_the_whole_rendering(spark):
    rows = [(1, 0, "system", "be kind"), (1, 4090, "anna b", "hi"), (1, 4100, "bo", "héllo <|"),
            (1, 4101, "bo", "and"), (1, 9000, "cy", "late"), (1, 9001, "bo", "bye")]
    rows += [(2, t, "bo" if t % 2 else "anna", f"turn {t}") for t in range(4090, 4110)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    joined = {}
    for r in chat.perspectives(turns).orderBy("conv_id", "speaker", "part").collect():
        view = joined.setdefault((r.conv_id, r.speaker), ["", [], 0, 0])
        for i, value in enumerate((r.rendered, r["mask"], r.n_turns, r.n_own)):
            view[i] += value
    whole = {(r.conv_id, r.speaker): [r.rendered, r["mask"], r.n_turns, r.n_own]
             for r in chat.perspectives(turns, part_turns=10 ** 6).collect()}
    assert len(whole) == 5 and joined == whole
    text, mask, _, own = whole[1, "anna b"]
    assert own == 1 and [text[m.start:m.end] for m in mask] == ["hi<|im_end|>"]


def suffix_scores(texts, training, settings):
    """log10 probabilities of texts in the tree of the training texts, from exact counts."""
    follows = defaultdict(Counter)
    for text in training:
        own = ["<s>", *plain.words(text), None]
        for at in range(1, len(own)):
            for level in range(min(settings.depth, at) + 1):
                follows[tuple(own[at - level:at])][own[at]] += 1
    root = follows[()]
    base = sum(root.values()) + 0.5 * (len(root) + 1)
    entries, back, keep = {}, {}, set()

    def chance(context, word):
        while context:
            if context in back and word in entries[context]:
                return entries[context][word]
            if context in back:
                return back[context] * chance(context[1:], word)
            context = context[1:]
        return (root[word] + 0.5) / base

    for context in sorted(follows, key=len)[1:]:
        seen = sum(follows[context].values())
        if seen >= settings.least:
            own = {w: n for w, n in follows[context].items() if n >= settings.own}
            b = (settings.weight + seen - sum(own.values())) / (settings.weight + seen)
            above = {w: chance(context[1:], w) for w in own}
            entries[context] = {
                w: n / (settings.weight + seen) + b * above[w] for w, n in own.items()}
            back[context] = b
            divergence = sum(c * math.log(c / above[w]) for w, c in entries[context].items())
            divergence += (1 - sum(above.values())) * b * math.log(b)
            if divergence >= settings.divergence:
                keep |= {context[i:] for i in range(len(context))}
    back = {context: b for context, b in back.items() if context in keep}
    out = []
    for text in texts:
        own = ["<s>", *plain.words(text), None]
        out.append(sum(math.log10(chance(tuple(own[max(0, at - settings.depth):at]), own[at]))
                       for at in range(1, len(own))))
    return out, len(keep)


@pytest.mark.parametrize("files", [1, 7])
def test_contexts_are_counted_over_all_texts(spark, monkeypatch, files):
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 5000)
    generator = random.Random(6)
    vocabulary = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    texts = []
    for i in range(300):
        own = generator.choices(vocabulary, weights, k=generator.randint(0, 60))
        texts.append(" ".join(own) + " new york city hall" * (i % 3) + f" only{i}")
    training = texts[:240]
    settings = suffix_tree.Settings()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = docs.repartitionByRange(files, "doc_id")
    found = {r.doc_id: r.score for r in suffix_tree.score(
        docs, F.col("doc_id") < len(training), settings=settings).collect()}
    expected, kept = suffix_scores(texts, training, settings)
    assert kept > 40
    for i, score in enumerate(expected):
        assert found[i] == pytest.approx(score, rel=1e-9)
    learnt = suffix_tree.learn(docs.where(F.col("doc_id") < len(training)).select("text"), settings)
    assert learnt.contexts.count() == kept


def test_each_group_keeps_a_document_where_ids_repeat(spark):
    texts = [" ".join(f"{name}{i}" for i in range(80)) for name in ("one", "two", "three")]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[1]), (2, texts[2]), (2, texts[2]), (3, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted(map(tuple, kept)) == sorted([rows[0], rows[1], rows[3]])


def test_stages_are_handed_parquet(spark, monkeypatch):
    seen = []

    def stage(spark, docs, folder):
        seen.append((docs.inputFiles(), docs.count()))
        return docs.where("doc_id % 2 = 0")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", stage), ("second", stage)])
    kept = corpus_pipeline.run(spark, DATA)
    assert seen[1][0] and all(f.endswith(".parquet") for f in seen[1][0])
    assert 0 < kept.count() == seen[1][1] < seen[0][1]
