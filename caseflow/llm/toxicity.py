"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.tables import keeps_names, need, others, saved
from caseflow.llm.words import NOT_ALNUM, Piece, mix, pieces

_U64 = np.uint64
# A state is averaged in so many parts, each in a task of its own.
PARTS = 16
STATE = "part int, state binary"


@dataclass(frozen=True)
class Settings:
    """``bits``: features are hashed to 2^bits places. ``alpha``, ``beta``: per-coordinate
    learning rate alpha / (beta + root of the summed squared gradients). ``l1``, ``l2``:
    strength of the penalties. ``passes`` over the rows of a shard, in each of ``rounds``
    after which the shards' states are averaged. ``max_rows``: at most so many labelled
    documents are learnt from; those with the smallest hash of their id."""

    bits: int = 18
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 2.0
    l2: float = 0.0
    passes: int = 1
    rounds: int = 6
    shards: int = 16
    max_rows: int = 20_000


def features(piece: Piece, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and place of every feature: words, pairs of neighbours, and skip-grams,
    pairs with one word between. Repeats are included."""
    words, text = piece.hashes(), piece.text
    shift = _U64(64 - bits)
    found, of = [words], [text]
    for gap, salt in ((1, _U64(0xA5A5A5A5A5A5A5A5)), (2, _U64(0x3C3C3C3C3C3C3C3C))):
        same = text[gap:] == text[:-gap]
        pair = mix((words[:-gap] * _U64(3) + words[gap:]) ^ salt)
        found.append(pair[same])
        of.append(text[gap:][same])
    places = (mix(np.concatenate(found)) >> shift).astype(np.int64)
    return np.concatenate(of), places


def _presence(piece: Piece, bits: int, useful: np.ndarray | None = None):
    """Distinct (text, place) pairs, sorted; of the places in ``useful`` only if given."""
    text, place = features(piece, bits)
    if useful is not None:
        some = useful[place]
        text, place = text[some], place[some]
    pairs = np.unique(text << bits | place)
    return pairs >> bits, pairs & ((1 << bits) - 1)


class Learner:
    """State z and n of FTRL-proximal, with one more place, the last, for the bias."""

    def __init__(self, settings: Settings, state: np.ndarray | None = None):
        self.settings = settings
        size = (1 << settings.bits) + 1
        self.z, self.n = np.zeros((2, size)) if state is None else state.astype(np.float64)

    def weights(self, places=slice(None)) -> np.ndarray:
        s, z = self.settings, self.z[places]
        rate = (s.beta + np.sqrt(self.n[places])) / s.alpha + s.l2
        return np.where(np.abs(z) <= s.l1, 0.0, (np.sign(z) * s.l1 - z) / rate)

    def bias(self) -> float:
        """The bias carries no penalty."""
        return -self.z[-1] * self.settings.alpha / (self.settings.beta + np.sqrt(self.n[-1]))

    def learn(self, places: np.ndarray, label: int) -> None:
        alpha = self.settings.alpha
        weights, bias = self.weights(places), self.bias()
        gradient = 1 / (1 + np.exp(-np.clip(bias + weights.sum(), -35, 35))) - label
        for at, weight in ((places, weights), (-1, bias)):
            step = (np.sqrt(self.n[at] + gradient * gradient) - np.sqrt(self.n[at])) / alpha
            self.z[at] += gradient - step * weight
            self.n[at] += gradient * gradient


def _sample(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str,
            settings: Settings) -> DataFrame:
    """Text, label and shard of the documents learnt from, ``max_rows`` at most."""
    hashed = F.xxhash64(F.col(id), F.lit(7))
    marked = labels.where(F.col(id).isNotNull() & F.col(label).isin(0, 1))
    marked = marked.groupBy(id).agg(F.max(label).alias("_label"))
    chosen = marked.orderBy(hashed, id).limit(settings.max_rows)
    chosen = chosen.select(F.col(id).alias("_chosen"), "_label")
    if settings.max_rows <= 100_000:  # ids and labels: two megabytes
        chosen = F.broadcast(chosen)
    rows = docs.join(chosen, F.col(id) == F.col("_chosen"))
    rows = rows.groupBy(hashed.alias("_order"), F.col(id).alias("_id"), "_label").agg(
        F.min(text).alias("_text"))
    shard = F.pmod(F.xxhash64("_order"), F.lit(settings.shards)).cast("int")
    return rows.select(shard.alias("_shard"), "_order", "_label", "_text")


def _learning(sent, settings: Settings, round: int):
    """What a task does with a shard: go through it and give the state it ends with."""

    def learn(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("_order", "ascending"), ("_label", "ascending")])
        learner, rows = Learner(settings, sent.value), []
        for piece in pieces(shard.column("_text").combine_chunks(), NOT_ALNUM):
            of, places = _presence(piece, settings.bits)
            bounds = np.searchsorted(of, np.arange(piece.texts + 1))
            own = shard.column("_label").slice(piece.first, piece.texts).to_pylist()
            rows += [(places[a:b], y) for a, b, y in zip(bounds, bounds[1:], own)]
        for turn in range(settings.passes):
            order = np.random.default_rng(17 * round + turn).permutation(len(rows))
            for row in order.tolist():
                learner.learn(*rows[row])
        whole = np.r_[learner.z, learner.n].astype(np.float32)
        parts = [part.tobytes() for part in np.array_split(whole, PARTS)]
        return pa.table({"part": np.arange(PARTS, dtype=np.int32), "state": parts})

    return learn


def _mean(states: pa.Table) -> pa.Table:
    """The mean of the shards' values for one part of the state."""
    values = [np.frombuffer(s.as_buffer(), np.float32) for s in states.column("state")]
    mean = (sum(v.astype(np.float64) for v in values) / len(values)).astype(np.float32)
    return pa.table({"part": states.column("part")[:1], "state": [mean.tobytes()]})


@keeps_names
def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text",
        label: str = "toxic", settings: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Weights and bias, learnt from at most ``settings.max_rows`` labelled documents.

    Each shard of the sample is gone through in one task; after each round the states of
    the shards, of fixed size, are averaged and are the start of the next. Ids with several
    labels count as toxic if one of them says so; of rows that repeat an id the smallest text
    is learnt from. Without labelled rows all weights are 0.
    """
    need(docs, id, text)
    need(labels, id, label)
    sample = saved(_sample(docs, labels, id, text, label, settings))
    context = docs.sparkSession.sparkContext
    state = None
    for round in range(settings.rounds):
        learn = _learning(context.broadcast(state), settings, round)
        states = sample.groupBy("_shard").applyInArrow(learn, STATE)
        parts = sorted(states.groupBy("part").applyInArrow(_mean, STATE).collect())
        if not parts:
            break
        state = np.frombuffer(b"".join(p["state"] for p in parts), np.float32).reshape(2, -1)
    learner = Learner(settings, state)
    return learner.weights()[:-1].astype(np.float32), float(learner.bias())


@keeps_names
def score(docs: DataFrame, weights: np.ndarray, bias: float, text: str = "text",
          name: str = "score") -> DataFrame:
    """``docs`` with the probability of being toxic, from whole texts alone.

    Only the places with a weight, a few thousand, go to the tasks. Texts without words,
    null ones included, get what the bias alone says. A column named like the result is
    replaced.
    """
    need(docs, text)
    bits = int(len(weights)).bit_length() - 1
    places = np.flatnonzero(weights)
    sent = docs.sparkSession.sparkContext.broadcast((places, weights[places]))
    rows = docs.select(*others(docs, name), F.col(text).alias("_text"))
    rest = rows.drop("_text")
    schema = T.StructType([*rest.schema.fields, T.StructField(name, T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values = sent.value
        dense = np.zeros(1 << bits)
        dense[at] = values
        useful = dense != 0
        for batch in batches:
            sums = np.zeros(batch.num_rows)
            for piece in pieces(batch.column(batch.num_columns - 1), NOT_ALNUM):
                of, found = _presence(piece, bits, useful)
                sums[piece.first : piece.first + piece.texts] = np.bincount(
                    of, dense[found], minlength=piece.texts)
            result = 1 / (1 + np.exp(-np.clip(sums + bias, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(result)], names=schema.names)

    return rows.mapInArrow(scored, schema)
