"""Quality scores: random Fourier features of document statistics, ridge, isotonic fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.tables import keeps_names, need, others, saved
from caseflow.llm.words import BLANKS, pieces, ranges, text_buffers

# Kinds of bytes whose shares are statistics; the last are all others.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789", "blank": b" \t\r\x0b\x0c", "newline": b"\n",
    "sentence": b".,;:!?'\"()-", "beyond_ascii": bytes(range(128, 256)), "symbol": b"",
}
STATISTICS = [*KINDS, "exclaimed", "log_bytes", "log_words", "word_bytes", "word_spread",
              "distinct", "repeated", "line_bytes"]
# Text whose statistics are computed at once.
STEP_BYTES = 1 << 20
# Matrices that reach the driver, each (features + 2)^2 doubles; bins of raw scores, and
# the range they divide.
SUMS = 16
BINS, LOW, HIGH = 2_000, -0.5, 1.5

_KIND = np.full(256, len(KINDS) - 1, dtype=np.uint8)
for _number, _bytes in enumerate(KINDS.values()):
    _KIND[np.frombuffer(_bytes, dtype=np.uint8)] = _number


def _shares(column: pa.Array) -> np.ndarray:
    """Share of each kind of bytes, of ``!``, and bytes, of each text."""
    data, offsets = text_buffers(column)
    out = np.zeros((len(column), len(KINDS) + 2))
    for row, end in ranges(offsets, STEP_BYTES):
        own = data[offsets[row] : offsets[end]]
        sizes = np.diff(offsets[row : end + 1])
        of = np.repeat(np.arange(end - row, dtype=np.int64), sizes)
        counts = np.bincount(of * len(KINDS) + _KIND[own], minlength=(end - row) * len(KINDS))
        whole = np.maximum(sizes, 1)[:, None]
        out[row:end, : len(KINDS)] = counts.reshape(end - row, -1) / whole
        out[row:end, -2] = np.bincount(of[own == 33], minlength=end - row) / whole[:, 0]
        out[row:end, -1] = sizes
    return out


def statistics(column: pa.Array) -> np.ndarray:
    """A row of ``STATISTICS`` for each text of a column; all zero for an empty one."""
    shares = _shares(column)
    sizes = shares[:, -1]
    out = np.zeros((len(column), len(STATISTICS)))
    at = {name: number for number, name in enumerate(STATISTICS)}
    out[:, : len(KINDS) + 1] = shares[:, :-1]
    out[:, at["log_bytes"]] = np.log1p(sizes)
    newlines = shares[:, list(KINDS).index("newline")] * sizes
    out[:, at["line_bytes"]] = np.log1p(sizes / (1 + newlines))
    for piece in pieces(column, BLANKS):
        rows = slice(piece.first, piece.first + piece.texts)
        words = piece.counts()
        some = np.maximum(words, 1)
        sums = lambda values: np.bincount(piece.text, values, minlength=piece.texts)
        lengths = (piece.ends - piece.starts).astype(np.float64)
        mean = sums(lengths) / some
        spread = np.sqrt(np.maximum(sums(lengths * lengths) / some - mean * mean, 0))
        hashes = piece.hashes()
        order = np.lexsort((hashes, piece.text))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (
            piece.text[order][1:] != piece.text[order][:-1])
        distinct = np.bincount(piece.text[order][new], minlength=piece.texts)
        again = np.zeros(len(order), dtype=bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (piece.text[1:] == piece.text[:-1])
        out[rows, at["log_words"]] = np.log1p(words)
        out[rows, at["word_bytes"]] = np.log1p(mean)
        out[rows, at["word_spread"]] = np.log1p(spread)
        out[rows, at["distinct"]] = distinct / some
        out[rows, at["repeated"]] = sums(again) / some
    return out


@keeps_names
def with_statistics(docs: DataFrame, text: str = "text", name: str = "statistics") -> DataFrame:
    """``docs`` without ``text``, with the statistics of whole texts as ``name``."""
    need(docs, text)
    rest = docs.select(*others(docs, text, name))
    schema = T.StructType([*rest.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))])
    rows = docs.select(*rest.columns, F.col(text).alias("_text"))

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = statistics(batch.column(batch.num_columns - 1)).astype(np.float32)
            values = pa.ListArray.from_arrays(
                np.arange(len(found) + 1, dtype=np.int32) * found.shape[1], found.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], names=schema.names)

    return rows.mapInArrow(computed, schema)


@dataclass(frozen=True)
class Settings:
    """``features``: number of cosines. ``width``: of the Gaussian kernel, in deviations of
    a statistic times the root of their number. ``ridge``: penalty per labelled row."""

    features: int = 256
    width: float = 0.5
    ridge: float = 1e-4
    seed: int = 11


class Model:
    """Maps statistics to a score from 0 to 1."""

    def __init__(self, settings: Settings, mean: np.ndarray, deviation: np.ndarray):
        random = np.random.default_rng(settings.seed)
        scale = settings.width * len(mean) ** 0.5
        self.mean, self.deviation = mean, deviation
        self.directions = random.normal(size=(len(mean), settings.features)) / scale
        self.phases = random.uniform(0, 2 * np.pi, settings.features)
        self.weights = np.zeros(settings.features + 1)
        self.raw, self.share = np.array([0.0]), np.array([0.5])

    def fourier(self, values: np.ndarray) -> np.ndarray:
        standard = np.clip((values - self.mean) / self.deviation, -8, 8)
        cosines = np.cos(standard @ self.directions + self.phases)
        return np.c_[cosines * (2 / len(self.phases)) ** 0.5, np.ones(len(values))]

    def raw_score(self, values: np.ndarray) -> np.ndarray:
        return self.fourier(values) @ self.weights

    def score(self, values: np.ndarray) -> np.ndarray:
        return np.interp(self.raw_score(values), self.raw, self.share)


def _values(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(
        batch.num_rows, len(STATISTICS)).astype(np.float64)


def _summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """Sum over all rows of a matrix that ``part`` makes of some of them.

    Each partition sends one matrix; a fixed number of tasks add those up as they come and
    send one each to the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(batch)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sum": [total.tobytes()]})

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for value in batch.column(0):
                own = np.frombuffer(value.as_buffer(), dtype=np.float64)
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sum": [total.tobytes()]})

    sums = rows.mapInArrow(add, "sum binary").repartition(SUMS).mapInArrow(again, "sum binary")
    matrices = [np.frombuffer(row["sum"], dtype=np.float64) for row in sums.toLocalIterator()]
    return sum(matrices[1:], matrices[0]) if matrices else None


def isotonic(weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Ascending means nearest to sums / weights, by pooling neighbours out of order."""
    blocks: list[list[float]] = []
    for weight, total in zip(weights.tolist(), sums.tolist()):
        blocks.append([weight, total, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.repeat([total / weight for weight, total, _ in blocks],
                     [int(n) for _, _, n in blocks])


def fit(rows: DataFrame, name: str = "statistics", label: str = "label",
        settings: Settings = Settings()) -> Model:
    """Ridge weights and calibration from all labelled rows of ``with_statistics``.

    Rows whose label is not from 0 to 1 are left out. Means and deviations, then the normal
    equations, are summed within partitions; the calibration sees counts of raw scores in
    ``BINS`` equal bins. Without labelled rows every score is 0.5.
    """
    rows = rows.where(F.col(label).between(0, 1)).select(
        name, F.col(label).cast("double").alias("_label"))

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        values = _values(batch, name)
        return np.stack([np.full(values.shape[1], len(values)), values.sum(axis=0),
                         (values * values).sum(axis=0)])

    found = _summed(rows, moments)
    if found is None:
        return Model(settings, np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    count, total, squares = found.reshape(3, -1)
    mean = total / count
    deviation = np.sqrt(np.maximum(squares / count - mean * mean, 1e-12))
    model = Model(settings, mean, np.maximum(deviation, 1e-4))

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        whole = np.c_[model.fourier(_values(batch, name)), batch.column(1).to_numpy()]
        return whole.T @ whole

    size = settings.features + 2
    summed = _summed(rows, equations).reshape(size, size)
    penalty = settings.ridge * count[0] * np.eye(size - 1)
    penalty[-1, -1] = 0  # the constant is free
    model.weights = np.linalg.solve(summed[:-1, :-1] + penalty, summed[:-1, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.clip(model.raw_score(_values(batch, name)), LOW, HIGH)
            bins = np.round((raw - LOW) * BINS / (HIGH - LOW)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bins), batch.column(1)], names=["bin", "label"])

    counts = rows.mapInArrow(binned, "bin long, label double").groupBy("bin").agg(
        F.count("*").alias("rows"), F.sum("label").alias("labels")).orderBy("bin").collect()
    model.raw = np.array([r["bin"] for r in counts]) * (HIGH - LOW) / BINS + LOW
    model.share = isotonic(np.array([float(r["rows"]) for r in counts]),
                           np.array([r["labels"] for r in counts]))
    return model


def score(rows: DataFrame, model: Model, statistics: str = "statistics",
          name: str = "score") -> DataFrame:
    """Rows of ``with_statistics`` with their score in place of the statistics."""
    rest = rows.drop(statistics, name)
    schema = T.StructType([*rest.schema.fields, T.StructField(name, T.DoubleType())])
    rows = rows.select(*rest.columns, statistics)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.clip(model.score(_values(batch, statistics)), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found)], names=schema.names)

    return rows.mapInArrow(scored, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text",
                   label: str = "quality", settings: Settings = Settings()) -> DataFrame:
    """Every row's ``id`` and ``score``, higher where label 1 is likelier.

    Scores follow from whole texts alone. Null texts count as empty, which have all
    statistics zero and a score like any other. An id with several labels is learnt from
    with their mean; rows that repeat an id are scored each. Null ids match no label.
    """
    need(docs, id, text)
    need(labels, id, label)
    rows = with_statistics(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")),
                           "_text", "_statistics")
    rows = saved(rows)
    marked = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id).alias("_id")).agg(
        F.avg(label).alias("_label"))
    model = fit(saved(rows.join(marked, "_id")), "_statistics", "_label", settings)
    return score(rows, model, "_statistics").select(F.col("_id").alias(id), "score")
