"""Ranked lexical search over hashed max-sketches, with exact results.

The index holds a sketch of every document: rows of coordinates, into which the impacts of
its terms are folded by hash, the largest of a coordinate staying. A term's impact is at
most the smallest of its coordinates, one in each row, so a lookup of all query terms
bounds the document's score from above. Documents are then scored exactly in descending
order of their bounds, until the bound falls under the score of the last rank. A first
share of the index gives each query a floor that holds for the whole, so that the tasks
over the rest begin with it.

Terms are told apart by 64-bit hashes; everything else is exact integer arithmetic.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.tables import handed_on, need, shared_folder
from caseflow.llm.words import NOT_ALNUM, Lookup, mix, pieces

# Hash rows of a sketch, and coordinates per distinct term in each row, at least.
SKETCH_ROWS = 2
SPREAD = 4
# A coordinate counts impacts in steps of this size, rounded up; impacts are under 10^6.
STEP = 4096
# One document in so many is searched first, for the floors.
PRIMER = 32
# Query terms that are looked up together, all queries' added; a query is never split.
BATCH_TERMS = 1 << 18
# Documents whose bounds are found at once, whose bounds are sorted at once, and which are
# scored between two looks at the last rank.
BOUND_DOCS, SORT_DOCS, SCORE_DOCS = 128, 2048, 64

_U64 = np.uint64
_INDEX = "doc_id bigint, n bigint, sketch binary, terms binary, counts binary, primer boolean"


@dataclass(frozen=True)
class Index:
    """``table`` has a row per document with a term; ``documents`` and ``terms`` count them
    and all their terms with repeats."""

    table: DataFrame
    documents: int
    terms: int


def build(docs: DataFrame, id: str = "doc_id", text: str = "text") -> Index:
    """Writes the index of whole texts into the shared folder.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z
    in lower case. Null and empty texts have none and are not listed; rows of one id are
    documents of their own. ``id`` must be of a whole-number type and may be null. A very
    long text has a sketch as long as its distinct terms ask for; it is held by one task.
    """
    need(docs, id, text)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counted = rows.select("text").mapInArrow(_count, "documents bigint, terms bigint").agg(
        F.sum("documents"), F.sum("terms")).first()
    documents, terms = int(counted[0] or 0), int(counted[1] or 0)
    folder = f"{shared_folder(docs)}/{uuid.uuid4().hex}.parquet"
    indexed = rows.mapInArrow(_indexer(documents, terms), _INDEX)
    indexed.write.option("compression", "zstd").partitionBy("primer").parquet(folder)
    table = docs.sparkSession.read.schema(_INDEX).parquet(folder)
    return Index(table, documents, terms)


def search(index: Index, queries: DataFrame, k: int = 50, id: str = "item_id",
           text: str = "text") -> DataFrame:
    """The ``k`` best documents of each query: id, ``rank``, ``doc_id``, ``score``.

    The score of a document sums, over the query's distinct terms, the term's weight
    floor(1000 ln((2N + 2) / (2 df + 1))) times (10^9 tf) div (1000 tf + 20 m), where m is
    50 + (50 n N) div L. Equal scores go by ascending ``doc_id``, null last; only scores
    above 0 are listed. Queries that agree in id and terms are one; queries of one id and
    different terms are ranked apart. A query without terms, or an empty table, gives no
    rows. Queries are looked up in batches of a bounded number of terms, each batch being
    one job whose result is written before the next begins.
    """
    need(queries, id, text)
    asked = queries.select(F.col(id).alias("item_id"), F.col(text).alias("text"))
    kind = asked.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item_id", kind),
                           T.StructField("terms", T.ArrayType(T.LongType()))])
    asked = asked.mapInArrow(_query_terms, schema)
    asked = handed_on(asked.distinct().withColumn(
        "query", F.xxhash64("item_id", "terms")))
    entries = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    batches = max(1, -(-entries // BATCH_TERMS))
    found = []
    for batch in range(batches):
        mine = asked.where(F.pmod("query", F.lit(batches)) == batch)
        ranked = _search_batch(index, mine, k)
        found.append(handed_on(ranked) if batches > 1 else ranked)
    out = found[0]
    for other in found[1:]:
        out = out.unionAll(other)
    return out.select(F.col("item_id").alias(id), "rank", "doc_id", "score")


def _search_batch(index: Index, asked: DataFrame, k: int) -> DataFrame:
    rows = asked.select("terms").toArrow().column("terms").combine_chunks()
    # The order of the batch's queries is that of their terms; ids are joined back by it.
    lists = sorted({tuple(x) for x in rows.to_pylist()})
    vocabulary = np.unique(np.array([t for x in lists for t in x], dtype=np.int64).view(_U64))
    weights = _weights(index, vocabulary)
    batch = _Batch(lists, vocabulary, weights)
    schema = "query int, doc_id bigint, score bigint"

    def best(rows: DataFrame) -> DataFrame:
        by = Window.partitionBy("query").orderBy(
            F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    task = _searcher(batch, index.documents, index.terms, k, {})
    first = best(index.table.where("primer").mapInArrow(task, schema))
    floors = {r["query"]: r["score"] for r in first.where(F.col("rank") == k).collect()}
    task = _searcher(batch, index.documents, index.terms, k, floors)
    ranked = best(index.table.mapInArrow(task, schema))
    numbers = asked.sparkSession.createDataFrame(
        [(n, list(x)) for n, x in enumerate(lists)], "query int, terms array<bigint>")
    named = asked.select("item_id", "terms").join(F.broadcast(numbers), ["terms"])
    return ranked.join(F.broadcast(named.select("query", "item_id")), ["query"]).select(
        "item_id", "rank", "doc_id", "score")


def _weights(index: Index, vocabulary: np.ndarray) -> np.ndarray:
    """Weight of each term of the vocabulary, from the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lookup = np.zeros(len(vocabulary), dtype=np.int64), Lookup(vocabulary)
        for batch in batches:
            found = lookup.find(_flat(batch.column("terms"), _U64)[0])
            held += np.bincount(found[found >= 0], minlength=len(held))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["term", "df"])

    counts = index.table.select("terms").mapInArrow(run, "term bigint, df bigint")
    df = {r.term: r.df for r in counts.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    n = index.documents
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) if t in df else 0
                     for t in range(len(vocabulary))], dtype=np.int64)


class _Batch:
    """Queries of one batch: their terms that some document holds, one after another."""

    def __init__(self, lists: list[tuple[int, ...]], vocabulary: np.ndarray,
                 weights: np.ndarray):
        # Queries in ``numbers`` have terms of some weight; ``starts`` bounds their entries.
        used = np.flatnonzero(weights > 0)
        place = np.full(len(vocabulary), -1, dtype=np.int64)
        place[used] = np.arange(len(used))
        self.terms = vocabulary[used]
        self.numbers, self.starts, of, weight = [], [0], [], []
        for number, terms in enumerate(lists):
            at = np.searchsorted(vocabulary, np.array(terms, dtype=np.int64).view(_U64))
            at = at[place[at] >= 0]
            if len(at):
                self.numbers.append(number)
                of.append(place[at])
                weight.append(weights[at])
                self.starts.append(self.starts[-1] + len(at))
        self.of = np.concatenate(of) if of else np.zeros(0, dtype=np.int64)
        self.weight = np.concatenate(weight) if weight else np.zeros(0, dtype=np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = terms = 0
    for batch in batches:
        for piece in pieces(batch.column(0), NOT_ALNUM):
            documents += int((piece.counts() > 0).sum())
            terms += len(piece.starts)
    yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([terms])],
                                     ["documents", "terms"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch.column("text"), NOT_ALNUM):
            hashes, counts = piece.hashes(), piece.counts()
            ends = np.cumsum(counts)
            terms = [np.unique(hashes[e - c:e]).view(np.int64) for e, c in zip(ends, counts)]
            ids = batch.column("item_id").slice(piece.first, piece.texts)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(terms, pa.list_(pa.int64()))], ["item_id", "terms"])


def _lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of each document; exact also where the product is beyond 64 bits."""
    if len(n) and 50 * int(n.max()) * documents >= 1 << 63:
        return np.array([50 + 50 * int(x) * documents // terms for x in n], dtype=np.int64)
    return 50 + 50 * n.astype(np.int64) * documents // max(terms, 1)


def _impacts(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * counts // (1000 * counts + 20 * m)


def _coordinates(hashes: np.ndarray, widths: np.ndarray, row: int) -> np.ndarray:
    """Coordinate of each hash within one row of a sketch; widths are powers of two."""
    own = hashes if row == 0 else mix(hashes ^ _U64(0x9E3779B97F4A7C15 * row & (1 << 64) - 1))
    return (own & (widths - 1).astype(_U64)).astype(np.int64)


def _widths(distinct: np.ndarray) -> np.ndarray:
    """Smallest powers of two with ``SPREAD`` coordinates per distinct term."""
    return 1 << np.ceil(np.log2(np.maximum(distinct, 1) * SPREAD)).astype(np.int64)


def _indexer(documents: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text"), NOT_ALNUM):
                hashes, n = piece.hashes(), piece.counts()
                order = np.lexsort((hashes, piece.text))
                hashes, of = hashes[order], piece.text[order]
                fresh = np.ones(len(hashes), dtype=bool)
                fresh[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
                at = np.flatnonzero(fresh)
                counts = np.diff(np.append(at, len(hashes)))
                hashes, of = hashes[at], of[at]
                distinct = np.bincount(of, minlength=piece.texts)
                m = _lengths(n, documents, total)
                steps = -(-_impacts(counts, m[of]) // STEP)
                widths = np.where(distinct > 0, _widths(distinct), 0)
                ends = np.cumsum(SKETCH_ROWS * widths)
                sketch = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
                starts = ends - SKETCH_ROWS * widths
                for row in range(SKETCH_ROWS):
                    place = starts[of] + row * widths[of] + _coordinates(hashes, widths[of], row)
                    np.maximum.at(sketch, place, steps.astype(np.uint8))
                ids = batch.column("doc_id").slice(piece.first, piece.texts)
                total_hash = np.zeros(piece.texts, dtype=_U64)
                np.add.at(total_hash, of, hashes)
                primer = mix(total_hash + n.astype(_U64)) % _U64(PRIMER) == 0
                out = pa.RecordBatch.from_arrays([
                    ids, pa.array(n), _binaries(sketch, ends),
                    _binaries(hashes.view(np.uint8), np.cumsum(8 * distinct)),
                    _binaries(counts.astype(np.uint32).view(np.uint8), np.cumsum(4 * distinct)),
                    pa.array(primer),
                ], ["doc_id", "n", "sketch", "terms", "counts", "primer"])
                yield out.filter(pa.array(n > 0))

    return run


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [
        None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _flat(column: pa.Array, type: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column and where each row begins and ends in them."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    size = np.dtype(type).itemsize
    if data is None or not len(offsets) or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=type), np.zeros(len(offsets), dtype=np.int64)
    held = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]]
    return np.frombuffer(held.tobytes(), dtype=type), (offsets - offsets[0]) // size


class _Documents:
    """Documents of one batch of the index."""

    def __init__(self, batch: pa.RecordBatch, documents: int, total: int):
        ids = batch.column("doc_id")
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.id = ids.fill_null(0).to_numpy()
        self.m = _lengths(batch.column("n").to_numpy(), documents, total)
        self.sketch, self.sketch_at = _flat(batch.column("sketch"), np.uint8)
        self.terms, self.term_at = _flat(batch.column("terms"), _U64)
        self.counts, _ = _flat(batch.column("counts"), np.uint32)
        self.width = np.diff(self.sketch_at) // SKETCH_ROWS

    def __len__(self) -> int:
        return len(self.id)

    def bounds(self, queries: _Batch, first: int, last: int) -> np.ndarray:
        """Upper bounds of the scores, a row per query and a column per document."""
        out = np.zeros((len(queries.numbers), last - first), dtype=np.int64)
        for at in range(first, last, BOUND_DOCS):
            end = min(at + BOUND_DOCS, last)
            widths, least = self.width[at:end][None, :], None
            for row in range(SKETCH_ROWS):
                place = _coordinates(queries.terms[:, None], widths, row)
                place += (self.sketch_at[at:end] + row * self.width[at:end])[None, :]
                here = self.sketch[place]
                least = here if least is None else np.minimum(least, here)
            weighed = least[queries.of].astype(np.int64) * queries.weight[:, None]
            out[:, at - first:end - first] = np.add.reduceat(weighed, queries.starts[:-1])
        return out * STEP

    def scores(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of some documents: a binary search for each term in each of them."""
        low = np.broadcast_to(self.term_at[rows][:, None], (len(rows), len(terms))).copy()
        end = np.broadcast_to(self.term_at[rows + 1][:, None], low.shape)
        high = end.copy()
        last = len(self.terms) - 1
        for _ in range(int((self.term_at[rows + 1] - self.term_at[rows]).max()).bit_length()):
            middle = (low + high) >> 1
            less = (middle < high) & (self.terms[np.minimum(middle, last)] < terms[None, :])
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        at = np.minimum(low, last)
        found = (low < end) & (self.terms[at] == terms[None, :])
        counts = np.where(found, self.counts[at], 0).astype(np.int64)
        return (_impacts(counts, self.m[rows][:, None]) * weights[None, :]).sum(1)


def _searcher(queries: _Batch, documents: int, total: int, k: int, floors: dict[int, int]):
    """The best ``k`` documents of a task for every query, those under its floor left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Scores, ids and whether the id is null, in rank order.
        empty = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool))
        best = [empty] * len(queries.numbers)
        for batch in batches:
            docs = _Documents(batch, documents, total)
            for first in range(0, len(docs) if len(queries.numbers) else 0, SORT_DOCS):
                last = min(first + SORT_DOCS, len(docs))
                bounds = docs.bounds(queries, first, last)
                for q, number in enumerate(queries.numbers):
                    best[q] = _better(best[q], docs, first, bounds[q], queries, q, k,
                                      max(floors.get(number, 1), 1))
        for q, number in enumerate(queries.numbers):
            scores, ids, null = best[q]
            if len(scores):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(scores), number, dtype=np.int32)),
                    pa.array(ids, mask=null), pa.array(scores)], ["query", "doc_id", "score"])

    return run


def _better(best, docs: _Documents, first: int, bounds: np.ndarray, queries: _Batch, q: int,
            k: int, floor: int):
    """The ``k`` best of those held and of some documents with these bounds."""
    least = max(floor, int(best[0][-1])) if len(best[0]) == k else floor
    maybe = np.flatnonzero(bounds >= least)
    if not len(maybe):
        return best
    maybe = maybe[np.argsort(-bounds[maybe], kind="stable")]
    own = slice(queries.starts[q], queries.starts[q + 1])
    terms, weights = queries.terms[queries.of[own]], queries.weight[own]
    for at in range(0, len(maybe), SCORE_DOCS):
        rows = maybe[at:at + SCORE_DOCS]
        rows = rows[bounds[rows] >= least]
        if not len(rows):
            break
        rows = rows + first
        scores = docs.scores(rows, terms, weights)
        good = scores >= least
        rows, scores = rows[good], scores[good]
        joined = [np.concatenate(x) for x in zip(best, (scores, docs.id[rows], docs.null[rows]))]
        order = np.lexsort((joined[1], joined[2], -joined[0]))[:k]
        best = tuple(x[order] for x in joined)
        if len(best[0]) == k:
            least = max(floor, int(best[0][-1]))
    return best
