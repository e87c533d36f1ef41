"""Benchmark passages in documents, through a stored positional inverted index of the corpus.

The index is a table: for each segment (neighbouring texts of a few megabytes) and each word
in it the ascending positions, next to one row per document. It is partitioned by document,
so that building it shuffles nothing, and no word of a third of all text makes a hot row: a
common word has one row per segment.

Items become windows of consecutive words. The index gives each of their words its count in
the corpus, and a window's words are taken from the rarest on: positions of the rarest less
its offset, kept where the next word has a position at its own offset, and so on. Windows
are looked up in blocks of a fixed size, one job each, which shuffle by segment the postings
of that block's words and nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.tables import keeps_names, need, others, removed, written
from caseflow.llm.words import NOT_ALNUM, Piece, pieces

WINDOW = 13
# Words of a proximity match that may lie between, before or after its rarest term.
WITHIN = 26
# Words of windows that are sent to the tasks at once (about 30 bytes each).
BLOCK_WORDS = 1 << 19
# Bytes of text in a segment; a longer text is a segment of its own.
SEGMENT_BYTES = 8 << 20
# Postings of rarest words that a task looks at at once.
AT_ONCE = 1 << 20

# Stands for no word: its positions are the bounds of the segment's texts.
BOUNDS = ""

_SPAN = "struct<item:string,start:int,end:int>"
_POSTING = "_segment long, _term string, _count int, _places binary"
_DOCUMENT = "_text int, _words long"


def _spelt(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words at these places, as an Arrow column."""
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    places = np.repeat(starts - offsets[:-1], ends - starts) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(
        len(starts), pa.py_buffer(offsets), pa.py_buffer(data[places]))


def _binary(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Slices of ascending numbers, beginning at ``first``: a number and its successors' steps."""
    steps = np.diff(values, prepend=0).astype(np.int32)
    steps[first] = values[first]
    offsets = np.r_[first, len(values)] * 4
    return pa.BinaryArray.from_buffers(pa.binary(), len(first), [
        None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(steps)])


def _postings(piece: Piece, segment: int) -> pa.RecordBatch:
    """A row per distinct word of the piece, and one with the bounds of its texts."""
    words = _spelt(piece.bytes, piece.starts, piece.ends).dictionary_encode()
    terms = words.indices.to_numpy()
    counts = np.bincount(terms, minlength=len(words.dictionary))
    places = np.argsort(terms, kind="stable")
    bounds = np.r_[0, np.cumsum(piece.counts())]
    first = np.r_[np.cumsum(counts) - counts, len(places)].astype(np.int64)
    rows = len(counts) + 1
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(rows, segment)),
        pa.concat_arrays([words.dictionary, pa.array([BOUNDS])]),
        pa.array(np.r_[counts, 0].astype(np.int32)),
        _binary(np.r_[places, bounds], first)],
        names=["_segment", "_term", "_count", "_places"])


@dataclass
class Index:
    """A stored index. ``rows`` has a row per (segment, word) and one per document, told
    apart by ``_term``, which documents do not have; ``kept`` are the documents' columns."""

    rows: DataFrame
    folder: str
    kept: list[str]

    @property
    def postings(self) -> DataFrame:
        return self.rows.where("_term IS NOT NULL").select(
            "_segment", "_term", "_count", "_places")

    @property
    def documents(self) -> DataFrame:
        return self.rows.where("_term IS NULL").select(
            "_segment", "_text", "_words", *self.kept)

    def remove(self) -> None:
        """Deletes the stored rows; nothing found through them can be read after that."""
        removed(self.rows, [self.folder])


def index(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
          segment_bytes: int = SEGMENT_BYTES) -> Index:
    """Stores the positions of all words of ``docs``, and its columns ``keep`` (all if None).

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII,
    A-Z lower-cased, told apart by their bytes. Null texts have none. Every row is a document
    of its own, also where rows repeat. Column names must not begin with an underscore.
    """
    need(docs, text)
    kept = docs.columns if keep is None else keep
    need(docs, *kept)
    source = docs.select(F.col(text).alias("_indexed"), *kept)
    fields = [T.StructField(f.name, f.dataType) for f in source.schema.fields[1:]]
    schema = T.StructType([*T._parse_datatype_string(_POSTING).fields,
                           *T._parse_datatype_string(_DOCUMENT).fields, *fields])

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows are written once and read from there, so a repeated task may number anew.
        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            own = batch.columns[1:]
            for piece in pieces(batch.column(0), NOT_ALNUM, segment_bytes):
                rows = _postings(piece, segment)
                none = [pa.nulls(len(rows), kind) for kind in
                        (pa.int32(), pa.int64(), *[c.type for c in own])]
                yield pa.RecordBatch.from_arrays([*rows.columns, *none], names=schema.names)
                n = piece.texts
                documents = [
                    pa.array(np.full(n, segment)), pa.nulls(n, pa.string()),
                    pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                    pa.array(np.arange(n, dtype=np.int32)), pa.array(piece.counts()),
                    *[c.slice(piece.first, n) for c in own]]
                yield pa.RecordBatch.from_arrays(documents, names=schema.names)
                segment += 1

    return Index(*written(source.mapInArrow(indexed, schema)), kept)


def _windows(items: DataFrame, id: str, text: str, window: int) -> DataFrame:
    """Distinct (phrase, item): every ``window`` consecutive words of an item, or all of it
    if it has fewer, joined by blanks, which no word holds."""
    source = items.select(F.col(id).cast("string").alias("item"), F.col(text))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1), NOT_ALNUM):
                spelt = _spelt(piece.bytes, piece.starts, piece.ends).to_pylist()
                last = 0
                for row, words in enumerate(piece.counts().tolist()):
                    own, last = spelt[last : last + words], last + words
                    item = batch.column(0)[piece.first + row].as_py()
                    places = max(1, words - window + 1) if words else 0
                    for at in range(0, places, 4096):
                        phrases = [" ".join(own[i : i + window])
                                   for i in range(at, min(at + 4096, places))]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(phrases, pa.string()),
                             pa.array([item] * len(phrases), pa.string())],
                            names=["phrase", "item"])

    return source.mapInArrow(cut, "phrase string, item string").distinct()


def _plans(postings: DataFrame, windows: DataFrame) -> DataFrame:
    """A number and the ``steps`` (corpus count, offset, word), from the rarest word on, of
    every phrase all of whose words the corpus has."""
    phrases = windows.select("phrase").distinct()
    words = phrases.select("phrase", F.posexplode(F.split("phrase", " ")).alias("offset", "_term"))
    asked = words.select("_term").distinct()
    counts = (postings.select("_term", "_count").join(asked, "_term", "left_semi")
              .groupBy("_term").agg(F.sum("_count").alias("n")))
    steps = words.join(counts, "_term").groupBy("phrase").agg(F.array_sort(F.collect_list(
        F.struct("n", "offset", F.col("_term").alias("term")))).alias("steps"))
    whole = steps.where(F.size("steps") == F.size(F.split("phrase", " ")))
    return whole.select("phrase", F.monotonically_increasing_id().alias("window"), "steps")


@dataclass
class Block:
    """Windows looked up at once: their numbers, and row by row the words (as numbers) and
    offsets in the order they are taken, filled up with -1."""

    windows: np.ndarray
    spelling: pa.Array
    terms: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, rows: list[Row], size: int) -> Block:
        numbers: dict[str, int] = {}
        terms = np.full((len(rows), size), -1, dtype=np.int64)
        offsets = np.zeros((len(rows), size), dtype=np.int64)
        for at, row in enumerate(rows):
            for step, (_, offset, term) in enumerate(row.steps):
                terms[at, step] = numbers.setdefault(term, len(numbers))
                offsets[at, step] = offset
        windows = np.array([row.window for row in rows], dtype=np.int64)
        return cls(windows, pa.array(list(numbers), pa.string()), terms, offsets)


class Segment:
    """Postings of a block's words in one segment: ascending positions, word by word."""

    def __init__(self, rows: pa.Table, spelling: pa.Array):
        rows = rows.combine_chunks()
        term = pc.index_in(rows["_term"], spelling).fill_null(-1).to_numpy()
        order = np.argsort(term, kind="stable")
        packed = rows["_places"].take(pa.array(order)).combine_chunks().cast(pa.large_binary())
        if isinstance(packed, pa.ChunkedArray):
            packed = packed.chunk(0)
        cuts = np.frombuffer(packed.buffers()[1], dtype=np.int64)
        cuts = cuts[packed.offset : packed.offset + len(packed) + 1] // 4
        steps = np.frombuffer(packed.buffers()[2], dtype=np.int32)[cuts[0] : cuts[-1]]
        sums, cuts = np.cumsum(steps, dtype=np.int64), cuts - cuts[0]
        counts = np.diff(cuts)
        places = sums - np.repeat(np.r_[0, sums][cuts[:-1]], counts)
        # The bounds are no word of the block, so they come first.
        self.bounds, self.places = places[: cuts[1]], places[cuts[1] :]
        self.words = int(self.bounds[-1])
        self.counts = np.zeros(len(spelling), dtype=np.int64)
        self.counts[term[order[1:]]] = counts[1:]
        self.first = np.cumsum(self.counts) - self.counts
        # One sorted list of (word, position), in which any posting can be looked up.
        of = np.repeat(np.arange(len(spelling)), self.counts)
        self.keys = of * (self.words + 1) + self.places

    def text(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, places, "right") - 1

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``terms`` each posting belongs to, and its position."""
        counts = self.counts[terms]
        of = np.repeat(np.arange(len(terms)), counts)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        return of, self.places[self.first[terms[of]] + inside]

    def next_posting(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Position of the first posting of each word at or after a place, or past the end."""
        at = np.searchsorted(self.keys, terms * (self.words + 1) + places)
        found = self.keys[np.minimum(at, len(self.keys) - 1)]
        here = (at < len(self.keys)) & (found // (self.words + 1) == terms)
        return np.where(here, found % (self.words + 1), self.words + 1)

    def whole(self, block: Block) -> Iterator[np.ndarray]:
        """Rows of the block all of whose words occur here, as many at a time as have
        ``AT_ONCE`` postings of their rarest word, one row at least."""
        here = (block.terms < 0) | (self.counts[block.terms] > 0)
        rows = np.flatnonzero(here.all(axis=1))
        ends = np.cumsum(self.counts[block.terms[rows, 0]])
        at = 0
        while at < len(rows):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
            yield rows[at:to]
            at = to


def _phrases(segment: Segment, block: Block, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row of the block, first word and word past the last of every exact occurrence."""
    terms, offsets = block.terms[rows], block.offsets[rows]
    lengths = (terms >= 0).sum(axis=1)
    of, places = segment.postings(terms[:, 0])
    starts, text = places - offsets[of, 0], segment.text(places)
    ends = starts + lengths[of]
    kept = np.flatnonzero((starts >= segment.bounds[text]) & (ends <= segment.bounds[text + 1]))
    for step in range(1, terms.shape[1]):
        term, place = terms[of[kept], step], starts[kept] + offsets[of[kept], step]
        kept = kept[(term < 0) | (segment.next_posting(term, place) == place)]
        if not len(kept):
            break
    return rows[of[kept]], starts[kept], ends[kept]


def _near(segment: Segment, block: Block, rows: np.ndarray,
          within: int) -> tuple[np.ndarray, ...]:
    """Row and bounds of every place of its rarest word that has all others near it."""
    terms = block.terms[rows]
    of, places = segment.postings(terms[:, 0])
    kept, low, high = np.arange(len(of)), places.copy(), places.copy()
    for step in range(1, terms.shape[1]):
        term, place = terms[of[kept], step], places[kept]
        text = segment.text(place)
        after = segment.next_posting(term, np.maximum(place - within, segment.bounds[text]))
        near = (term < 0) | (after < np.minimum(place + within + 1, segment.bounds[text + 1]))
        after = np.where(term < 0, place, after)
        kept, after = kept[near], after[near]
        low[kept] = np.minimum(low[kept], after)
        high[kept] = np.maximum(high[kept], after)
    return rows[of[kept]], low[kept], high[kept] + 1


_HIT = pa.schema([("_segment", pa.int64()), ("_text", pa.int32()), ("window", pa.int64()),
                  ("start", pa.int32()), ("end", pa.int32())])


def _hits(postings: DataFrame, plans: DataFrame, window: int,
          within: int | None) -> tuple[DataFrame, str]:
    """Where the windows of one block occur: segment, text in it, window and its words."""
    context = postings.sparkSession.sparkContext
    sent = context.broadcast(Block.of(plans.select("window", "steps").collect(), window))
    # As many words as the block has, which its size bounds.
    asked = plans.select(F.explode("steps.term").alias("_term")).distinct()
    bounds = postings.where(F.col("_term") == BOUNDS)
    words = postings.join(F.broadcast(asked), "_term", "left_semi")

    def found(rows: pa.Table) -> pa.Table:
        if len(rows) == 1:
            return _HIT.empty_table()
        block, out = sent.value, []
        segment = Segment(rows, block.spelling)
        for some in segment.whole(block):
            at, start, end = (_phrases(segment, block, some) if within is None
                              else _near(segment, block, some, within))
            text = segment.text(start)
            base = segment.bounds[text]
            out.append(pa.table([
                pa.array(np.full(len(at), rows["_segment"][0].as_py()), pa.int64()),
                pa.array(text.astype(np.int32)), pa.array(block.windows[at]),
                pa.array((start - base).astype(np.int32)),
                pa.array((end - base).astype(np.int32))], schema=_HIT))
        return pa.concat_tables(out) if out else _HIT.empty_table()

    schema = "_segment long, _text int, window long, start int, end int"
    columns = ["_segment", "_term", "_places"]
    rows = words.select(columns).unionByName(bounds.select(columns))
    out = written(rows.groupBy("_segment").applyInArrow(found, schema))
    sent.destroy()
    return out


def _spans(hits: DataFrame, items: DataFrame, found: str) -> DataFrame:
    """Per text its (item, start, end), overlapping and touching spans of one item merged."""
    own = ["_segment", "_text", "item"]
    places = hits.join(items, "window").repartition("_segment", "_text")
    ordered = Window.partitionBy(*own).orderBy("start", "end")
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(before >= F.col("start"), 0).otherwise(1)
    run = F.sum("_begins").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    spans = (places.withColumn("_begins", begins).withColumn("_run", run)
             .groupBy(*own, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")))
    return spans.groupBy("_segment", "_text").agg(
        F.array_sort(F.collect_list(F.struct("item", "start", "end"))).alias(found))


def find(corpus: Index, items: DataFrame, item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW, within: int | None = None, words: str = "n_words",
         found: str = "matches", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents of ``corpus`` with their number of words and the places of ``items``.

    An item is looked for by every ``window`` consecutive words of it, or as a whole if it is
    shorter. ``found`` lists (item, start, end) in words. ``within`` asks for proximity in
    place of phrases: the rarest word of a window with all its other words, in any order, at
    most so many words away from it in the same text; a span then reaches from the first to
    the last found. Items of null or without words never match; an item id of null is kept as
    null. Repeated items count once, and items of one id as one. Columns named like the two
    results are replaced. One job for every ``block_words`` words of windows.
    """
    need(items, item_id, item_text)
    kept = [c for c in corpus.kept if c.lower() not in (words.lower(), found.lower())]
    windows, windows_at = written(_windows(items, item_id, item_text, window))
    plans, plans_at = written(_plans(corpus.postings, windows))
    done, size = [windows_at, plans_at], max(1, block_words // window)
    blocks = math.ceil(plans.count() / size)
    hits = []
    for number in range(blocks):
        block = plans.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == number)
        hits.append(_hits(corpus.postings, block, window, within))
        done.append(hits[-1][1])
    documents = corpus.documents
    if not hits:
        removed(documents, done)
        return documents.select(*kept, F.col("_words").alias(words),
                                F.array().cast(f"array<{_SPAN}>").alias(found))
    all_hits = documents.sparkSession.read.parquet(*[folder for _, folder in hits])
    named = plans.select("phrase", "window").join(windows, "phrase").drop("phrase")
    spans, _ = written(_spans(all_hits, named, "_found"))
    removed(documents, done)
    matched = F.coalesce("_found", F.array().cast(f"array<{_SPAN}>"))
    return documents.join(spans, ["_segment", "_text"], "left").select(
        *kept, F.col("_words").alias(words), matched.alias(found))


@keeps_names
def matches(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
            item_text: str = "text", window: int = WINDOW, within: int | None = None,
            words: str = "n_words", found: str = "matches", block_words: int = BLOCK_WORDS,
            keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the number of its words and the places where items occur in it: ``find``
    on an index made for the purpose, which stays in the checkpoint folder with the columns
    ``keep``. Empty tables give no rows, or no matches; texts of any length are whole.
    """
    kept = others(docs, words, found) if keep is None else keep
    return find(index(docs, text, kept), items, item_id, item_text, window, within, words,
                found, block_words)


def covered(found: str = "matches") -> Column:
    """How many words the spans of ``found`` cover together."""
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    bounds = F.array_sort(F.transform(found, lambda m: F.struct(m["start"], m["end"])))

    def add(so_far: Column, span: Column) -> Column:
        more = span["end"] - F.greatest(span["start"], so_far["to"])
        return F.struct((so_far["n"] + F.greatest(more, F.lit(0))).cast("long").alias("n"),
                        F.greatest(so_far["to"], span["end"]).alias("to"))

    return F.aggregate(bounds, state, add, lambda so_far: so_far["n"])


def with_contamination(found: DataFrame, share: int = 20) -> DataFrame:
    """Adds ``n_hit``, ``items`` (distinct ids, sorted as strings) and ``contaminated``: at
    least one word hit, and one in ``share`` of all words or more."""
    items = F.array_sort(F.array_distinct(F.filter(
        F.transform("matches", lambda m: m["item"]), lambda i: i.isNotNull())))
    found = found.withColumns({"n_hit": covered("matches"), "items": items})
    hit = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return found.withColumn("contaminated", hit)
