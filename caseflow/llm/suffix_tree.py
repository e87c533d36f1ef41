"""Language-model scores from a probabilistic suffix tree over words.

Contexts are runs of up to ``depth`` words seen a number of times that does not depend on
the size of the corpus, and of these the tree keeps those whose next words differ from what
their suffix predicts. So the tree grows with the corpus. It is a table of keys and values,
counted, smoothed and pruned level by level with joins; no process holds it. Texts are
scored in blocks, each of which is sent the part of the table that its own words ask for.
Counts, keys and values are shuffled as packed arrays, one row for each part of the keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.tables import need, removed, written
from caseflow.llm.words import BLANKS, Lookup, Piece, pieces

_U64 = np.uint64
# Primes of the xxHash algorithm.
_P1, _P2, _P3 = _U64(0x9E3779B185EBCA87), _U64(0xC2B2AE3D27D4EB4F), _U64(0x165667B19E3779F9)
_P4, _P5 = _U64(0x85EBCA77C2B2AE63), _U64(0x27D4EB2F165667C5)
# Stand for the start and the end of a text among the hashes of words.
_SEED, _ADDED = _U64(42), _P5 + _U64(8)
START, END = _U64(0x53D3B4D5C3A1F2E7), _U64(0xE4D1A9B8C7F60513)
# Parts the keys of contexts from those of words.
_CONTEXT = _U64(0x8EBC6AF09C88C6E3)
# Words or runs gathered before they are counted together, and bytes of text scored together. The
# larger the block, the fewer the keys it asks for per word.
COUNTED = 1 << 21
BLOCK_BYTES = 16 << 20
# Bytes of text handled at once: arrays of their words fit into a processor's cache, and are
# not given back to the system each time.
PIECE_BYTES = 1 << 18
# Keys are dealt to parts by their first bits, about one part for so many bytes of text.
PART_BYTES = 16 << 20
# The blocks are scored in so many passes. What a pass shuffles is freed before the next one.
PASSES = 3
# Rows of the table packed together.
PACKED_ROWS = 1 << 20
# Slots of the filters that spare tasks to ask for keys that no table has. A full filter
# lets all keys through, which changes nothing but the number of rows.
FILTER_SLOTS = 1 << 26


@dataclass(frozen=True)
class Settings:
    """``least``: a context is seen this many times or more. ``own``: a next word seen this
    often after a context has a probability of its own there. ``divergence``: least
    Kullback-Leibler divergence, in nats, of a kept context from its suffix. ``weight``: how
    many observations the suffix counts as in smoothing. ``share``: on request, the least
    share of the training tokens that a context has; it bounds the tree."""

    depth: int = 3
    least: int = 32
    own: int = 2
    divergence: float = 0.01
    weight: float = 20.0
    share: float = 0.0


def _sequences(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """The texts' word hashes, START before and END after each, and each text's first place."""
    counts = piece.counts()
    first = np.cumsum(counts + 2) - (counts + 2)
    out = np.full(len(piece.starts) + 2 * piece.texts, END)
    out[first] = START
    word = np.ones(len(out), dtype=bool)
    word[first] = word[first + counts + 1] = False
    out[word] = piece.hashes()
    return out, first


def _turned(values: np.ndarray, bits: int) -> np.ndarray:
    return (values << _U64(bits)) | (values >> _U64(64 - bits))


def _taken_in(seed: np.ndarray | np.uint64, turned: np.ndarray) -> np.ndarray:
    out = (seed + _ADDED) ^ turned
    out = _turned(out, 27) * _P1 + _P4
    out = (out ^ (out >> _U64(33))) * _P2
    out = (out ^ (out >> _U64(29))) * _P3
    return out ^ (out >> _U64(32))


def _to_take(values: np.ndarray) -> np.ndarray:
    return _turned(values * _P2, 31) * _P1


def _pair(code: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Code of a run of words and the word after it: Spark's xxhash64 of both."""
    return _taken_in(_taken_in(_SEED, _to_take(code)), _to_take(word))


def _within(sequence: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How far each place is from the first one of its text."""
    return np.arange(len(sequence)) - np.repeat(first, np.diff(np.r_[first, len(sequence)]))


def _runs(sequence: np.ndarray, first: np.ndarray, longest: int) -> Iterator[tuple]:
    """Per length, the code of the run of so many words that ends at each place, and
    whether the text has so many there."""
    within = _within(sequence, first)
    code, after = sequence, _to_take(sequence[1:])
    for length in range(1, longest + 1):
        yield code, within >= length - 1
        if length < longest:
            code = np.r_[_U64(0), _taken_in(_taken_in(_SEED, _to_take(code[:-1])), after)]


def _part_bits(size: int) -> int:
    """Of a key's bits, how many tell its part, for so many bytes of text."""
    return min(int(size // PART_BYTES).bit_length(), 16)


def _packed(columns: list[np.ndarray], bits: int) -> Iterator[tuple[int, bytes]]:
    """Part and packed rows, for the parts of columns whose first one, the key, is sorted."""
    parts = np.arange(1 << bits, dtype=_U64) << _U64(64 - bits) if bits else np.zeros(1, _U64)
    bounds = np.r_[np.searchsorted(columns[0], parts), len(columns[0])]
    for part in np.flatnonzero(np.diff(bounds)):
        own = slice(bounds[part], bounds[part + 1])
        yield int(part), b"".join(c[own].astype("<u8", copy=False).tobytes() for c in columns)


def _unpacked(rows: pa.ChunkedArray, width: int) -> np.ndarray:
    """The columns of packed rows, one below the other."""
    columns = [np.frombuffer(r.as_buffer(), "<u8").reshape(width, -1) for r in rows]
    return np.concatenate([np.zeros((width, 0), dtype=_U64), *columns], axis=1)


def _new(keys: np.ndarray) -> np.ndarray:
    """Which of sorted keys differ from the one before."""
    out = np.ones(len(keys), dtype=bool)
    out[1:] = keys[1:] != keys[:-1]
    return out


def _order(keys: np.ndarray) -> np.ndarray:
    """What sorts hashes, equal ones as they come. Sorting numbers of a key's first bits and
    its place is a few times faster than np.argsort."""
    bits = _U64(max(1, len(keys).bit_length()))
    both = np.sort((keys >> bits << bits) | np.arange(len(keys), dtype=_U64))
    order = (both & ((_U64(1) << bits) - _U64(1))).astype(np.int64)
    by = keys[order]
    # Other keys with the same first bits can be out of order.
    return np.argsort(keys, kind="stable") if (by[1:] < by[:-1]).any() else order


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[_new(keys)]


def _counts(training: DataFrame, count: Callable, names: list[str], bits: int,
            least: int = 1) -> DataFrame:
    """How often the first column of what ``count`` gives for a piece's sequence has each
    value, of those it has ``least`` times. The other columns depend on the first one."""

    def packed(held: list) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held)]
        order = _order(columns[0])
        start = np.flatnonzero(_new(columns[0][order]))
        at = order[start]
        columns = [*(c[at] for c in columns), np.diff(np.r_[start, len(order)])]
        parts, rows = zip(*_packed(columns, bits)) if len(at) else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(parts, pa.int32()), pa.array(rows, pa.binary())], names=["part", "rows"])

    def flushed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for piece in pieces(batch.column(0), BLANKS, PIECE_BYTES):
                held.append(count(*_sequences(piece)))
                size += len(held[-1][0])
                if size >= COUNTED:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    def summed(rows: pa.Table) -> pa.Table:
        columns = _unpacked(rows.column("rows"), len(names))
        order = _order(columns[0])
        start = np.flatnonzero(_new(columns[0][order]))
        total = np.add.reduceat(columns[-1][order], start)
        at = order[start][total >= least]
        return pa.Table.from_batches([_longs(
            *(c[at] for c in columns[:-1]), total[total >= least], names=names)])

    return training.mapInArrow(flushed, "part int, rows binary").groupBy("part").applyInArrow(
        summed, ", ".join(f"{n} long" for n in names))


def _longs(*columns: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(c).astype(np.uint64).view(np.int64)) for c in columns], names=names)


def _filter(keys: DataFrame):
    """A broadcast bit set of the column ``key``, of fixed size."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = None
        for batch in batches:
            slot = batch.column(0).to_numpy().view(_U64) & _U64(FILTER_SLOTS - 1)
            has = np.zeros(FILTER_SLOTS, dtype=bool) if has is None else has
            has[slot.astype(np.int64)] = True
        for at in range(0, FILTER_SLOTS if has is not None else 0, FILTER_SLOTS >> 4):
            some = np.packbits(has[at : at + (FILTER_SLOTS >> 4)], bitorder="little")
            yield pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), pa.array([some.tobytes()])], names=["at", "bits"])

    def merged(rows: pa.Table) -> pa.Table:
        some = [np.frombuffer(r.as_buffer(), _U64) for r in rows.column("bits")]
        return pa.table({"at": rows.column("at")[:1],
                         "bits": [np.bitwise_or.reduce(some).tobytes()]})

    kind = "at int, bits binary"
    rows = keys.select("key").mapInArrow(bits, kind).groupBy("at").applyInArrow(merged, kind)
    out = np.zeros(FILTER_SLOTS >> 6, dtype=_U64)
    for at, some in sorted(rows.collect()):
        out[at >> 6 : (at + (FILTER_SLOTS >> 4)) >> 6] = np.frombuffer(some, _U64)
    return keys.sparkSession.sparkContext.broadcast(out)


def _may_have(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & _U64(FILTER_SLOTS - 1)
    return (bits[(slot >> _U64(6)).astype(np.int64)] >> (slot & _U64(63))) & _U64(1) > 0


def word_counts(training: DataFrame, bits: int = 0) -> DataFrame:
    """(word, tokens) over the training texts, START and END among the words."""

    return _counts(training, lambda sequence, _: [sequence], ["word", "tokens"], bits)


def _run_counts(training: DataFrame, length: int, prefixes, suffixes, least: int,
                bits: int) -> DataFrame:
    """(run, prefix, suffix, tokens) of the runs of ``length`` words that are seen ``least``
    times: codes of the whole run, of it without its last word, and of it without its first.

    Runs with another prefix or suffix than those given are left out, for being no more
    frequent than these."""

    def count(sequence: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        *_, (shorter, _) = _runs(sequence, first, length - 1)
        place = np.flatnonzero(_within(sequence, first) >= length - 1)
        place = place[_may_have(prefixes.value, shorter[place - 1])]
        place = place[_may_have(suffixes.value, shorter[place])]
        prefix = shorter[place - 1]
        return [_pair(prefix, sequence[place]), prefix, shorter[place]]

    return _counts(training, count, ["run", "prefix", "suffix", "tokens"], bits, least)


def _entries(counts: DataFrame, shorter: DataFrame, least: float, settings: Settings) -> DataFrame:
    """(run, prefix, parent, tokens, chance, above, back) of the next words with
    probabilities of their own: the run is the context, ``prefix``, and the word after it.
    ``above`` is the word's probability after the context's suffix, ``parent``."""
    own = counts.groupBy("prefix").agg(F.sum("tokens").alias("own"))
    seen = shorter.where(F.col("tokens") >= least).select(
        F.col("run").alias("prefix"), (F.col("tokens") + settings.weight).alias("of"))
    contexts = own.join(seen, "prefix").select(
        "prefix", "of", ((F.col("of") - F.col("own")) / F.col("of")).alias("back"))
    # A run is no more frequent than the same without its first word, which has an entry.
    above = shorter.select(F.col("run").alias("suffix"), F.col("prefix").alias("parent"),
                           F.col("chance").alias("above"))
    rows = counts.join(contexts, "prefix").join(above, "suffix")
    chance = F.col("tokens") / F.col("of") + F.col("back") * F.col("above")
    return rows.select("run", "prefix", "parent", "tokens", chance.alias("chance"), "above", "back")


def _divergences(entries: DataFrame) -> DataFrame:
    own = F.sum(F.col("chance") * F.log(F.col("chance") / F.col("above")))
    left = F.greatest(1 - F.sum("above"), F.lit(0.0))
    back = F.min("back")
    return entries.groupBy(F.col("prefix").alias("code")).agg(
        F.min("parent").alias("parent"), back.alias("back"),
        (own + left * back * F.log(back)).alias("divergence"))


@dataclass
class Model:
    """``words``: (word, tokens). ``contexts``: (level, code, parent, back) of those kept.
    ``entries``: (prefix, run, chance) of next words, also of contexts that are not kept.
    ``tokens`` and ``distinct`` count the training tokens and words. ``folders`` hold what
    contexts and entries are read from."""

    words: DataFrame
    contexts: DataFrame
    entries: DataFrame
    tokens: int
    distinct: int
    folders: list[str] = field(default_factory=list)

    @property
    def base(self) -> float:
        """What a word's count and a half are divided by."""
        return self.tokens + 0.5 * (self.distinct + 1)

    def table(self) -> DataFrame:
        """(key, value, context): counts of words, back-off logarithms of contexts, and
        logarithms of entries' probabilities, these with the key of their context."""
        none = F.lit(None).cast("long")
        return self.words.select(
            F.col("word").alias("key"), F.col("tokens").cast("double").alias("value"),
            none.alias("context")).union(
            self.contexts.select(_context_key("code"), F.log10("back"), none)).union(
            self.entries.select("run", F.log10("chance"), _context_key("prefix")))


def _context_key(code: str) -> Column:
    return F.col(code).bitwiseXOR(F.lit(int(_CONTEXT.view(np.int64))))


def learn(training: DataFrame, settings: Settings = Settings(), size: int | None = None) -> Model:
    """The model of a DataFrame whose first column is the text. ``size`` is about the number
    of its bytes, where that is known."""
    start = F.col("word") == F.lit(int(START.view(np.int64)))
    if size is None:
        size = training.agg(F.sum(F.octet_length(training.columns[0]))).first()[0] or 0
    bits = _part_bits(size)
    counts, _ = written(word_counts(training, bits))
    tokens, distinct = counts.where(~start).agg(F.sum("tokens"), F.count("*")).first()
    tokens = tokens or 0
    model = Model(counts.where(~start), None, None, tokens, distinct)
    least = max(settings.least, settings.share * tokens)
    shorter = counts.select(
        F.col("word").alias("run"), F.lit(None).cast("long").alias("prefix"), "tokens",
        ((F.col("tokens") + 0.5) / model.base).alias("chance"))
    levels = []
    for level in range(1, settings.depth + 1):
        keys = shorter.select(F.col("run").alias("key"), "tokens")
        prefixes, suffixes = (_filter(keys.where(F.col("tokens") >= n)) for n in (least, settings.own))
        runs, counted = written(_run_counts(
            training, level + 1, prefixes, suffixes, settings.own, bits))
        entries, kept_in = written(_entries(runs, shorter, least, settings))
        removed(runs, [counted])
        stats, stats_in = written(_divergences(entries))
        model.folders += [kept_in, stats_in]
        levels.append((level, entries, stats))
        shorter = entries
    contexts, kept, longer = None, None, None
    for level, entries, stats in reversed(levels):
        keep = F.col("divergence") >= settings.divergence
        if longer is not None:  # the suffixes of a kept context are kept
            suffixes = longer.select(F.col("parent").alias("code"), F.lit(True).alias(
                "_longer")).distinct()
            stats, keep = stats.join(suffixes, "code", "left"), keep | F.col("_longer").isNotNull()
        longer = stats.where(keep).select(F.lit(level).alias("level"), "code", "parent", "back")
        own = entries.select("prefix", "run", "chance")
        contexts = longer if contexts is None else contexts.union(longer)
        kept = own if kept is None else kept.union(own)
    model.contexts, model.entries = contexts, kept
    return model


class Answers:
    """Values of the keys asked for; nan where the table has none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = _order(keys)
        self.keys, self.values = keys[order], values[order]
        # Sorted keys that share their first bits lie from one of these places to the next.
        bits = max(8, len(keys).bit_length())
        self.shift = _U64(64 - bits)
        counts = np.bincount((self.keys >> self.shift).astype(np.int64), minlength=1 << bits)
        self.first = np.r_[0, np.cumsum(counts)].astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), np.nan)
        slot = (keys >> self.shift).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            found = self.keys[at] == keys[left]
            out[left[found]] = self.values[at[found]]
            more = ~found & (at + 1 < end)
            left, at, end = left[more], at[more] + 1, end[more]
        return out

    def log_chance(self, codes: list[np.ndarray], runs: list[np.ndarray],
                   known: list[np.ndarray], base: np.ndarray) -> np.ndarray:
        """log10 of words' probabilities after contexts, whose ``codes`` are given level by
        level where they are ``known``, with those of the ``runs`` of both: that of the
        longest one with an entry, times the back-off of those longer."""
        out, left = np.zeros(len(base)), np.ones(len(base), dtype=bool)
        at, kept = np.arange(len(base)), []
        for code, some in zip(codes, known):
            # The suffixes of a kept context are kept.
            at = at[some[at]]
            back = self.find(code[at] ^ _CONTEXT)
            has = ~np.isnan(back)
            at, back = at[has], back[has]
            kept.append((at, back))
        for (at, back), run in zip(reversed(kept), reversed(runs)):
            # Only contexts that are kept have entries.
            own = left[at]
            at, back = at[own], back[own]
            own = self.find(run[at])
            has = ~np.isnan(own)
            out[at] += np.where(has, own, back)
            left[at[has]] = False
        out[left] += base[left]
        return out


class Tree:
    """The whole model in one process, for small corpora: contexts as numbered states, 0
    the root, and symbols, the last of which is a word never seen."""

    def __init__(self, model: Model, settings: Settings):
        self.settings = settings
        words = model.words.toArrow()
        self.symbols = np.r_[words.column("word").to_numpy().view(_U64), _U64(0)]
        self.width, self.tokens = len(self.symbols), model.tokens
        self.counts = np.r_[words.column("tokens").to_numpy(), 0]
        self.base = np.log10(self.counts + 0.5) - np.log10(model.base)
        contexts = model.contexts.orderBy("level", "code").toArrow()
        codes = contexts.column("code").to_numpy().view(_U64)
        self.codes = np.r_[_U64(0), codes]
        self.level = np.r_[0, contexts.column("level").to_numpy()]
        above = contexts.column("parent").fill_null(0).to_numpy().view(_U64)
        self.parent = np.r_[0, np.where(self.level[1:] == 1, 0, Lookup(codes).find(above) + 1)]
        table = model.table().toArrow()
        self.answers = Answers(table.column("key").to_numpy().view(_U64),
                               table.column("value").to_numpy())

    def log_chance(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 of a symbol's probability in each state, smoothed towards its suffixes."""
        codes = [np.zeros(len(state), dtype=_U64) for _ in range(self.settings.depth)]
        known = [np.zeros(len(state), dtype=bool) for _ in codes]
        while state.any():
            for level in range(1, self.settings.depth + 1):
                here = self.level[state] == level
                codes[level - 1][here], known[level - 1][here] = self.codes[state[here]], True
            state = self.parent[state]
        runs = [_pair(code, self.symbols[symbol]) for code in codes]
        return self.answers.log_chance(codes, runs, known, self.base[symbol])


def fit(training: DataFrame, settings: Settings = Settings()) -> Tree:
    """``learn``, gathered into a tree; for small corpora."""
    return Tree(learn(training, settings), settings)


def _levels(sequence: np.ndarray, first: np.ndarray, depth: int) -> tuple:
    """For each place but the first, level by level, the codes of the contexts before it, of
    these with the token there, and which contexts there are; none before START."""
    every = list(_runs(sequence, first, depth + 1))
    return ([code[:-1] for code, _ in every[:-1]], [code[1:] for code, _ in every[1:]],
            [whole[1:] for _, whole in every[1:]])


def _asked(table: pa.Table, contexts: np.ndarray, others: np.ndarray, depth: int,
           bits: int) -> pa.Table:
    """The keys that a block's texts ask the model for, each once: packed, by part.
    ``contexts`` and ``others`` are filters of the keys of contexts, and of words and entries."""
    keys, size = [np.zeros(0, dtype=_U64)], 0
    for chunk in table.column("_text").chunks:
        for piece in pieces(chunk, BLANKS, PIECE_BYTES):
            sequence, first = _sequences(piece)
            codes, runs, known = _levels(sequence, first, depth)
            word, at = sequence[1:], np.arange(len(sequence) - 1)
            own = [word[_may_have(others, word)]]
            for code, run, some in zip(codes, runs, known):
                # The suffixes of a kept context are kept.
                at = at[some[at]]
                at = at[_may_have(contexts, code[at] ^ _CONTEXT)]
                own += [code[at] ^ _CONTEXT, run[at][_may_have(others, run[at])]]
            keys.append(_distinct(np.concatenate(own)))
            size += len(keys[-1])
            if size > 2 * COUNTED:
                keys = [_distinct(np.concatenate(keys))]
                size = 0
    parts = list(_packed([_distinct(np.concatenate(keys))], bits))
    block = np.full(len(parts), table.column("_block")[0].as_py(), dtype=np.int64)
    return pa.table({"_block": block, "_part": pa.array([p for p, _ in parts], pa.int32()),
                     "_rows": pa.array([r for _, r in parts], pa.binary())})


def _answered(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Keys and values that the part of the table has of those asked for, packed, by block."""
    keys, values = _unpacked(known.column("_rows"), 2)
    order = _order(keys)
    keys, values, rows = keys[order], values[order], []
    for wanted in asked.column("_rows"):
        wanted = np.frombuffer(wanted.as_buffer(), "<u8")
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        found = keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool)
        rows.append(wanted[found].tobytes() + values[at[found]].tobytes())
    return pa.table({"_block": asked.column("_block"), "_rows": pa.array(rows, pa.binary())})


def _table(known: DataFrame, contexts, bits: int) -> DataFrame:
    """(_part, _rows) of (key, value, context): the keys and the values' bits, packed, by part.
    Entries of contexts that are not among ``contexts``, a filter, are left out."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            keys, values, context = batch.columns
            own = _may_have(contexts.value, context.fill_null(0).to_numpy().view(_U64))
            own |= context.is_null().to_numpy(zero_copy_only=False)
            held.append([keys.to_numpy().view(_U64)[own], values.to_numpy().view(_U64)[own]])
            size += len(held[-1][0])
            if size >= PACKED_ROWS:
                yield from sent(held)
                held, size = [], 0
        yield from sent(held)

    def sent(held: list) -> Iterator[pa.RecordBatch]:
        if held:
            keys, values = map(np.concatenate, zip(*held))
            order = _order(keys)
            for part, rows in _packed([keys[order], values[order]], bits):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([rows], pa.binary())],
                    names=["_part", "_rows"])

    return known.mapInArrow(packed, "_part int, _rows binary")


def _scored(rows: pa.Table, answers: pa.Table, log_base: float, depth: int,
            names: list[str]) -> pa.Table:
    """Per text its numbers of tokens and of known ones, base score and score."""
    keys, values = _unpacked(answers.column("_rows"), 2)
    answers = Answers(keys, values.view(np.float64))
    totals = []
    for chunk in rows.column("_text").chunks:
        for piece in pieces(chunk, BLANKS, PIECE_BYTES):
            sequence, first = _sequences(piece)
            codes, runs, known = _levels(sequence, first, depth)
            counts, word = piece.counts() + 1, sequence[1:]
            of = np.repeat(np.arange(piece.texts), counts + 1)[1:]
            seen = np.nan_to_num(answers.find(word))
            base = np.where(word == START, 0.0, np.log10(seen + 0.5) - log_base)
            chance = answers.log_chance(codes, runs, known, base)
            totals.append([counts, *(np.bincount(of, v, minlength=piece.texts)
                                     for v in (seen > 0, base, chance))])
    tokens, known, base, score = [np.concatenate(c) for c in zip(*totals)]
    return pa.table([rows.column("_id"), rows.column("_copies"), tokens.astype(np.int64),
                     known.astype(np.int64), base, score], names=names)


def score(docs: DataFrame, training: Column, id: str = "doc_id", text: str = "text",
          settings: Settings = Settings()) -> DataFrame:
    """Every row's ``id``, token counts, unigram score and log10 probability in the tree.

    Tokens are words, runs of anything but ASCII blanks with A-Z lower-cased, and one end.
    The texts for which ``training`` holds are learnt from. ``n_known`` counts tokens that
    training has, ``train_tokens`` is the number of training tokens. ``base_score`` sums
    log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens. ``score`` is a probability under
    the tree, whose root is that of ``base_score``; unseen words together take the share of
    one never counted.

    Null texts count as empty: one token, the end. Rows that are equal in id and text are
    scored alike, each in a row of its own; null ids are no special case. Without training
    texts every base probability is 1. Words, contexts and next words are told apart by
    64-bit hashes.
    """
    need(docs, id, text)
    rows = docs.select(
        F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"),
        F.coalesce(training, F.lit(False)).alias("_train"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks, bits = size // BLOCK_BYTES + 1, _part_bits(size)
    model = learn(rows.where("_train").select("_text"), settings, size)
    depth, log_base = settings.depth, float(np.log10(model.base))
    kept, kept_in = written(model.contexts)
    model.contexts = kept
    contexts = _filter(kept.select(_context_key("code").alias("key")))
    others = _filter(model.words.select(F.col("word").alias("key")).union(
        model.entries.select("run")))
    known, _ = written(_table(model.table(), contexts, bits))
    removed(kept, [*model.folders, kept_in])
    # Equal rows are scored once, so that no block gathers many of them.
    rows = rows.select("_id", "_text", F.xxhash64("_id", "_text").alias("_key"))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_key"), F.lit(blocks)))
    schema = T.StructType([
        docs.select(F.col(id).alias("_id")).schema["_id"], T.StructField("_copies", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def scored(some: DataFrame) -> DataFrame:
        some = some.repartition("_block").groupBy("_block", "_id", "_key").agg(
            F.first("_text").alias("_text"), F.count("*").alias("_copies"))
        asked = some.groupBy("_block").applyInArrow(
            lambda block: _asked(block, contexts.value, others.value, depth, bits),
            "_block long, _part int, _rows binary")
        answers = asked.groupBy("_part").cogroup(known.groupBy("_part")).applyInArrow(
            _answered, "_block long, _rows binary")
        return some.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(
            lambda block, found: _scored(block, found, log_base, depth, schema.names), schema)

    passes = min(PASSES, blocks)
    parts = [scored(rows.where(F.pmod("_block", F.lit(passes)) == n)) for n in range(passes)]
    out = reduce(DataFrame.union, [written(part)[0] for part in parts])
    return out.select(
        F.col("_id").alias(id), "n_tokens", "n_known",
        F.lit(int(model.tokens)).cast("long").alias("train_tokens"), "base_score", "score",
        F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).drop("_copy")
