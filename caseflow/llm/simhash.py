"""SimHash near-duplicates: fingerprints compared bit plane by bit plane."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from caseflow.llm.components import connected_components
from caseflow.llm.tables import keeps_names, need, others, saved
from caseflow.llm.words import BLANKS, Piece, pieces

SHINGLE, RADIUS, SEED = 4, 4, 42
# Most fingerprints of one bucket that are compared in one block; a larger bucket is
# compared block against block.
BLOCK = 2048
# Rows whose whole buckets are compared together, and planes between looks at the radius.
LANES = 1 << 15
LOOK = 8
# Hash values whose bits are counted at once.
COUNTED = 1 << 16


def _fingerprint(hashes: np.ndarray) -> int:
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), COUNTED):
        some = hashes[at : at + COUNTED]
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(piece: Piece, shingle: int) -> Iterator[int]:
    # The words of the piece, each followed by one space.
    lengths = piece.ends - piece.starts
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    joined = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, dtype=np.uint8)
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    joined[place + np.repeat(starts, lengths)] = piece.bytes[
        place + np.repeat(piece.starts, lengths)]
    data = joined.tobytes()
    last = 0
    for words in piece.counts().tolist():
        first, last = last, last + words
        if not words:
            yield 0
            continue
        width = min(shingle, words)
        bounds = zip(starts[first : last - width + 1].tolist(),
                     ends[first + width - 1 : last].tolist())
        hashed = (xxh64_intdigest(data[a:b], SEED) for a, b in bounds)
        yield _fingerprint(np.fromiter(hashed, np.uint64, words - width + 1))


@keeps_names
def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE,
                 name: str = "fingerprint") -> DataFrame:
    """The rows without ``text`` but with their 64-bit SimHash, a long.

    Words are runs of anything but ASCII blanks, A-Z lower-cased; every shingle counts as
    often as it occurs, and a bit is set that is set in over half the shingles' XXH64. A
    text of fewer words is one shingle; one without words, or null, has fingerprint zero.
    A column called like the result is replaced.
    """
    need(docs, text)
    rest = docs.select(*others(docs, text, name))
    schema = T.StructType([*rest.schema.fields, T.StructField(name, T.LongType())])
    docs = docs.select(*rest.columns, F.col(text).alias("_text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [value for piece in pieces(batch.column(batch.num_columns - 1), BLANKS)
                     for value in _fingerprints(piece, shingle)]
            columns = [*batch.columns[:-1], pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(hashed, schema)


def _radius_mask(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count, given by its binary digits, is over ``radius``."""
    over = np.zeros_like(counters[0])
    equal = ~over
    for digit in range(len(counters) - 1, -1, -1):
        if radius >> digit & 1:
            equal &= counters[digit]
        else:
            over |= equal & counters[digit]
            equal &= ~counters[digit]
    return over


def close_pairs(planes: np.ndarray, shift: int, lanes: np.ndarray, radius: int) -> np.ndarray:
    """Lanes i of ``lanes`` whose fingerprint is within ``radius`` of that of i + shift.

    ``planes`` holds one row of 64-lane words per fingerprint bit, with a margin of zeros
    long enough for the shift. Each pair of planes goes through a full adder into binary
    counters that 64 lanes share; words in which every lane is past the radius are left.
    """
    wanted = np.zeros(planes.shape[1] * 64, dtype=np.uint8)
    wanted[lanes] = 1
    alive = np.packbits(wanted, bitorder="little").view(np.uint64)
    at = np.flatnonzero(alive)
    alive = alive[at]
    skip, turn = shift >> 6, np.uint64(shift & 63)
    back = np.uint64(64) - turn
    counters = [np.zeros_like(alive) for _ in range(8)]
    for bit in range(0, 64, 2):
        one, two = planes[bit], planes[bit + 1]
        if turn:
            a = one[at] ^ (one[at + skip] >> turn | one[at + skip + 1] << back)
            b = two[at] ^ (two[at + skip] >> turn | two[at + skip + 1] << back)
        else:
            a, b = one[at] ^ one[at + skip], two[at] ^ two[at + skip]
        half = counters[0] ^ a
        carry = counters[0] & a | half & b
        counters[0] = half ^ b
        for digit in range(1, (bit + 2).bit_length()):
            counters[digit], carry = counters[digit] ^ carry, counters[digit] & carry
        if (bit + 2) % LOOK == 0:
            alive &= ~_radius_mask(counters, radius)
            kept = np.flatnonzero(alive)
            if not len(kept):
                return kept
            if len(kept) < len(alive):
                at, alive = at[kept], alive[kept]
                counters = [c[kept] for c in counters]
    bits = np.unpackbits(alive.view(np.uint8), bitorder="little").reshape(-1, 64)
    word, lane = np.nonzero(bits)
    return at[word] * 64 + lane


def block_links(bucket: np.ndarray, values: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by bucket, each row's representative among those linked to it.

    Rows i and i + 1, then i and i + 2 and so on are compared for all buckets at once.
    Rows that are already linked are not compared again, so that a dense group costs
    little more than its number of rows.
    """
    rows = len(values)
    root = np.arange(rows)
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    longest = int(np.diff(edge).max())
    left = np.repeat(edge[1:], np.diff(edge)) - np.arange(rows)  # rows up to the bucket's end
    words = (rows + 63) // 64 + (longest >> 6) + 2
    bits = np.zeros((64, words * 64), dtype=np.uint8)
    bits[:, :rows] = np.unpackbits(
        values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    planes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    lanes = np.arange(rows)
    for shift in range(1, longest):
        lanes = lanes[left[lanes] > shift]
        open_lanes = lanes[root[lanes] != root[lanes + shift]]
        if not len(open_lanes):
            continue
        found = close_pairs(planes, shift, open_lanes, radius)
        for a, b in zip(found.tolist(), (found + shift).tolist()):
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(found):
            while (higher := root[root]).tobytes() != root.tobytes():
                root = higher
    return root


def _blocks(radius: int, spare: int) -> list[int]:
    """Masks that cover the 64 bits, one for each choice of ``spare`` of radius + spare
    blocks: two fingerprints within the radius agree on one of them at least."""
    count = radius + spare
    bounds = [64 * i // count for i in range(count + 1)]
    part = [(1 << bounds[i + 1]) - (1 << bounds[i]) for i in range(count)]
    masks = [sum(part[i] for i in chosen) for chosen in combinations(range(count), spare)]
    return [mask - (1 << 64) if mask >> 63 else mask for mask in masks]


def near_links(prints: DataFrame, name: str = "fingerprint", radius: int = RADIUS,
               block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join all fingerprints within ``radius`` bits of each other.

    ``prints`` has distinct fingerprints. Each is filed under every choice of blocks of
    its bits, so that two within the radius share a bucket; buckets of more than ``block``
    fingerprints are cut by a hash and compared part against part, each pair of parts in a
    group of its own. Within a bucket pairs are found bit-sliced, and only the links of a
    spanning forest leave it.
    """
    rows = prints.count()
    spare = 2 if rows < 1 << 27 else 3 if rows < 1 << 33 else 4
    masks = [F.struct(F.lit(i).alias("i"), F.lit(mask).alias("mask"))
             for i, mask in enumerate(_blocks(radius, spare))]
    filed = prints.select(F.col(name).alias("value"), F.explode(F.array(*masks)).alias("of"))
    bucket = F.xxhash64(F.col("of.i"), F.col("value").bitwiseAND(F.col("of.mask")))
    filed = filed.select(bucket.alias("bucket"), "value")
    large = filed.groupBy("bucket").count().where(F.col("count") > block)
    large = saved(large.select("bucket", F.ceil(F.col("count") / block).alias("parts")))
    if large.isEmpty():
        tiles = filed
    else:
        if large.count() < 100_000:
            large = F.broadcast(large)
        own = F.pmod(F.xxhash64("value", F.lit(1)), F.col("parts"))
        other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(None).cast("bigint")))
                          .otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        split = filed.join(large, "bucket", "left").select(
            "bucket", "value", own.alias("own"), other.alias("other"))
        tile = F.when(F.col("other").isNull(), F.col("bucket")).otherwise(F.xxhash64(
            "bucket", F.least("own", "other"), F.greatest("own", "other")))
        tiles = split.select(tile.alias("bucket"), "value")
    tiles = tiles.repartition("bucket").sortWithinPartitions("bucket", "value")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, values = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

        def links(upto: int) -> pa.RecordBatch:
            root = block_links(buckets[:upto], values[:upto], radius)
            moved = np.flatnonzero(root != np.arange(upto))
            pairs = [pa.array(values[moved]), pa.array(values[root[moved]])]
            return pa.RecordBatch.from_arrays(pairs, names=["a", "b"])

        for batch in batches:
            buckets = np.r_[buckets, batch.column(0).to_numpy()]
            values = np.r_[values, batch.column(1).to_numpy()]
            while len(buckets) > LANES:
                # Up to the start of the last bucket, which may go on in the next batch.
                upto = int(np.searchsorted(buckets, buckets[-1]))
                step = int(np.searchsorted(buckets, buckets[min(LANES, upto)])) if upto else 0
                if not (upto := step or upto):
                    break
                yield links(upto)
                buckets, values = buckets[upto:], values[upto:]
        if len(buckets):
            yield links(len(buckets))

    return tiles.mapInArrow(linked, "a long, b long").distinct()


def _components(docs: DataFrame, id: str, text: str, shingle: int, radius: int) -> DataFrame:
    """``_id``, ``_key`` (a hash of the text), ``_print``, the component's smallest
    fingerprint and smallest id, per row."""
    need(docs, id, text)
    rows = docs.select(F.col(id).alias("_id"), F.xxhash64(text).alias("_key"),
                       F.col(text).alias("_text"))
    rows = saved(fingerprints(rows, "_text", shingle, "_print"))
    prints = saved(rows.groupBy("_print").agg(F.min("_id").alias("_least")))
    links = near_links(prints.select("_print"), "_print", radius)
    roots = connected_components(links)
    rooted = prints.join(roots, prints["_print"] == roots["node"], "left").select(
        "_print", "_least", F.coalesce("root", "_print").alias("_root"))
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = rooted.join(least, "_root").select("_print", "_root", "component_id")
    return rows.join(named, "_print")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text",
                    shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Every row's ``id``, ``fingerprint`` (16 hex digits) and ``component_id``.

    A component is what links of at most ``radius`` differing bits join, and its id the
    smallest ``id`` in it. Repeated rows come out as often as they go in; a null id takes
    no part in the smallest, and the component id is null if there is no other. Texts
    without words, null ones included, have fingerprint zero and are linked like any
    other. Whatever columns ``docs`` has besides are left aside. An empty table gives an
    empty result.
    """
    digits = F.lpad(F.lower(F.hex("_print")), 16, "0").alias("fingerprint")
    return _components(docs, id, text, shingle, radius).select(
        F.col("_id").alias(id), digits, "component_id")


@keeps_names
def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text",
                         shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of every component: that with the component's smallest ``id``.

    Of rows that repeat an id the one with the smallest hash of its text stays, in each
    component by itself. A component in which no row has an id keeps one row, chosen likewise.
    """
    found = _components(docs, id, text, shingle, radius)
    row = F.struct(F.col("_id").isNull().alias("nameless"), "_id", "_key")
    chosen = found.groupBy("_root").agg(F.min(row).alias("_row")).select(
        F.col("_row._id").alias("_least_id"), F.col("_row._key").alias("_least_key"))
    rows = docs.withColumn("_key", F.xxhash64(text))
    rows = rows.join(chosen, F.col(id).eqNullSafe(F.col("_least_id"))
                     & (F.col("_key") == F.col("_least_key")), "left_semi")
    order = F.row_number().over(Window.partitionBy(id, "_key").orderBy("_key"))
    return rows.withColumn("_row", order).where("_row = 1").select(*docs.columns)
