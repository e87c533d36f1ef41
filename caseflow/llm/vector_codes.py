"""Product codes of vectors, learnt by Lloyd rounds whose members stay where they are.

Vectors are cut into equal consecutive parts, and every position has a codebook of its
own. A part lives with its owner, which is its position, its entry and a salt: a table dealt
out by these three. A round reads the tables as they lie; an owner sums the members that
stay with it, and only the parts whose nearest entry is another one go into the next
shuffle, which writes them as a table of their new owners. So the vectors are dealt out
once, and later rounds move what changes entry.

All arithmetic is on integers and exact, so the result does not depend on the order of
rows, on tasks, or on a task that is run again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.tables import handed_on, need, others

# Parts that one owner should hold; entries with more are spread over several salts.
OWNER_PARTS = 1 << 16
# Parts compared with a codebook at once.
BATCH_PARTS = 1 << 13
# Scaled components must be smaller than this, so that sums of 10^11 rows fit a decimal.
LIMIT = 1 << 62
# Doubles hold every whole number up to this one.
_EXACT = 1 << 53

_MEMBERS = "position int, entry int, salt int, part array<bigint>"
_MOVED = _MEMBERS + ", sums array<decimal(38,0)>, members bigint"


@dataclass(frozen=True)
class Codebooks:
    """``entries[position][entry]`` holds whole numbers; a component counts ``scale`` times."""

    entries: tuple[np.ndarray, ...]
    scale: int

    @property
    def positions(self) -> int:
        return len(self.entries)

    @property
    def dimension(self) -> int:
        return sum(book.shape[1] for book in self.entries)

    def sha256(self) -> str:
        """Digest of all components in decimal, by part, entry and place, comma-joined."""
        numbers = (str(int(x)) for book in self.entries for entry in book for x in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part, the lower one of equals, and its squared distance.

    Exact: in doubles where every sum stays a whole number that a double holds, and with
    unbounded integers otherwise.
    """
    most = max((int(np.abs(a).max()) if a.size else 0) for a in (parts, book))
    if parts.shape[1] * (2 * most) ** 2 < _EXACT:
        at, of = parts.astype(np.float64), book.astype(np.float64)
        away = (at * at).sum(1)[:, None] - 2.0 * (at @ of.T) + (of * of).sum(1)[None, :]
        index = away.argmin(1)
        return index, away[np.arange(len(at)), index].astype(np.int64)
    # Python's integers, one entry at a time.
    wide = parts.astype(object)
    index, least = np.zeros(len(parts), dtype=np.int64), None
    for number, entry in enumerate(book.astype(object)):
        away = ((wide - entry) ** 2).sum(1)
        if least is None:
            least = away
        else:
            closer = (away < least).astype(bool)
            index[closer], least[closer] = number, away[closer]
    return index, least


def whole_vectors(rows: DataFrame, parts: int, scale: int, id: str = "vec_id",
                  vector: str = "embedding") -> DataFrame:
    """The rows that can be coded, with ``_values``, the floors of the scaled components.

    A vector takes part if it has a positive multiple of ``parts`` components, all of them
    there and finite, with scaled values smaller than 2^62. Columns of the names ``_scaled``
    and ``_values`` are replaced.
    """
    need(rows, id, vector)
    scaled = F.transform(F.col(vector).cast("array<double>"), lambda x: x * float(scale))
    held = F.forall("_scaled", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(LIMIT)))
    fits = (F.size("_scaled") > 0) & (F.pmod(F.size("_scaled"), F.lit(parts)) == 0)
    return rows.withColumn("_scaled", scaled).where(fits & held).withColumn(
        "_values", F.transform("_scaled", lambda x: F.floor(x).cast("long"))).drop("_scaled")


def train(whole: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6,
          scale: int = 4096, id: str = "vec_id") -> Codebooks | None:
    """Codebooks of the rows of ``whole_vectors``; None if there are none.

    The first codebooks are the parts of the ``entries`` rows of smallest id (null last,
    rows of one id by their values). Each round gives every part to its nearest entry, the
    lower one of equals, and replaces each entry by the floors of its members' means; an
    entry without members stays. Rows whose vector is not as long as that of the smallest
    id take no part. Equal vectors are as many members. To the driver come the codebooks'
    sums, ``entries`` times the dimension in number, whatever the rows.
    """
    order = [F.col(id).asc_nulls_last(), F.col("_values").asc()]
    seeds = [r[0] for r in whole.orderBy(*order).limit(entries).select("_values").collect()]
    if not seeds:
        return None
    dimension = len(seeds[0])
    firsts = np.array([s for s in seeds if len(s) == dimension], dtype=np.int64)
    books = [tuple(np.split(firsts, parts, axis=1))]

    vectors = whole.where(F.size("_values") == dimension).select("_values")
    salts = _salts(vectors, parts, entries)
    # tables[j] holds the parts that came to their owner under codebooks j.
    placed = vectors.mapInArrow(_placing(books[0], salts), _MEMBERS)
    tables = [handed_on(placed.repartition("position", "entry", "salt"))]
    sums = _sums(tables[0].select("position", "entry", F.expr(
        "transform(part, x -> cast(x AS decimal(38,0)))").alias("sums"),
        F.lit(1).cast("long").alias("members")))
    for _ in range(1, rounds):
        books.append(_means(books[-1], sums))
        steps = [table.mapInArrow(_settling(books, came, salts), _MOVED)
                 for came, table in enumerate(tables)]
        both = steps[0]
        for step in steps[1:]:
            both = both.unionAll(step)
        # Movers and the sums of those who stay go to the owners they belong to.
        both = handed_on(both.repartition("position", "entry", "salt"))
        tables.append(both.where("part IS NOT NULL").select(*_names(_MEMBERS)))
        sums = _sums(both.select("position", "entry", F.expr(
            "coalesce(sums, transform(part, x -> cast(x AS decimal(38,0))))").alias("sums"),
            "members"))
    if rounds:
        books.append(_means(books[-1], sums))
    return Codebooks(books[-1], scale)


def encode(whole: DataFrame, books: Codebooks) -> DataFrame:
    """Adds ``code``, two hex digits per part, and ``error``, the squared distances to the
    chosen entries summed over parts (null beyond a long). Leaves out vectors of another
    length than the codebooks'."""
    kept = others(whole, "_values", "code", "error")
    schema = T.StructType([*[whole.schema[c] for c in kept],
                           T.StructField("code", T.StringType()),
                           T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_PARTS):
                piece = batch.slice(at, BATCH_PARTS)
                values = _matrix(piece.column("_values"), books.dimension)
                codes = np.empty((len(values), books.positions), dtype=np.uint8)
                error = np.zeros(len(values), dtype=object)
                start = 0
                for position, book in enumerate(books.entries):
                    part = values[:, start:start + book.shape[1]]
                    codes[:, position], away = nearest(part, book)
                    error, start = error + away, start + book.shape[1]
                text, width = codes.tobytes().hex(), 2 * books.positions
                out = [piece.column(c) for c in kept]
                out.append(pa.array([text[i * width:(i + 1) * width] for i in range(len(values))],
                                    pa.string()))
                out.append(pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64()))
                yield pa.RecordBatch.from_arrays(out, [*kept, "code", "error"])

    rows = whole.where(F.size("_values") == books.dimension)
    return rows.select(*kept, "_values").mapInArrow(run, schema)


def coded(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6,
          scale: int = 4096, id: str = "vec_id", label: str = "label",
          vector: str = "embedding") -> DataFrame:
    """Every vector that can be coded, by codebooks learnt from all of them: the id, ``code``,
    ``error``, ``label_error`` (the errors of all rows of that label together, null labels
    being one, null beyond a long) and ``codebooks_sha256``.

    Vectors that are null, or hold null or non-finite components, or have no length that
    can be cut into ``parts``, take no part, and give no row. Repeated ids and rows are rows
    of their own. An empty table gives no rows. Other columns do not matter.
    """
    if parts < 1 or not 1 <= entries <= 256 or rounds < 0:
        raise ValueError("parts must be positive, entries 1 to 256, rounds not negative")
    need(rows, id, label, vector)
    whole = whole_vectors(rows.select(F.col(id).alias("vec_id"), F.col(label).alias("label"),
                                      F.col(vector).alias("embedding")), parts, scale)
    whole = handed_on(whole.select("vec_id", "label", "_values"))
    books = train(whole, parts, entries, rounds, scale)
    if books is None:
        return whole.select(F.col("vec_id").alias(id), F.lit("").alias("code"),
                            F.lit(0).cast("long").alias("error"),
                            F.lit(0).cast("long").alias("label_error"),
                            F.lit("").alias("codebooks_sha256"))
    out = handed_on(encode(whole, books))
    by_label = out.groupBy(F.col("label").alias("_label")).agg(
        F.try_sum("error").alias("label_error"))
    joined = out.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select(F.col("vec_id").alias(id), "code", "error", "label_error",
                         F.lit(books.sha256()).alias("codebooks_sha256"))


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _salts(vectors: DataFrame, parts: int, entries: int) -> int:
    """Salts of each entry: enough that even one that holds all parts of its position is
    spread, over every partition of the next shuffle and into pieces of a bounded size."""
    rows = vectors.count()
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(partitions, rows), -(-rows // OWNER_PARTS))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.int64, copy=False).reshape(len(column), width)


def _lists(values: np.ndarray, type: pa.DataType = pa.int64()) -> pa.Array:
    rows, width = values.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * np.int32(width))
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), type))


def _salt_of(parts: np.ndarray, salts: int, first: int) -> np.ndarray:
    """Salts in turn, so that equal parts are spread as well as others."""
    return ((np.arange(len(parts)) + first) % salts).astype(np.int32)


def _placing(books: Sequence[np.ndarray], salts: int):
    """All parts of the vectors, each with its nearest entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, turn = sum(b.shape[1] for b in books), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_PARTS):
                values = _matrix(batch.column(0).slice(at, BATCH_PARTS), width)
                start = 0
                for position, book in enumerate(books):
                    part = np.ascontiguousarray(values[:, start:start + book.shape[1]])
                    start += book.shape[1]
                    entry, _ = nearest(part, book)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(part), position, dtype=np.int32)),
                        pa.array(entry.astype(np.int32)),
                        pa.array(_salt_of(part, salts, turn)), _lists(part),
                    ], _names(_MEMBERS))
                turn += len(values)

    return run


def _settling(books: Sequence[Sequence[np.ndarray]], came: int, salts: int):
    """One round over a table of parts that came to their owners under codebooks ``came``.

    A part is still with its owner if the codebooks since then kept it there. Of those, the
    ones that the newest codebooks keep are summed, and the others go out with their new
    owner. Each task gives one sum per entry it has met.
    """
    since, newest = books[came + 1:-1], books[-1]
    sums_type = pa.list_(pa.decimal128(38, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list] = {}
        turn = 0
        for batch in batches:
            positions = batch.column("position").to_numpy()
            entries = batch.column("entry").to_numpy()
            for position in np.unique(positions):
                width = newest[position].shape[1]
                mine = np.flatnonzero(positions == position)
                for at in range(0, len(mine), BATCH_PARTS):
                    rows = mine[at:at + BATCH_PARTS]
                    parts = _matrix(batch.column("part").take(pa.array(rows)), width)
                    owner = entries[rows]
                    for book in since:
                        still = nearest(parts, book[position])[0] == owner
                        parts, owner = parts[still], owner[still]
                    entry = nearest(parts, newest[position])[0].astype(np.int32)
                    stays = entry == owner
                    _add(totals, int(position), owner[stays], parts[stays])
                    moved, entry = parts[~stays], entry[~stays]
                    if len(moved):
                        turn += len(moved)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(moved), position, dtype=np.int32)),
                            pa.array(entry), pa.array(_salt_of(moved, salts, turn)),
                            _lists(moved), pa.nulls(len(moved), sums_type),
                            pa.array(np.ones(len(moved), dtype=np.int64)),
                        ], _names(_MOVED))
        if totals:
            keys = sorted(totals)
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in keys], pa.int32()),
                pa.array([k[1] for k in keys], pa.int32()),
                pa.array([0] * len(keys), pa.int32()),
                pa.nulls(len(keys), pa.list_(pa.int64())),
                pa.array([[Decimal(x) for x in totals[k][0]] for k in keys], sums_type),
                pa.array([totals[k][1] for k in keys], pa.int64()),
            ], _names(_MOVED))

    return run


def _add(totals: dict, position: int, entries: np.ndarray, parts: np.ndarray) -> None:
    """Sums of parts by entry, with integers that cannot overflow."""
    small = parts.size == 0 or int(np.abs(parts).max()) < 1 << 40
    for entry in np.unique(entries):
        mine = parts[entries == entry]
        sums = [int(x) for x in (mine if small else mine.astype(object)).sum(0)]
        held = totals.setdefault((position, int(entry)), [[0] * len(sums), 0])
        held[0] = [a + b for a, b in zip(held[0], sums)]
        held[1] += len(mine)


def _sums(members: DataFrame) -> dict[tuple[int, int], tuple[list[int], int]]:
    """Sums and numbers of all members by position and entry."""
    each = members.select("position", "entry", "members", F.posexplode("sums").alias("at", "x"))
    rows = each.groupBy("position", "entry", "at").agg(
        F.sum("x").alias("total"), F.sum("members").alias("members")).collect()
    out: dict[tuple[int, int], tuple[list[int], int]] = {}
    for r in sorted(rows, key=lambda r: (r.position, r.entry, r["at"])):
        out.setdefault((r.position, r.entry), ([], r.members))[0].append(int(r.total))
    return out


def _means(books: Sequence[np.ndarray], sums: dict) -> tuple[np.ndarray, ...]:
    fresh = [book.copy() for book in books]
    for (position, entry), (totals, members) in sums.items():
        fresh[position][entry] = [total // members for total in totals]
    return tuple(fresh)
