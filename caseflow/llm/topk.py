"""Exact top-k search by bounds from segment means and deviations, coarse to fine."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.tables import need

# Rows of each side in one tile of the comparison, and least number of candidate blocks.
TILE_ROWS = 16_384
LEAST_BLOCKS = 32
# Segments a vector is cut into, from coarse to fine.
LEVELS = (4, 16)
# Queries and candidates whose bounds are in memory at once.
STEP_QUERIES, STEP_ROWS = 32, 4_096
# Share of the pairs of such a step from which on all of them are computed by one product.
DENSE = 1 / 8
# Doubles hold every whole number up to this one. Products that may be larger are computed
# with integers of any size, and scores beyond a long are held at its ends.
EXACT = float(1 << 53)
MOST = (1 << 63) - 1


def quantized(df: DataFrame, vector: str, scale: float, name: str) -> DataFrame:
    """Rows whose vector is complete and finite, with floor(scale * x) of its components.

    Null vectors and those with a null, NaN or infinite component are left out, the scaled
    component counting too. A floor of a double is a whole number that a double holds: of
    those too large for a long, the double itself.
    """
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    finite = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(scaled, lambda x: F.when(
        F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))
    return df.where(F.coalesce(finite, F.lit(False))).withColumn(name, whole)


def _statistics(rows: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of a vector's segments, each times the root of its length.

    The inner product of two such rows is no less than that of the vectors: within a
    segment it is length * (mean * mean + covariance), and a covariance is at most the
    product of the deviations.
    """
    parts = np.array_split(rows, min(segments, rows.shape[1]), axis=1)
    means = [p.mean(axis=1) * p.shape[1] ** 0.5 for p in parts]
    spread = [p.std(axis=1) * p.shape[1] ** 0.5 for p in parts]
    return np.stack(means + spread, axis=1)


def _scores(queries: np.ndarray, rows: np.ndarray, l2: bool, q=None, c=None) -> np.ndarray:
    """Scores of the pairs (q, c): inner products, or negative squared distances.

    Many pairs are taken from one matrix product.
    """
    if len(q) > DENSE * len(queries) * len(rows):
        product = (queries @ rows.T)[q, c]
    else:
        product = np.einsum("ij,ij->i", queries[q], rows[c])
    if not l2:
        return product
    return 2 * product - (queries * queries).sum(axis=1)[q] - (rows * rows).sum(axis=1)[c]


def _exact(queries: np.ndarray, rows: np.ndarray, l2: bool, q: np.ndarray,
           c: np.ndarray) -> np.ndarray:
    """Scores of the pairs (q, c) of vectors of whole numbers, as longs.

    Doubles give them exactly unless the components are large; pairs of such are summed as
    Python's integers.
    """
    most = np.abs(queries).max(axis=1)[q] + np.abs(rows).max(axis=1)[c]
    with np.errstate(over="ignore", invalid="ignore"):
        small = queries.shape[1] * most * most < EXACT
        if small.all():
            return _scores(queries, rows, l2, q, c).astype(np.int64)
    out = np.zeros(len(q), dtype=np.int64)
    out[small] = _scores(queries, rows, l2, q[small], c[small]).astype(np.int64)
    for at in np.flatnonzero(~small):
        pairs = [(int(a), int(b)) for a, b in zip(queries[q[at]], rows[c[at]])]
        score = -sum((a - b) ** 2 for a, b in pairs) if l2 else sum(a * b for a, b in pairs)
        out[at] = max(-MOST + 1, min(MOST, score))
    return out


def _room(queries: np.ndarray, rows: np.ndarray) -> float:
    """What rounding may take from a bound; rows of statistics have their vectors' norms."""
    return 1e-6 + 1e-9 * float((queries * queries).sum(axis=1).max()
                               + (rows * rows).sum(axis=1).max())


class _Best:
    """The k best ids and scores of some queries so far; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), -MOST)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def take(self, q: np.ndarray, id: np.ndarray, score: np.ndarray) -> None:
        queries, k = self.score.shape
        q = np.r_[np.repeat(np.arange(queries), k), q]
        id, score = np.r_[self.id.ravel(), id], np.r_[self.score.ravel(), score]
        order = np.lexsort((id, -score, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        order, place = order[place < k], place[place < k]
        self.score[q[order], place], self.id[q[order], place] = score[order], id[order]


def tile_top_k(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray,
               k: int, l2: bool = False, levels: Sequence[int] = LEVELS):
    """(query's place, id, score) of each query's k best rows, its own id left out.

    The rows with the best coarse bounds give a first k-th best score. Rows whose bound
    stays below the k-th best are left, at the coarse level and then at each finer one;
    only for the others the exact score is computed, and the k-th best rises.
    """
    statistics = [(_statistics(queries, n), _statistics(rows, n)) for n in levels]
    found = []
    for at in range(0, len(queries), STEP_QUERIES):
        some = slice(at, at + STEP_QUERIES)
        best = _Best(len(queries[some]), k)
        for start in range(0, len(rows), STEP_ROWS):
            part = slice(start, start + STEP_ROWS)
            q, c = np.nonzero(query_ids[some][:, None] != ids[part][None, :])
            if not len(q):
                continue
            for level, (of_queries, of_rows) in enumerate(statistics):
                of_queries, of_rows = of_queries[some], of_rows[part]
                bound = _scores(of_queries, of_rows, l2, q, c) + _room(of_queries, of_rows)
                if not level and not start:
                    # The k rows of each query that look best, to have a score to beat.
                    order = np.lexsort((-bound, q))
                    place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
                    first = order[place < k]
                    score = _exact(queries[some], rows[part], l2, q[first], c[first])
                    best.take(q[first], ids[part][c[first]], score)
                    others = np.ones(len(q), dtype=bool)
                    others[first] = False
                    q, c, bound = q[others], c[others], bound[others]
                # A bound that is too large for a double leaves its pair in.
                near = ~(bound < best.score[q, -1])
                q, c = q[near], c[near]
            best.take(q, ids[part][c], _exact(queries[some], rows[part], l2, q, c))
        q, place = np.nonzero(best.score > -MOST)
        found.append((q + at, best.id[q, place], best.score[q, place]))
    return [np.concatenate(column) for column in zip(*found)]


def top_k(queries: DataFrame, rows: DataFrame, k: int, id: str = "vec_id",
          vector: str = "embedding", scale: float = 256.0, l2: bool = False,
          tile_rows: int = TILE_ROWS) -> DataFrame:
    """Each query's ``k`` best rows: query_id, rank from 1, the row's id, and score.

    Components are floor(scale * x). A score is the inner product, or with ``l2`` the
    negative squared distance; ties go to the smaller id. Rows with the query's own id are
    left out. Vectors that are null or not finite take no part, nor do rows whose id is null;
    vectors of different lengths are never compared, and empty ones score 0 with each other.
    A query id that repeats is asked, and ranked, once for each distinct vector; repeated rows
    each count. A query with fewer rows to compare has fewer results, an empty table none.
    Scores are exact whatever the components; those beyond a long are held at its ends.

    Both sides are dealt into blocks by a hash, and every query block meets every block of
    rows in a tile of its own, so that the work of a task is bounded whatever the tables'
    sizes; from a tile come k rows per query.
    """
    for side in (queries, rows):
        need(side, id, vector)
    queries = quantized(queries.where(F.col(id).isNotNull()), vector, scale, "_vector")
    rows = quantized(rows.where(F.col(id).isNotNull()), vector, scale, "_vector")
    queries = queries.select(F.col(id).cast("long").alias("id"), F.col("_vector").alias(
        "vector")).distinct()
    rows = rows.select(F.col(id).cast("long").alias("id"), F.col("_vector").alias("vector"))
    asked, there = queries.count(), rows.count()
    across, down = max(1, -(-asked // tile_rows)), max(LEAST_BLOCKS, -(-there // tile_rows))

    def dealt(side: DataFrame, query: bool) -> DataFrame:
        # Queries are distinct and dealt by what they hold, so that a repeated task deals them
        # alike. Rows go by their number as they are read, so that repeats are spread too.
        number = F.xxhash64("id", "vector") if query else F.xxhash64(
            F.monotonically_increasing_id())
        block = F.pmod(number, F.lit(across if query else down)).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.lit((down if query else across) - 1)))
        tile = side.select(F.lit(query).alias("query"), F.size("vector").alias("length"), "id",
                           "vector", F.xxhash64("vector").alias("print"), block.alias("own"),
                           others.alias("other"))
        mine, theirs = ("own", "other") if query else ("other", "own")
        return tile.select("query", "length", F.col(mine).alias("of_queries"),
                           F.col(theirs).alias("of_rows"), "id", "vector", "print")

    def compared(tile: pa.Table) -> pa.Table:
        is_query = tile.column("query").to_numpy()
        ids = tile.column("id").to_numpy()
        length = tile.column("length")[0].as_py()
        flat = tile.column("vector").combine_chunks().flatten().to_numpy()
        vectors = flat.reshape(-1, length) if length else np.zeros((len(ids), 1))
        if is_query.all() or not is_query.any():
            found = [np.zeros(0, np.int64)] * 3
        else:
            found = tile_top_k(ids[is_query], vectors[is_query], ids[~is_query],
                               vectors[~is_query], k, l2)
        prints = tile.column("print").to_numpy()[is_query]
        return pa.table({"query_id": ids[is_query][found[0]], "print": prints[found[0]],
                         "id": found[1], "score": found[2]})

    tiles = dealt(queries, True).union(dealt(rows, False))
    best = tiles.groupBy("of_queries", "of_rows", "length").applyInArrow(
        compared, "query_id long, print long, id long, score long")
    order = Window.partitionBy("query_id", "print").orderBy(F.col("score").desc(), "id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id), "score")
