"""Removal of repeated passages of lines, in chunks that the content itself bounds.

DataFrame functions only. A hash rolls over every two lines that follow each other, and is
counted over all documents. A text is cut where such a pair stands nowhere else, where it
stands in fewer places than the pair before or after it, and within what repeats where the
rolling hash is lowest among its neighbours: so a passage is cut alike wherever it stands,
and it begins and ends a chunk however short it is. The chunks are compared byte by byte
over all documents and all but the first of equal ones go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.tables import keeps_names, need, others, saved

# A line of this many words or more is a passage, and a chunk, of its own.
PASSAGE_WORDS = 50


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _words(line: Column) -> Column:
    """Words of a line, counted as blanks between them plus one."""
    trimmed = F.trim(line)
    return F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1


def _line_rows(docs: DataFrame, text: str, passage_words: int) -> DataFrame:
    """A row per line: ``_id`` and ``_key`` of the text, ``i``, the line's ``hash``, ``pair``,
    the hash rolled over it and the line before, and whether it is a ``passage``.

    The first line has no pair; a hash that also takes in the text keeps these lines apart.
    """
    def lines(parts: Column) -> Column:
        return _let(F.transform(parts, lambda line: F.xxhash64(line)), lambda hashes: F.transform(
            parts, lambda line, i: F.struct(
                F.get(hashes, i).alias("hash"),
                F.when(i > 0, F.xxhash64(F.get(hashes, i - 1), F.get(hashes, i))).otherwise(
                    F.xxhash64(F.get(hashes, i), "_key")).alias("pair"),
                (_words(line) >= passage_words).alias("passage"))))

    every = docs.select("_id", "_key", F.posexplode(
        _let(_lines(F.col(text)), lines)).alias("i", "line"))
    return every.select("_id", "_key", "i", "line.*")


def _begins(lines: Column, i: Column) -> Column:
    """Whether a chunk begins at line ``i``, which is not the first."""
    def at(name: str, place: Column) -> Column:
        return F.get(lines, place)[name]

    here, before, after = (F.coalesce(at("places", i + n), F.lit(0)) for n in (0, -1, 1))
    fewer = (here < before) | (here < after)
    lowest = (before > 1) & (after > 1) & (at("pair", i) < at("pair", i - 1)) & (
        at("pair", i) <= at("pair", i + 1))
    return at("passage", i) | at("passage", i - 1) | (here <= 1) | fewer | lowest


def _chunks(lines: Column) -> Column:
    """(begin, count, hash) of every chunk that may repeat: two lines or more, or a passage."""
    def chunks(cuts: Column) -> Column:
        def chunk(i: Column) -> Column:
            begin = F.get(cuts, i)
            count = F.get(cuts, i + 1) - begin
            return F.struct(begin.alias("begin"), count.alias("count"), F.xxhash64(F.transform(
                F.slice(lines, begin + 1, count), lambda x: x["hash"])).alias("hash"))

        every = F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), chunk)
        return F.filter(every, lambda c: (c["count"] > 1) | F.get(lines, c["begin"])["passage"])

    size = F.size(lines)
    inner = F.when(size > 1, F.filter(
        F.sequence(F.lit(1), size - 1), lambda i: _begins(lines, i)))
    none = F.array().cast("array<int>")
    return _let(F.concat(F.array(F.lit(0)), F.coalesce(inner, none), F.array(size)), chunks)


def candidate_chunks(docs: DataFrame, text: str, passage_words: int) -> DataFrame:
    """(_id, _key, begin, count, hash) of the chunks whose hash is found in several places.

    Pairs of lines go out as numbers, counted by each map task first; those of one text come
    together again with the number of their places. Texts that repeat nothing end there.
    """
    lines = _line_rows(docs, text, passage_words)
    counted = lines.where("i > 0").groupBy("pair").agg(F.count("*").alias("places"))
    marked = lines.join(counted.where("places > 1"), "pair", "left")
    line = F.struct("i", "hash", "pair", F.when(F.col("i") > 0, F.coalesce(
        "places", F.lit(1))).otherwise(0).alias("places"), "passage")
    # Rows that repeat give equal lines, hence the set.
    whole = marked.groupBy("_id", "_key").agg(
        F.sort_array(F.collect_set(line)).alias("lines"),
        F.bool_or((F.col("places") > 1) | F.col("passage")).alias("some"))
    chunks = whole.where("some").select("_id", "_key", F.explode(_chunks(F.col("lines"))).alias(
        "chunk")).select("_id", "_key", "chunk.*")
    return chunks


def repeated_chunks(docs: DataFrame, chunks: DataFrame, text: str) -> DataFrame:
    """(hash, keeper) of every chunk that is found in more than one place.

    Chunks whose hash is met again are grouped by their bytes. The keeper is the smallest id
    that has the chunk. A hash that two different chunks share names neither, so that only
    equal bytes go.
    """
    met = docs.groupBy("_id", "_key").agg(F.count("*").alias("rows"))
    several = chunks.join(met, _same_text(chunks, met)).groupBy("hash").agg(
        F.sum("rows").alias("places")).where("places > 1").select("hash")
    sought = chunks.join(several, "hash").groupBy("_id", "_key").agg(
        F.collect_list(F.struct("begin", "count", "hash")).alias("sought"))
    found = docs.join(sought, _same_text(docs, sought)).select(
        docs["_id"], F.explode(_let(_lines(docs[text]), lambda lines: F.transform(
            "sought", lambda c: F.struct(
                c["hash"].alias("hash"), F.array_join(
                    F.slice(lines, c["begin"] + 1, c["count"]), "\n").alias("bytes"))))
        ).alias("chunk")).select("_id", "chunk.*")
    equal = found.groupBy("hash", "bytes").agg(
        F.count("*").alias("places"), F.min("_id").alias("keeper"))
    alike = equal.groupBy("hash").agg(
        F.count("*").alias("texts"), F.sum("places").alias("places"),
        F.min("keeper").alias("keeper"))
    return alike.where("texts = 1 AND places > 1").select("hash", "keeper")


def _same_text(a: DataFrame, b: DataFrame) -> Column:
    return a["_id"].eqNullSafe(b["_id"]) & (a["_key"] == b["_key"])


@keeps_names
def remove_repeated(docs: DataFrame, id: str = "doc_id", text: str = "text",
                    passage_words: int = PASSAGE_WORDS, removed: str = "n_removed",
                    lines: str = "n_lines") -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text``, and line counts before and of
    what went.

    A chunk is two lines or more, or one line of ``passage_words`` words. Of chunks with
    equal bytes the first stays: that of the smallest ``id``, and there the first in the
    text. Rows that share an id share the right to keep; a null id never keeps unless all
    ids are null, and then every row keeps its first. A null text stays null, with no
    lines; an empty one is one empty line. A text all of whose lines go becomes empty. A very
    long text comes together in one task as numbers, four a line. An empty table stays empty.
    Columns named like the two counts are replaced.
    """
    need(docs, id, text)
    docs = docs.select(*others(docs, removed, lines))
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).withColumn(
        "_key", F.xxhash64("_text"))
    # Met three times: to count hashes, to fetch bytes, and to say which places go.
    places = saved(candidate_chunks(rows, "_text", passage_words))
    repeated = repeated_chunks(rows, places, "_text")
    place = F.struct("begin", "count")
    has = places.join(repeated, "hash").groupBy("_id", "_key", "hash", "keeper").agg(
        F.min(place).alias("first"), F.collect_set(place).alias("all"))
    own = F.coalesce(F.col("keeper") == F.col("_id"), F.col("keeper").isNull())
    going = F.when(own, F.array_remove("all", F.col("first"))).otherwise(F.col("all"))
    goes = has.withColumn("all", going).groupBy("_id", "_key").agg(
        F.flatten(F.collect_list("all")).alias("_places"))
    goes = goes.select(F.col("_id").alias("_goes_id"), F.col("_key").alias("_goes_key"), "_places")
    joined = docs.withColumn("_key", F.xxhash64(text)).join(
        goes, F.col(id).eqNullSafe(F.col("_goes_id")) & (F.col("_key") == F.col("_goes_key")),
        "left")
    gone_lines = F.flatten(F.transform("_places", lambda c: F.sequence(
        c["begin"], c["begin"] + c["count"] - 1)))

    def remaining(lines: Column, gone: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.struct(
            F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n").alias("text"),
            F.size(gone).alias("gone"))

    edited = F.when(F.size("_places") > 0, _let(_lines(F.col(text)), lambda lines: _let(
        gone_lines, lambda gone: remaining(lines, gone))))
    rows = joined.withColumn("_edited", edited)
    new = F.when(F.col("_edited").isNull(), F.col(text)).otherwise(F.col("_edited.text"))
    count = F.coalesce(F.size(_lines(F.col(text))), F.lit(0))
    return rows.select(
        *[new.alias(c) if c == text else F.col(c) for c in docs.columns],
        F.when(F.col(text).isNull(), 0).otherwise(count).alias(lines),
        F.coalesce("_edited.gone", F.lit(0)).alias(removed))
