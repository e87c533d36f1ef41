"""License scans by diagonal voting.

Every k-gram of words of every text is hashed and joined with the positions at which the
license templates have it. Hits of one text and template vote for the diagonal that they lie
on, the place in the text where the template would begin. Neighbouring diagonals are
merged, since a few words more or less shift what follows, and a merged span counts if
enough of the template's k-grams lie in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.tables import need
from caseflow.llm.words import NOT_ALNUM, Piece, mix, pieces, word_hashes

# Words of a text that travel in one row.
CHUNK_WORDS = 512
# Words per gram of the templates that must stand whole, and of those that may differ.
WHOLE_K, LOOSE_K = 2, 5
# Diagonals of a loose template this far apart, or less, belong to one span.
SLACK = 12
# Share of a loose template's grams that a span must hold.
LEAST_SHARE = 0.5

_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Template:
    """Words that show a license. ``whole`` ones must stand word by word; of the others a
    span with ``LEAST_SHARE`` of their grams is enough."""

    label: str
    text: str
    whole: bool = True

    @property
    def k(self) -> int:
        return WHOLE_K if self.whole else LOOSE_K

    def words(self) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", self.text.translate(_LOWER))


_LOWER = {65 + i: 97 + i for i in range(26)}

# Names of licenses, and their labels.
PHRASES = (
    Template("gpl", "gnu general public license"),
    Template("apache", "apache license"),
    Template("cc-by", "cc by"),
    Template("mit", "mit license"),
)
# Statements that name a version, and the notices of some licenses.
STATEMENTS = (
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("apache-2.0", "apache license version 2.0"),
    Template("cc-by-4.0", "cc by 4.0"),
    Template("cc-by-sa-4.0", "cc by-sa 4.0"),
    Template("cc-by-nc-4.0", "cc by-nc 4.0"),
)
NOTICES = (
    Template("mit", """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this
        software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in
        all copies or substantial portions of the Software.""", whole=False),
    Template("apache-2.0", """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this
        file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
        to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
        License for the specific language governing permissions and limitations under the
        License.""", whole=False),
    Template("gpl-3.0", """
        This program is free software: you can redistribute it and/or modify it under the terms
        of the GNU General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
             whole=False),
    Template("bsd-2-clause", """
        Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met: Redistributions of source
        code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""", whole=False),
    Template("cc-by-4.0", """
        This work is licensed under a Creative Commons Attribution 4.0 International
        License.""", whole=False),
)
TEMPLATES = PHRASES + STATEMENTS + NOTICES


def licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """One row per document: its id, ``n_words``, and ``spans``, in order of template and
    place: ``template`` (its number), ``label``, ``first`` (word, from 0), ``words`` (length)
    and ``share`` (of the template's grams, over 0 and up to 1).

    A template that must stand whole gives a span for every place where its words stand
    consecutively, overlapping ones included. Words are runs of ASCII letters and digits and
    of all characters beyond ASCII, with A-Z in lower case; every gram that hashes like a
    template's is compared word by word. Null and empty texts have no words and no spans;
    rows of one id stay rows of their own; an empty table gives no rows. A very long text is
    cut into rows of 512 words before the join, and only its hits come together again. Other
    columns are left out. Documents should come from a table or a written result, whose rows
    a repeated task meets in the same order, for rows are numbered as they are read.
    """
    need(docs, id, text)
    templates = tuple(templates)
    short = [t for t in templates if len(t.words()) < t.k]
    if short or not templates:
        raise ValueError(f"templates without a gram: {[t.text for t in short]}")
    rows = docs.select(F.monotonically_increasing_id().alias("row"),
                       F.col(id).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([
        T.StructField("row", T.LongType()), rows.schema["id"],
        T.StructField("n_words", T.LongType()), T.StructField("at", T.LongType()),
        T.StructField("places", T.IntegerType()),
        T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("grams", T.ArrayType(T.LongType()))])
    chunks = rows.mapInArrow(_chunks, schema)

    # A chunk's grams are those of k = 2 and then those of k = 5, each from every word on.
    grams = chunks.select("row", "id", "n_words", "at", "places", "words",
                          F.posexplode_outer("grams").alias("i", "gram"))
    hits = grams.join(F.broadcast(_positions(docs, templates)), ["gram"], "left")
    place = F.pmod("i", "places")
    same = F.slice("words", place + 1, F.size("template_words")) == F.col("template_words")
    # The first gram of each text stays, hit or not, and brings the text itself along.
    hits = hits.select(
        "row", "id", "n_words", F.when(same, F.col("template")).alias("template"),
        (F.col("at") + place).alias("place"), "position",
        ((F.col("at") == 0) & (F.coalesce("i", F.lit(0)) == 0)).alias("start"),
    ).where("start OR template IS NOT NULL")

    hits = hits.repartition("row")
    votes = hits.groupBy(
        "row", "id", "template",
        F.when(F.col("template").isNotNull(), F.col("place") - F.col("position")).alias("diagonal"),
    ).agg(F.max("n_words").alias("n_words"), F.min("place").alias("first"),
          F.max("place").alias("last"), F.collect_list("position").alias("positions"))
    kinds = _kinds(templates)
    by = Window.partitionBy("row", "id", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(by) > kinds["slack"]
    votes = votes.withColumn("fresh", F.coalesce(apart, F.lit(True)).cast("int"))
    votes = votes.withColumn("span", F.sum("fresh").over(by))
    merged = votes.groupBy("row", "id", "template", "span").agg(
        F.max("n_words").alias("n_words"), F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.size(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("held"))
    share = F.col("held") / kinds["grams"]
    span = F.struct(F.col("template"), kinds["label"].alias("label"), F.col("first"),
                    (F.col("last") - F.col("first") + kinds["k"]).alias("words"),
                    share.alias("share"))
    found = merged.groupBy("row", "id").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_list(F.when(share >= kinds["least"], span))).alias("spans"))
    return found.select(F.col("id").alias(id), "n_words", "spans")


def _kinds(templates: Sequence[Template]) -> dict:
    """Columns with what holds for the template of a row."""
    def pick(values: list):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("template") + 1)

    return {
        "label": pick([t.label for t in templates]),
        "k": pick([t.k for t in templates]),
        "slack": pick([0 if t.whole else SLACK for t in templates]),
        "grams": pick([len(t.words()) - t.k + 1 for t in templates]),
        "least": pick([1.0 if t.whole else LEAST_SHARE for t in templates]),
    }


def _positions(docs: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """Where the templates have which gram; as many rows as they have words."""
    rows = []
    for number, template in enumerate(templates):
        words = template.words()
        text = " ".join(words).encode()
        ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = word_hashes(np.frombuffer(text, dtype=np.uint8), starts, ends)
        grams = _grams(hashes, template.k).view(np.int64)
        rows += [(int(g), number, at, words[at:at + template.k]) for at, g in enumerate(grams)]
    return docs.sparkSession.createDataFrame(
        rows, "gram bigint, template int, position int, template_words array<string>")


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Rolling polynomial hash of each run of ``k`` words, told apart by ``k``."""
    places = max(len(hashes) - k + 1, 0)
    total = np.zeros(places, dtype=_U64)
    for at in range(k):
        total = total * _BASE + hashes[at:at + places]
    return mix(total + _U64(k))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch.column("text"), NOT_ALNUM):
            yield _chunked(piece, batch.column("row").slice(piece.first, piece.texts),
                           batch.column("id").slice(piece.first, piece.texts))


def _chunked(piece: Piece, rows: pa.Array, ids: pa.Array) -> pa.RecordBatch:
    counts = piece.counts()
    begins = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts
    # Every text has a chunk at least.
    chunks = np.maximum(-(-counts // CHUNK_WORDS), 1)
    of = np.repeat(np.arange(piece.texts), chunks)
    number = np.arange(len(of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    at = number * CHUNK_WORDS
    places = np.minimum(counts[of] - at, CHUNK_WORDS)
    # A chunk also has the words that its last grams reach into.
    reach = np.minimum(counts[of] - at, CHUNK_WORDS + LOOSE_K - 1)
    first = begins[of] + at

    strings = pa.StringArray.from_buffers(
        len(piece.starts), _offsets(piece.ends - piece.starts),
        pa.py_buffer(piece.bytes[~NOT_ALNUM[piece.bytes]].tobytes()))
    words = strings.take(pa.array(_runs(first, reach)))
    hashes = piece.hashes()
    grams = []
    for k in (WHOLE_K, LOOSE_K):
        own = np.zeros(len(hashes), dtype=_U64)
        rolled = _grams(hashes, k)
        own[:len(rolled)] = rolled
        # A gram that would reach into the next text is none.
        own[np.arange(len(own)) + k > (begins + counts)[piece.text]] = 0
        grams.append(own)
    # Grams of the first kind of a chunk, then those of the second.
    both = np.concatenate(grams)
    order = _runs(np.stack([first, first + len(hashes)], 1).ravel(), np.repeat(places, 2))
    of_chunk = pa.array(of)
    return pa.RecordBatch.from_arrays([
        rows.take(of_chunk), ids.take(of_chunk), pa.array(counts[of]), pa.array(at),
        pa.array(places.astype(np.int32)), _listed(words, reach),
        _listed(pa.array(both[order].view(np.int64)), 2 * places),
    ], ["row", "id", "n_words", "at", "places", "words", "grams"])


def _offsets(lengths: np.ndarray) -> pa.Buffer:
    return pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32).tobytes())


def _listed(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.list_(values.type), len(lengths), [None, _offsets(lengths)],
                                 children=[values])


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of runs that begin at ``starts`` and have these lengths."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, dtype=np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
