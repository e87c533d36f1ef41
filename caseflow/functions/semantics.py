"""Comparison rules of the source database that Spark's ANSI mode does not share.

The data was written for a server that compares labels without regard to case or
accents, reads a string in a boolean position as a number, and compares a string
with a number numerically; it also maps case one character at a time. These helpers
make each of those choices explicit.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from caseflow.data import plain_letters

BINARY = "binary"
DEFAULT_COLLATION = "UNICODE_CI_AI"

# Longest numeric prefix of a string: sign, digits, fraction, exponent.
_NUMERIC_PREFIX = r"^\s*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def fold(col: Column, collation: str = DEFAULT_COLLATION) -> Column:
    """The column under ``collation``; ``binary`` leaves it as it is.

    A folded column may be compared, joined or grouped on. Only a binary comparison
    can be pushed into a parquet scan, so choose ``binary`` where labels are clean.
    """
    return col if collation == BINARY else F.collate(col, collation)


class Spellings(str):
    """The name of a collation that also knows how the labels of some columns are spelt.

    Given in place of the name, it turns a comparison of one of these columns with fixed
    labels into a binary IN over all spellings that the collation holds equal, which a
    parquet scan can test against its statistics. Any other comparison stays as it is.
    ``caseflow.sources.label_spellings`` reads the spellings from the tables at hand.
    """

    labels: Mapping[str, tuple[str, ...]]
    spark: SparkSession

    def __new__(cls, collation: str, labels: Mapping[str, Iterable[str]], spark: SparkSession):
        made = super().__new__(cls, collation)
        made.labels = {column: tuple(found) for column, found in labels.items()}
        made.spark = spark
        return made

    def of(self, column: str, values: Sequence[str]) -> list[str] | None:
        """The spellings of ``values`` in a column, None if its labels are not known.

        A filter over rows of the plan itself, which Spark evaluates without a job.
        """
        if column not in self.labels:
            return None
        if not self.labels[column]:
            return []
        rows = ", ".join(["(?)"] * len(self.labels[column]))
        known = self.spark.sql(f"SELECT * FROM VALUES {rows} AS t(label)",
                               args=list(self.labels[column]))
        same = known.where(F.collate("label", str(self)).isin(*values))
        return sorted(r.label for r in same.collect())


def ci_eq(col: Column, value: Column | str, collation: str = DEFAULT_COLLATION) -> Column:
    """Equality that ignores what the collation ignores."""
    if isinstance(value, str):
        return ci_in(col, [value], collation)
    return fold(col, collation) == value


def ci_in(col: Column, values: list[str], collation: str = DEFAULT_COLLATION) -> Column:
    """Membership that ignores what the collation ignores."""
    if isinstance(collation, Spellings):
        spelt = collation.of(str(col)[len("Column<'"):-len("'>")], values)
        if spelt:
            return col.isin(*spelt)
        if spelt is not None:
            return F.when(col.isNotNull(), F.lit(False))
    if len(values) == 1:
        return fold(col, collation) == values[0]
    return fold(col, collation).isin(*values)


def mysql_number(col: Column) -> Column:
    """A string as a number: its numeric prefix, 0 without one, NULL for NULL."""
    prefix = F.regexp_extract(col, _NUMERIC_PREFIX, 1)
    return F.when(col.isNotNull(), F.coalesce(prefix.try_cast("double"), F.lit(0.0)))


def mysql_truthy(col: Column) -> Column:
    """A string in a boolean position: '1' and '2CC' are true, 'CC' and '' false."""
    return mysql_number(col) != 0


def loose_eq(col: Column, number: Column | float) -> Column:
    """A string column compared with a number, numerically and without cast errors."""
    other = number if isinstance(number, Column) else F.lit(number)
    return mysql_number(col) == other.cast("double")


# Characters that sort one after another under the label collations; texts are told apart by
# where they fall between these.
_PIVOTS = "123456789abcdefghijklmnopqrstuvwxyz"


def collation_class(col: Column, collation: str = DEFAULT_COLLATION) -> Column:
    """A small number that is the same for all spellings that the collation holds equal.

    Only comparisons with fixed texts go into it, and equal texts compare alike with any
    third one. It tells few texts apart, and serves to spread rows, not to identify them.
    """
    folded = fold(col, collation)
    number = F.when(folded < _PIVOTS[0], 0)
    for place, pivot in enumerate(_PIVOTS[1:], 1):
        number = number.when(folded < pivot, place)
    return number.otherwise(F.when(col.isNotNull(), len(_PIVOTS)))


def _characters(ranges: str) -> str:
    spans = [[int(end, 16) for end in span.split("-")] for span in ranges.split()]
    return "".join(chr(c) for span in spans for c in range(span[0], span[-1] + 1))


_ONE = {other: plain for plain, found in plain_letters.ONE.items() for other in _characters(found)}
_SHOWN, _PLAIN = "".join(_ONE) + _characters(plain_letters.IGNORED), "".join(_ONE.values())
_SEVERAL = {other: plain for plain, found in plain_letters.SEVERAL.items()
            for other in _characters(found)}
# All of these written behind a text, after a character that says so, and one of them in the
# text before it with what is written there for it.
_ASIDE, _ENTRY = "\ue000", "\ue001"
_WRITTEN = _ASIDE + "".join(f"{_ENTRY}{other}{plain}" for other, plain in _SEVERAL.items()) + _ENTRY
# Java looks up Latin characters in a bit set and tries all others of a class in turn, so these
# are kept for texts that are not Latin.
_LATIN, _OTHER = ("".join(c for c in _SEVERAL if (c < "\u0100") == latin) for latin in (True, False))
_ANY_OF_SEVERAL = f"(?:[{_LATIN}]|[\\x{{100}}-\\x{{10ffff}}&&[{_OTHER}]])"
_WITH_ENTRY = f"({_ANY_OF_SEVERAL})(?=(?s:.*){_ASIDE}(?s:.*?){_ENTRY}\\1([^{_ENTRY}]*))"


def not_plain(*more: int) -> str:
    """A pattern for anything but printable ASCII, blanks and ``more`` code points.

    They are written one by one, since Java looks such a class up in a bit set.
    """
    plain = [*range(0x09, 0x0E), *range(0x20, 0x7F), *more]
    return "[^" + "".join(f"\\x{c:02x}" for c in plain) + "]"


def plain_spelling(col: Column, kept: str = "") -> Column:
    """The text in small plain letters, as ``DEFAULT_COLLATION`` holds it equal.

    Characters that have no plain equal stay, and a text with any is equal to no plain one.
    Of texts without such, those and only those that the collation holds equal come out the
    same, so that they can be compared as bytes, which is far cheaper. Characters of ``kept``,
    of those that the collation ignores, stay as well.
    """
    # A middle dot is part of an l before it.
    joined = F.regexp_replace(col, "[lL][\u00b7\u0387]", "l")
    looked_up = F.regexp_replace(F.concat(joined, F.lit(_WRITTEN)), _WITH_ENTRY, "$2")
    spelt_out = F.regexp_replace(looked_up, f"(?s){_ASIDE}[^{_ASIDE}]*$", "")
    plain = F.when(col.rlike(_ANY_OF_SEVERAL), spelt_out).otherwise(joined)
    # The ignored ones come last in the table.
    shown = _SHOWN.translate({ord(c): None for c in kept})
    return F.lower(F.when(col.rlike(not_plain(*map(ord, kept))), F.translate(plain, shown, _PLAIN))
                   .otherwise(col))


# Between two texts and in place of a NULL. The collation ignores both.
_AFTER, _NULL = "\x01", "\x02"


def joined_texts(texts: Sequence[str]) -> Column:
    """The texts as one, with marks that do not stand in a text: there, they are left out."""
    bare = F.concat_ws("", *texts)
    marked = bare.contains(_AFTER) | bare.contains(_NULL)
    without = F.array(*[F.translate(c, _AFTER + _NULL, "") for c in texts])
    return F.when(marked, F.array_join(without, _AFTER, _NULL)).otherwise(
        F.array_join(F.array(*texts), _AFTER, _NULL))


def plain_of(joined: Column) -> Column:
    """Joined texts in their plain spelling, in which the marks stay."""
    return plain_spelling(joined, _AFTER + _NULL)


def has_no_plain(spelt: Column) -> Column:
    """Whether a character of a text of ``plain_of`` has no plain equal."""
    return spelt.rlike(not_plain(1, 2))


def plain_class(texts: Sequence[str]) -> Column:
    """A text that is the same wherever ``DEFAULT_COLLATION`` holds all of ``texts`` equal, to
    spread rows by: all rows with a character without a plain equal have the same one."""
    spelt = plain_spelling(F.concat_ws("\n", *texts))
    return F.regexp_replace(spelt, f"(?s)^.*{not_plain()}.*$", "")


# Characters whose upper case is longer than one character, and as many that have no case.
_GROWING = "".join(c for c in map(chr, range(0x10000)) if len(c.upper()) > 1)
_STAND_INS = "".join(chr(0xE000 + i) for i in range(len(_GROWING)))


def simple_upper(col: Column) -> Column:
    """Upper case with one character for one: a character that Spark would write as
    several, such as ß or ŉ, stays as it is. Only text beyond ASCII is looked at for these."""
    kept = F.translate(F.upper(F.translate(col, _GROWING, _STAND_INS)), _STAND_INS, _GROWING)
    plain = F.octet_length(col) == F.length(col)
    grown = F.length(F.upper(col)) != F.length(col)
    return F.when(plain, F.upper(col)).when(grown, kept).otherwise(F.upper(col))
