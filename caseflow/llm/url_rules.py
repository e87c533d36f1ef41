"""URL filter rules as a sort-merge range join over reversed-host keys.

A host is turned round label by label, each label closed by a separator that sorts before
any other character: ``news.example.net`` gives ``net|example|news|``. All hosts under a
rule's host then lie in one interval that begins at the rule's own key, and intervals are
nested or apart. URLs sorted by that key are swept once against the sorted rules, with a
stack of the rules whose interval is open.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.tables import keeps_names, need, others

# Rules that are sent to the tasks at once; a longer list takes more sweeps.
BLOCK_RULES = 200_000
# Closes a label; no other character sorts before it, so children follow their parent.
CLOSE = "\x00"

ALLOW, BLOCK = "allow", "block"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: str) -> Column:
    at = F.expr(f"locate('://', `{url}`)")
    return F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")


def url_host(url: str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case.

    Only A-Z are lower-cased. Null and URLs without ``://`` have the empty host.
    """
    host = F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), ASCII_UPPER, ASCII_LOWER)


def url_path(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; may be empty."""
    path = F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(path, F.lit(""))


def host_key(host: str) -> str:
    """The reversed labels, each closed. The empty host, over all others, is empty."""
    return "".join(label + CLOSE for label in reversed(host.split("."))) if host else ""


def _key(host: str) -> Column:
    labels = F.reverse(F.split(F.col(host), r"\.", -1))
    closed = F.concat(F.array_join(labels, CLOSE), F.lit(CLOSE))
    return F.when(F.col(host) == "", F.lit("")).otherwise(closed)


class Sweep:
    """Goes through ascending keys and says which rules' intervals hold each of them."""

    def __init__(self, rules: Sequence[tuple[str, list]]):
        self.keys = [key for key, _ in rules]
        self.rules = rules
        self.next, self.open = 0, []

    def seek(self, key: str) -> None:
        """Starts at any key: opens the rules above it, found label by label."""
        self.next = bisect_right(self.keys, key)
        self.open, at = [], -1
        while True:
            above = key[: at + 1]
            row = bisect_right(self.keys, above) - 1
            if row >= 0 and self.keys[row] == above:
                self.open.append(self.rules[row])
            at = key.find(CLOSE, at + 1)
            if at < 0:
                return

    def to(self, key: str) -> list:
        while self.next < len(self.keys) and self.keys[self.next] <= key:
            self._close(self.keys[self.next])
            self.open.append(self.rules[self.next])
            self.next += 1
        self._close(key)
        return self.open

    def _close(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()


def _longest(open_rules: list, path: str) -> list | None:
    """The longest path that fits, of the innermost host that has one that fits."""
    for _, paths in reversed(open_rules):
        for rule in paths:
            if path.startswith(rule[0]):
                return rule
    return None


def _swept(rows: DataFrame, block: list[tuple[str, str, str]]) -> DataFrame:
    """One sweep: a rule replaces ``_rule`` and ``_verdict`` where it is longer."""
    by_host: dict[str, list] = {}
    for host, path, verdict in block:
        by_host.setdefault(host, []).append((path, verdict, host))
    # Longer paths first; of equal rules the one that blocks.
    rules = sorted((host_key(host), sorted(paths, key=lambda r: (-len(r[0]), r[0], r[1] != BLOCK)))
                   for host, paths in by_host.items())
    sent = rows.sparkSession.sparkContext.broadcast(rules)
    names = rows.columns
    at = {name: names.index(name) for name in ("_key", "path", "_rule", "_verdict")}

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, started = Sweep(sent.value), False
        for batch in batches:
            found, verdicts = batch.column(at["_rule"]).to_pylist(), batch.column(
                at["_verdict"]).to_pylist()
            for row, (key, path) in enumerate(zip(batch.column(at["_key"]).to_pylist(),
                                                  batch.column(at["path"]).to_pylist())):
                if not started:
                    sweep.seek(key)
                    started = True
                if rule := _longest(sweep.to(key), path):
                    text = rule[2] + rule[0]
                    before = found[row]
                    better = before is None or (rule[2].count("."), len(text)) > (
                        before.split("/")[0].count("."), len(before))
                    tie = before == text and rule[1] == BLOCK
                    if better or tie:
                        found[row], verdicts[row] = text, rule[1]
            columns = list(batch.columns)
            columns[at["_rule"]] = pa.array(found, pa.string())
            columns[at["_verdict"]] = pa.array(verdicts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(judged, rows.schema)


def _blocks(rules: DataFrame, size: int) -> Iterator[list[tuple[str, str, str]]]:
    host = F.translate("host", ASCII_UPPER, ASCII_LOWER).alias("host")
    block = []
    for row in rules.select(host, "path", "verdict").dropna().distinct().toLocalIterator():
        block.append(tuple(row))
        if len(block) >= size:
            yield block
            block = []
    if block:
        yield block


@keeps_names
def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW,
          block_rules: int = BLOCK_RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path) and ``verdict``.

    ``rules`` has host, path and verdict (``allow`` or ``block``). A rule fits its host and
    all hosts under it where the URL's path starts with the rule's path, a slash at least.
    Of the rules that fit, the longest wins: that of the innermost host, then the longest
    path; of two alike the one that blocks. Without a rule the verdict is ``default``, that
    of a list of exceptions.

    Pages are dealt by ranges of (key, path, row number), so that neither a hot host nor
    many rows of one URL fall to one task. Null and malformed URLs have empty host and
    path and fit rules of the empty host only. Rules with a null part are none. Repeated
    rows stay. Columns of ``pages`` named like the four results are replaced.
    """
    need(pages, url)
    need(rules, "host", "path", "verdict")
    kept = others(pages, "host", "path", "rule", "verdict")
    # The URL is copied first: it may itself be called like a result.
    rows = pages.select(*kept, F.col(url).alias("_url"))
    rows = rows.withColumns({"host": url_host("_url"), "path": url_path("_url")}).drop("_url")
    none = F.lit(None).cast(T.StringType())
    rows = rows.withColumns({"_key": _key("host"), "_rule": none, "_verdict": none,
                             "_row": F.monotonically_increasing_id()})
    order = ["_key", "path", "_row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    for block in _blocks(rules, block_rules):
        rows = _swept(rows, block)
    return rows.select(*kept, "host", "path", F.col("_rule").alias("rule"),
                       F.coalesce("_verdict", F.lit(default)).alias("verdict"))
