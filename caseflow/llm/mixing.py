"""Mixing sources to target weights, with budgets handed down a tree of levels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.tables import need, others, saved

# How often a document may be taken at most.
MAX_EPOCHS = 4
# Leaves up to which their table is sent to every task.
SENT_LEAVES = 50_000
BLANK = r"[^\x20\x09-\x0D]+"

# Stands for a level that is null. Budgets times weights need more than 64 bits.
NONE = "\x00"
_WIDE = "decimal(38,0)"


def token_count(text: str) -> Column:
    """Runs of anything but ASCII blanks; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(BLANK)), F.lit(0)).cast("long")


def epoch_order(id: str, seed: int, epoch: Column) -> Column:
    """A document's place in an epoch's order: 60 bits of SHA-256 of seed, epoch and id."""
    key = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"),
                      F.coalesce(F.col(id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def _weight(level: str, given: Mapping[str, int]) -> Column:
    """The weight of a level's value: a whole number, 1 where none is given."""
    weight = F.lit(1)
    for value, share in given.items():
        if share != int(share) or not 0 <= share <= 1000:
            raise ValueError(f"weight of {value!r} must be a whole number up to 1000")
        weight = F.when(F.col(level) == value, int(share)).otherwise(weight)
    return weight.cast("long")


def _shared(nodes: DataFrame, parents: list[str], level: str) -> DataFrame:
    """Nodes with ``budget``: their part of ``above``, their parent's, by ``weight``.

    A node takes no more than its ``capacity``; what it leaves goes to its siblings by
    their weights. Siblings that fill up first are those with the least capacity for their
    weight; in that order a node fills up if what is left, shared by weight among it and
    those after it, gives it as much as its capacity. Other shares are rounded down.
    """
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.col("capacity") / F.col("weight"), level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    wide = {c: F.col(c).cast(_WIDE) for c in ("above", "capacity", "weight")}
    nodes = nodes.where("weight > 0").withColumns({
        "_taken": F.coalesce(F.sum(wide["capacity"]).over(before), F.lit(0)).cast(_WIDE),
        "_open": F.sum(wide["weight"]).over(onward).cast(_WIDE)})
    full = (wide["above"] - F.col("_taken")) * F.col("weight") >= wide["capacity"] * F.col("_open")
    nodes = nodes.withColumn("_full", full)
    nodes = nodes.withColumns({
        "_rest": (wide["above"] - F.coalesce(F.sum(F.when(F.col("_full"), wide["capacity"])).over(
            group), F.lit(0))).cast(_WIDE),
        "_by": F.coalesce(F.sum(F.when(~F.col("_full"), wide["weight"])).over(group),
                          F.lit(1)).cast(_WIDE)})
    part = F.expr(f"(_rest * cast(weight as {_WIDE})) div _by")
    budget = F.when(F.col("_full"), F.col("capacity")).otherwise(part).cast("long")
    return nodes.withColumn("budget", budget).drop("_taken", "_open", "_full", "_rest", "_by")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: Mapping[str, Mapping[str, int]],
                 budget: int) -> DataFrame:
    """``leaves`` (levels and ``capacity``) with the tokens each may give, as ``budget``.

    The whole budget is handed down level by level. A node's capacity is that of all leaves
    under it, so a shortage among siblings leaves the parent's budget as it is while any of
    them has room, and passes to the parent's siblings only beyond that.
    """
    above, parents = None, []
    for level in levels:
        path = [*parents, level]
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").cast("long").alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(level, weights.get(level, {})))
        if above is None:
            nodes = nodes.withColumn("above", F.lit(int(budget)))
        else:
            nodes = nodes.join(above, parents)
        nodes = _shared(nodes, parents, level)
        above, parents = nodes.select(*path, F.col("budget").alias("above")), path
    return leaves.join(above.withColumnRenamed("above", "budget"), levels, "left").fillna(
        0, ["budget"])


def _sent(leaves: DataFrame) -> DataFrame:
    """The leaves, to be sent to every task if they are few enough."""
    return F.broadcast(leaves) if leaves.count() <= SENT_LEAVES else leaves


def _cuts(rows: DataFrame, leaves: DataFrame, levels: list[str], seed: int) -> DataFrame:
    """Leaves with ``cut``: the last place, in the order of their last epoch, that is taken.

    Places are first summed in buckets, about as many as a bucket has documents; only the
    documents of the one bucket in which a leaf's budget ends are put in order.
    """
    bits = F.ceil(F.log2(F.greatest("docs", F.lit(2))) / 2).cast("int")
    open_leaves = _sent(leaves.where("rest > 0").withColumn("shift", 60 - bits).select(
        *levels, "epochs", "rest", "shift"))
    placed = rows.join(open_leaves, levels).withColumn(
        "place", epoch_order("_id", seed, F.col("epochs")))
    placed = placed.withColumn("bucket", F.expr("shiftright(place, shift)"))
    sums = placed.groupBy(*levels, "rest", "shift", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    upto = Window.partitionBy(*levels).orderBy("bucket")
    sums = sums.withColumn("total", F.sum("tokens").over(upto)).where("total > rest")
    ends = sums.groupBy(*levels, "rest", "shift").agg(
        F.min("bucket").alias("bucket"), F.min_by(F.col("total") - F.col("tokens"), "bucket").alias(
            "before"))
    ends = saved(ends)
    inside = placed.select(*levels, "bucket", "place", "n_tokens").join(
        _sent(ends.select(*levels, "bucket", "rest", "before")), [*levels, "bucket"])
    inside = inside.groupBy(*levels, "rest", "before", "place").agg(
        F.sum("n_tokens").alias("tokens"))
    upto = Window.partitionBy(*levels).orderBy("place")
    taken = inside.where(F.col("rest") > 0).withColumn(
        "total", F.col("before") + F.sum("tokens").over(upto)).where("total <= rest")
    last = taken.groupBy(*levels).agg(F.max("place").alias("last"))
    cut = F.coalesce("last", F.expr("shiftleft(bucket, shift) - 1")).alias("cut")
    return ends.join(last, levels, "left").select(*levels, cut)


def mix(docs: DataFrame, levels: Mapping[str, str], weights: Mapping[str, Mapping[str, int]],
        budget_percent: int = 100, max_epochs: int = MAX_EPOCHS, seed: int = 0,
        id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of a mixture: their columns, the levels, ``n_tokens`` and ``copies``.

    ``levels`` names the tree's levels from the root down, each with its value in SQL;
    ``weights`` has whole numbers for the values of a level, 1 for the others, 0 to leave
    out. The budget is ``budget_percent`` of all tokens there are. A leaf gives its documents
    in seeded orders, one per epoch: whole epochs while the budget lasts, then the longest
    prefix of the next whose tokens stay within it; no more than ``max_epochs`` in all.

    Documents that are not taken are left out. Rows that repeat an id have one place in the
    order and are taken together; null ids likewise. Null texts have no tokens, and null
    levels are a branch of their own. Columns of ``docs`` named like a result or a level are
    replaced. Token counts, budgets and places are whole numbers; weights reach to 1000.
    """
    need(docs, id, text)
    names = list(levels)
    inner = [f"_level{i}" for i in range(len(names))]
    kept = others(docs, *names, "n_tokens", "copies")
    # The documents' own columns stay in one of their own, where no name can clash.
    whole = docs.select(F.struct(*kept).alias("_row"), F.col(id).alias("_id"), *[
        F.coalesce(F.expr(value).cast("string"), F.lit(NONE)).alias(level)
        for level, value in zip(inner, levels.values())], token_count(text).alias("n_tokens"))
    given = {level: weights.get(name, {}) for level, name in zip(inner, names)}

    rows = saved(whole.select("_id", *inner, "n_tokens"))
    leaves = saved(rows.groupBy(*inner).agg(
        F.sum("n_tokens").alias("supply"), F.count("*").alias("docs")))
    total = leaves.agg(F.sum("supply")).first()[0] or 0
    leaves = leaf_budgets(leaves.withColumn("capacity", F.col("supply") * max_epochs), inner,
                          given, total * budget_percent // 100)
    leaves = saved(leaves.withColumns({
        "epochs": F.when(F.col("supply") > 0, F.expr("budget div supply")).otherwise(0),
        "rest": F.when(F.col("supply") > 0, F.expr("budget % supply")).otherwise(0)}))
    cuts = _cuts(rows, leaves, inner, seed)
    chosen = saved(leaves.join(cuts, inner, "left").select(*inner, "epochs", "cut"))
    out = whole.join(_sent(chosen), inner)
    more = F.coalesce(epoch_order("_id", seed, F.col("epochs")) <= F.col("cut"), F.lit(False))
    out = out.withColumn("copies", (F.col("epochs") + more.cast("int")).cast("int"))
    return out.where("copies > 0").select("_row.*", *[
        F.nullif(F.col(level), F.lit(NONE)).alias(name) for level, name in zip(inner, names)],
        "n_tokens", "copies")
