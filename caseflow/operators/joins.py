"""Lookups against dimensions, location hierarchies and natural-key matching."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.semantics import BINARY, fold, mysql_truthy
from caseflow.operators import skew
from caseflow.operators.skew import hot_keys, is_below, skew_join
from caseflow.session import checkpointed


def lookup(
    df: DataFrame,
    dim: DataFrame,
    left_key: str,
    dim_key: str,
    cols: Mapping[str, str] | Sequence[str],
    prefix: str = "",
    how: str = "left",
    require_unique: bool = False,
    sized_by: Sequence[DataFrame] | None = None,
) -> DataFrame:
    """Add columns of a dimension.

    ``cols`` maps new names to dimension columns, or lists columns to be named with
    ``prefix``; joining the same dimension again under another prefix gives it a
    second role. The dimension is broadcast only if its estimated size is small. Past
    that, adaptive execution chooses the join by the sizes it finds, and cuts hot and NULL
    keys of ``df``, the side that a left join lets it cut.

    A dimension that is itself a join of unique keys is sized by the tables it was made
    from, given as ``sized_by``: the estimate for a join is far too high.

    ``require_unique`` keeps one row per key, so that the lookup can never multiply
    rows; without it a repeated key multiplies them as any join does.
    """
    names = dict(cols) if isinstance(cols, Mapping) else {prefix + c: c for c in cols}
    clash = set(names) & set(df.columns)
    if clash:
        raise ValueError(f"columns already present: {sorted(clash)}")
    side = dim.select(
        F.col(dim_key).alias(left_key), *[F.col(c).alias(n) for n, c in names.items()]
    )
    if require_unique:
        picked = F.min(F.struct(*names)).alias("_row")
        side = side.groupBy(left_key).agg(picked).select(left_key, "_row.*")
    if is_below(sized_by or [dim], skew.BROADCAST_LIMIT):
        joined = df.join(F.broadcast(side), [left_key], how)
    else:
        joined = df.join(side, [left_key], how)
    return joined.select(*df.columns, *names)


def flatten_hierarchy(
    dim: DataFrame,
    id: str,
    parent: str,
    cols: Sequence[str],
    depth: int = 2,
    prefix: str = "parent_",
) -> DataFrame:
    """One row per node with the columns of its ancestors beside its own.

    The first ancestor's columns carry ``prefix`` once, the second's twice and so on;
    they are NULL past the root. Built once and looked up, in place of a chain of
    self-joins at the fact's size.
    """
    flat = dim.select(id, *cols, F.col(parent).alias("_up"))
    lead = ""
    for level in range(1, depth):
        lead += prefix
        up = dim.select(
            F.col(id).alias("_up"),
            *[F.col(c).alias(lead + c) for c in cols],
            F.col(parent).alias("_next"),
        )
        flat = flat.join(up, ["_up"], "left").drop("_up").withColumnRenamed("_next", "_up")
    return flat.drop("_up")


def hierarchy_roots(dim: DataFrame, id: str, parent: str) -> DataFrame:
    """Every node's root and its depth under it, for a hierarchy of any depth.

    Columns are ``id``, ``root``, ``depth`` (0 for a root) and ``in_cycle``. A node without
    a parent, or whose parent is not there, is a root. A node on a cycle, or under one, has
    no root: it is marked, and root and depth are NULL. Ids must be unique; a NULL id is left out.

    Pointers double: each round a node that has not met its root takes over the pointer of
    the node it points to, so that a chain of a million nodes takes 20 rounds. Rounds end
    when all have met theirs, or have gone further than there are nodes. Nodes that are done
    take no part as askers, so a root with very many nodes is no hot key; each round is
    written to the checkpoint folder.
    """
    nodes = dim.where(F.col(id).isNotNull()).select(F.col(id), F.col(parent).alias("_parent"))
    known = nodes.select(F.col(id).alias("_parent"), F.lit(True).alias("_known"))
    top = F.when(F.col("_known"), F.col("_parent"))
    state = nodes.join(known, ["_parent"], "left").select(
        id, F.coalesce(top, F.col(id)).alias("root"),
        top.isNotNull().cast("long").alias("depth"), top.isNull().alias("_done"))
    state = checkpointed(state)
    total, reach = state.count(), 1
    while reach <= total and state.where("NOT _done").limit(1).count():
        ahead = state.select(F.col(id).alias("root"), F.col("root").alias("_next"),
                             F.col("depth").alias("_further"), F.col("_done").alias("_ends"))
        open_ = state.where("NOT _done").drop("_done").join(ahead, ["root"]).select(
            id, F.col("_next").alias("root"), (F.col("depth") + F.col("_further")).alias("depth"),
            F.col("_ends").alias("_done"))
        state, reach = checkpointed(state.where("_done").unionByName(open_)), reach * 2
    return state.select(id, F.when(F.col("_done"), F.col("root")).alias("root"),
                        F.when(F.col("_done"), F.col("depth")).alias("depth"),
                        (~F.col("_done")).alias("in_cycle"))


MATCH_MODES = ("strict", "document", "type_or_truthy")


def match_member(
    person: DataFrame,
    member: DataFrame,
    doc: str,
    tipo: str,
    mode: str = "strict",
    member_doc: str | None = None,
    member_tipo: str | None = None,
    collation: str = BINARY,
    split_members: bool = True,
) -> DataFrame:
    """Left join of persons to members on their identity document.

    ``strict`` needs document and type, ``document`` the document only.
    ``type_or_truthy`` needs the document and either the same type or a person's type
    that reads as a non-zero number. That alternative is written as an equi-join: each
    member is offered under its own type and once under any type, and each person asks
    for one of the two. There is no OR condition left, so a document shared by many
    persons and members never has pairs built only to be rejected.

    Persons without a document match nobody; documents that are blank match each other.
    Documents held by very many members are split, those of very many persons are left to
    adaptive execution. ``split_members=False`` saves counting the members when they are
    already down to a few rows per document.
    """
    if mode not in MATCH_MODES:
        raise ValueError(f"mode must be one of {MATCH_MODES}, not {mode!r}")
    member_doc, member_tipo = member_doc or doc, member_tipo or tipo
    kept = [c for c in member.columns if c not in (member_doc, member_tipo)]
    clash = set(kept) & set(person.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")

    left = person.withColumn("_doc", fold(F.col(doc), collation))
    right = member.withColumn("_doc", fold(F.col(member_doc), collation))
    keys = ["_doc"]
    if mode == "strict":
        left = left.withColumn("_tipo", fold(F.col(tipo), collation))
        right = right.withColumn("_tipo", fold(F.col(member_tipo), collation))
        keys.append("_tipo")
    elif mode == "type_or_truthy":
        any_type = F.coalesce(mysql_truthy(F.col(tipo)), F.lit(False))
        wanted = F.when(any_type, F.lit("")).otherwise(F.col(tipo))
        left = left.withColumn("_any", any_type).withColumn("_tipo", fold(wanted, collation))
        offers = F.array(
            F.struct(F.lit(False).alias("_any"), F.col(member_tipo).alias("_tipo")),
            F.struct(F.lit(True).alias("_any"), F.lit("").alias("_tipo")),
        )
        right = right.withColumn("_offer", F.explode(offers)).withColumns(
            {"_any": F.col("_offer._any"), "_tipo": fold(F.col("_offer._tipo"), collation)}
        )
        keys += ["_any", "_tipo"]
    right = right.select(*keys, *kept)
    hot_members = hot_keys(right, keys) if split_members else None
    joined = skew_join(left, right, keys, "left", hot_right=hot_members)
    return joined.select(*person.columns, *kept)
