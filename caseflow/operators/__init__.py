"""DataFrame-level operators the reports are composed of."""

from caseflow.operators.aggregates import count_by, distinct_rows, plain_key, tagged_union
from caseflow.operators.classify import classify, mapping_table
from caseflow.operators.history import first_per_key, latest_per_key, milestones
from caseflow.operators.incremental import (
    StateTable,
    merge_latest,
    merge_milestones,
    milestone_state,
    milestones_of,
)
from caseflow.operators.joins import flatten_hierarchy, hierarchy_roots, lookup, match_member
from caseflow.operators.marks import keep_marked, key_marks
from caseflow.operators.packing import pack_texts, unpack_texts
from caseflow.operators.skew import hot_keys, join_parts, skew_join, with_copies, with_parts

__all__ = [
    "StateTable", "classify", "count_by", "distinct_rows", "first_per_key",
    "flatten_hierarchy", "hierarchy_roots", "hot_keys", "join_parts", "keep_marked", "key_marks",
    "latest_per_key", "lookup", "mapping_table", "match_member", "merge_latest",
    "merge_milestones", "milestone_state", "milestones", "milestones_of", "pack_texts",
    "plain_key", "skew_join", "tagged_union", "unpack_texts", "with_copies", "with_parts",
]
