"""Column-level building blocks: native Spark expressions only."""

from caseflow.functions.columns import (
    age_years,
    cleanse_text,
    coalesce_milestones,
    decode,
    flag,
    geo_code,
    wait_days,
    with_labels,
)
from caseflow.functions.filters import exclude_codes, not_deleted, period_filter, same_period
from caseflow.functions.semantics import (
    BINARY,
    DEFAULT_COLLATION,
    Spellings,
    ci_eq,
    ci_in,
    collation_class,
    fold,
    loose_eq,
    mysql_number,
    mysql_truthy,
    plain_class,
    simple_upper,
)

__all__ = [
    "BINARY", "DEFAULT_COLLATION", "Spellings", "age_years", "ci_eq", "ci_in", "cleanse_text",
    "coalesce_milestones", "collation_class", "decode", "exclude_codes", "flag", "fold",
    "geo_code",
    "loose_eq", "mysql_number", "mysql_truthy", "not_deleted", "period_filter",
    "plain_class", "same_period", "simple_upper", "wait_days", "with_labels",
]
