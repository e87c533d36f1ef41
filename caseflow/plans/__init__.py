"""Reports composed of the operators. Each takes the tables by name."""

from caseflow.plans.authorization_wait import authorization_wait
from caseflow.plans.case_detail import case_detail
from caseflow.plans.consolidated import KEEP_TIES, ONE_ROW, consolidated
from caseflow.plans.contracts import contract_network, contract_tariffs
from caseflow.plans.members import members_by_municipality
from caseflow.plans.monthly_tracking import monthly_tracking
from caseflow.plans.person_history import feed_history, person_history
from caseflow.plans.productivity import productivity
from caseflow.plans.wide_detail import wide_detail

__all__ = [
    "KEEP_TIES", "ONE_ROW", "authorization_wait", "case_detail", "consolidated",
    "contract_network", "contract_tariffs", "feed_history", "members_by_municipality",
    "monthly_tracking", "person_history", "productivity", "wide_detail",
]
