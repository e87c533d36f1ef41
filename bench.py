"""Times the headline queries on ``$BENCH_SF_DIR`` and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from caseflow.session import local_session  # noqa: E402
from checks.queries import QUERIES  # noqa: E402

HEADLINE = [
    "latest_status", "latest_keep_ties", "latest_one", "milestones", "milestones_lookup",
    "role_playing", "match_strict", "match_type_or_truthy", "same_month", "cleanse_text",
    "case_detail", "wide_detail", "consolidated_ties", "consolidated_one",
    "monthly_tracking", "productivity", "members_by_municipality", "contract_tariffs",
    "contract_network", "authorization_wait", "person_history",
]
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench")
    seconds = {}
    for name in names:
        runs = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        # The first run compiles the generated code; the median of the others counts.
        seconds[name] = round(sorted(runs[1:])[RUNS // 2], 4)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
        "runs": RUNS,
    }))


if __name__ == "__main__":
    main()
