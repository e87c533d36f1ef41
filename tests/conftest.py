import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from caseflow.session import local_session  # noqa: E402
from tests import fixtures  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """The hand-written domain tables, written out and loaded as a user would."""
    from caseflow.sources import load_tables

    folder = str(tmp_path_factory.mktemp("domain"))
    fixtures.write(spark, folder)
    return load_tables(spark, folder)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
