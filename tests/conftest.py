import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lexhaven.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", memory="4g", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture()
def plan_of():
    """Formatted physical plan of a frame."""

    def plan(df):
        mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        return df._jdf.queryExecution().explainString(mode)

    return plan
