import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelcast.session import build_session  # noqa: E402
from panelcast.spec import EXPORT_SPEC  # noqa: E402

SCHEMA = ("`Month` date, `Equipment Code` string, `Total Outages` bigint, `Scheduled Outages` bigint, "
          "`Unscheduled Outages` bigint, `Entrapments` bigint, `Time Since Major Improvement` double, "
          "`AM Peak Availability` double, `PM Peak Availability` double, `24-Hour Availability` double")


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[2]", app="panelcast-tests", shuffle_partitions=4)
    yield s
    s.stop()


def month(i: int) -> dt.date:
    m = 2024 * 12 + 8 + i  # 2024-09 is index 0
    return dt.date(m // 12, m % 12 + 1, 1)


def monthly_rows():
    """Two entities x nine months (2024-09..2025-05), the reference's shared fixture."""
    rows = []
    for code in ("EL001", "EL002"):
        for i in range(9):
            sched = i % 2
            unsched = 2 if code == "EL001" and i in (4, 7) else i % 2
            rows.append((month(i), code, sched + unsched, sched, unsched, int(code == "EL002" and i == 5), float(24 + i), 0.98, 0.97, 0.975))
    return rows


@pytest.fixture
def monthly(spark):
    return spark.createDataFrame(monthly_rows(), SCHEMA)


@pytest.fixture
def spec():
    return EXPORT_SPEC
