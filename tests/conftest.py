from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

import pytest

from tidemark.session import build_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="6g",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(n: int, month: int = 5, **clock) -> datetime:
    return datetime(2026, month, n, tzinfo=timezone.utc) + timedelta(**clock)


def explained(df) -> str:
    """The formatted physical plan as text."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def shuffles(df) -> int:
    return len(re.findall(r"^\(\d+\) Exchange", explained(df), re.MULTILINE))
