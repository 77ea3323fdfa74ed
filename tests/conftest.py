from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from helpers import DATA, TABLES  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from kinloom.session import session

    s = session("local[8]", 8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/sf0.001/{t}.parquet')")
    return c
