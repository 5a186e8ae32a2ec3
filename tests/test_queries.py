"""Every registered query runs, and gives the rows of its SQL where it has one.

The queries are small and their planning takes most of the time, so several run side by side.
"""

from __future__ import annotations

import os
import traceback
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from types import SimpleNamespace

import pytest
from compare import connect, difference

from cueline.catalog import collect

SF = os.environ.get("CUELINE_TEST_SF", "/root/testdata/sf0.001")
#: DuckDB breaks off with an internal error on the smallest tables here, not on the next larger.
LARGER = {"split_phrase_by_owner": "/root/testdata/sf0.01", "enforce_phrase_len": "/root/testdata/sf0.01"}
QUERIES, ORACLE = collect()


@pytest.fixture(scope="module")
def outcomes(spark):
    """What is wrong with each query, or None."""
    one_at_a_time = Lock()

    def outcome(name):
        try:
            folder = LARGER.get(name, SF)
            df = QUERIES[name](spark, folder)
            rows = SimpleNamespace(columns=df.columns, collect=lambda found=df.collect(): found)
            if name in ORACLE:
                with one_at_a_time, connect(folder) as con:
                    return difference(rows, con, ORACLE[name])
            return None if rows.columns else "no columns"
        except Exception:  # noqa: BLE001
            return traceback.format_exc()[-2000:]

    with ThreadPoolExecutor(8) as pool:
        return dict(zip(QUERIES, pool.map(outcome, QUERIES), strict=True))


def test_every_check_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(outcomes, name):
    assert outcomes[name] is None
