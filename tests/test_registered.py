"""Every registered query against its SQL check on the smallest tables."""

from __future__ import annotations

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry_points  # noqa: E402
from check_oracle import compare, connect  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_every_check_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert len(entry_points.queries()) > 150


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns[0] == "rank" and df.count() > 0


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, db, name):
    state, rows, _, note = compare(spark, db, FOLDER, name, entry_points.queries()[name], entry_points.oracle_sql().get(name))
    assert state in ("ok", "rows only"), f"{state}: {note}"
    assert state == "ok" or rows > 0
