from __future__ import annotations

import pathlib
import sys
import tempfile

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from dealgrain.session import build_session, local_table  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    work = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    session = build_session(
        "tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"{work}/checkpoints", "spark.driver.memory": "4g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """A table from dictionaries; columns missing in a row are null."""

    def build(rows, schema):
        names = [c.strip().split()[0].strip("`") for c in schema.split(",")]
        return local_table(spark, [tuple(r.get(n) for n in names) for r in rows], schema)

    return build


def as_dicts(df, *order):
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(rows, key=lambda r: tuple(str(r[o]) for o in order)) if order else rows
