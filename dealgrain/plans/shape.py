"""Small helpers that give query results a stable shape for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Far below the rounding step: exact halves would otherwise fall either way in the last bit.
NUDGE = 1e-8


def settle(df: DataFrame, *columns: str, scale: int = 6) -> DataFrame:
    """Select columns; round doubles and widen whole numbers so both engines print the same."""
    names = columns or tuple(df.columns)
    types = dict(df.dtypes)
    out = []
    for n in names:
        c, t = F.col(n), types[n]
        if t == "double" or t.startswith("decimal"):
            c = F.round(c.cast("double") + NUDGE, scale)
        elif t in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(n))
    return df.select(*out)


def rounds(*columns: str, scale: int = 6) -> str:
    """SQL select list that rounds the named columns."""
    return ", ".join(f"round(CAST({c} AS DOUBLE) + {NUDGE:.8f}, {scale}) AS {c}" for c in columns)


def wides(*columns: str) -> str:
    """SQL select list that widens the named whole-number columns."""
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns)
