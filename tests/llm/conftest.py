from __future__ import annotations

import random

import pytest

from dealgrain.session import local_table

#: Columns whose names the operators use inside, or return.
CLASHING = ("node", "ref", "label", "spans", "kept", "_id", "part", "window", "score", "row")


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(("ba", "ke", "lo", "mi", "nu", "ra", "so", "ti")) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def documents(spark):
    """A table of (doc_id, text) rows with further columns of clashing names."""

    def build(rows):
        extra = ", ".join(f"`{c}` string" for c in CLASHING)
        return local_table(spark, [(i, t, *(f"{c}{n}" for c in CLASHING)) for n, (i, t) in enumerate(rows)], f"doc_id bigint, text string, {extra}")

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long text, ties and repeated rows."""
    long = prose(1, 60_000)
    return [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, long), (5, "short one"), (5, "short one"), (6, prose(2, 80)), (7, prose(2, 80)), (None, prose(3, 90)), (8, prose(4, 70))]
