"""Seed and extend on odd rows, on an empty table, and against all windows compared by brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from dealgrain.llm import repeats
from dealgrain.llm.textio import Words

from .conftest import prose


def brute(rows, least=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + least]) for w in words for i in range(len(w) - least + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - least + 1) if seen[tuple(w[i : i + least])] > 1 for j in range(i, i + least)}
        out.append((doc, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return Counter(out)


def found(df):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect())


def family(seed):
    """Texts with shared passages of lengths around the threshold, near copies, runs of one word and short cycles."""
    rng = random.Random(seed)
    shared = [prose(seed * 50 + i, n) for i, n in enumerate((34, 35, 36, 60, 200))]
    rows = []
    for i in range(40):
        parts = [prose(rng.randint(10**6, 10**9), rng.randint(0, 60)) for _ in range(3)] + rng.sample(shared, rng.randint(0, 3))
        rng.shuffle(parts)
        rows.append((i, rng.choice((" ", "\n", " \t ")).join(parts)))
    base = prose(seed, 300).split()
    for i in range(30):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randint(0, 3)}"
        rows.append((100 + i, " ".join(copy)))
    rows += [(200, "a " * 90), (201, "a " * 36), (202, "a b c " * 40), (203, "b c a " * 12 + "end"), (204, "é ü " * 30)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_equal_brute_force(documents, seed):
    rows = family(seed)
    assert found(repeats.remove_repeats(documents(rows))) == brute(rows)


def test_repeats_without_broadcast(documents, monkeypatch):
    monkeypatch.setattr(repeats, "SENT_BYTES", 0)
    rows = family(4)
    assert found(repeats.remove_repeats(documents(rows))) == brute(rows)


def test_repeats_of_odd_rows(documents, odd_rows):
    own = prose(77, 50)
    rows = [*odd_rows, (30, own), (30, own), (31, f"{prose(78, 40)} {prose(79, 40)} {prose(78, 40)}")]
    result = repeats.remove_repeats(documents(rows))
    assert found(result) == brute(rows)
    gone = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in result.collect()}
    assert gone[30] == [(0, 50)] and gone[31] == [(0, 40), (80, 120)] and gone[2] == []
    assert repeats.remove_repeats(documents([])).count() == 0


def test_every_window_has_its_anchor_within():
    how = repeats.Repeats()
    words = Words(pa.array([prose(5, 400), "x " * 100, "p q " * 50, None, prose(6, 35), prose(7, 34)]))
    key, wide, first, last = repeats.reaches(words, how)
    windows = sum(max(0, int(n) - 34) for n in words.count)
    assert int((last - first + 1).sum()) == windows and (words.text[first] == words.text[last + how.least - 1]).all()
    # Random seeds: one anchor in (seeds + 1) / 2 windows.
    assert 0.6 < (words.text[first] == 0).sum() / (366 * 2 / (how.seeds + 1)) < 1.6


def test_kept_bytes_join_by_one_space():
    words = Words(pa.array(["a  b\tc", "", "  d ", "e f"]))
    data, offsets = repeats.kept_bytes(words, np.array([0, 2, 3, 5]))
    assert [bytes(data[a:b]) for a, b in zip(offsets, offsets[1:])] == [b"a c", b"", b"d", b"f"]
