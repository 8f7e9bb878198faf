"""Name search through shared rare characters against comparing everything, and how the work grows."""

from __future__ import annotations

import random

import pytest

from dealgrain.functions.similarity import similarity
from dealgrain.operators import names
from dealgrain.session import local_table


def brute(lefts, rights):
    out = {}
    for block, name in set(lefts):
        known = [(-similarity(name, other), order) for b, other, order in rights if b == block]
        if known:
            score, order = min(known)
            out[block, name] = (round(-score, 9), order)
    return out


def found(spark, lefts, rights):
    df = names.best_names(local_table(spark, lefts, "block string, name string"), local_table(spark, rights, "block string, name string, master_order string"))
    got = [((r["block"], r["name"]), (round(r["score"], 9), r["master_order"])) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def word(rng, letters, low=0, high=9):
    return "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))


def edited(rng, name, letters):
    out = list(name)
    for _ in range(rng.randint(0, 3)):
        at = rng.randint(0, len(out))
        if rng.random() < 0.5:
            out.insert(at, rng.choice(letters))
        elif out:
            out.pop(min(at, len(out) - 1))
    return "".join(out)


@pytest.mark.parametrize("letters, high", [("가나다라마바사아자차카타파하", 7), ("abcdefgh", 14), ("ab", 5), ("𝒳é日x1", 70)])
def test_best_names_equal_brute_force(spark, monkeypatch, letters, high):
    monkeypatch.setattr(names, "NAMES_PER_CHUNK", 6)
    rng = random.Random(high)
    rights = [(rng.choice("pqs"), word(rng, letters, 0, high), f"{i:04d}") for i in range(120)] + [("small", "a", "1"), ("small", "ab", "0")]
    lefts = [(b, edited(rng, n, letters)) for b, n, _ in rights[:60]] + [(rng.choice("pqsz"), word(rng, letters, 0, high)) for _ in range(60)] + [("small", "b"), ("p", "")]
    assert found(spark, lefts, rights) == brute(lefts, rights)


def test_rounds_solve_what_has_a_similar_name(spark, monkeypatch):
    """Without the last step, every left name with a partner of similarity 50 or more still gets its best."""
    monkeypatch.setattr(names, "NAMES_PER_CHUNK", 20)
    rng = random.Random(5)
    letters = [chr(0xAC00 + 28 * i) for i in range(300)]
    rights = [("b", word(rng, letters, 2, 8), f"{i:05d}") for i in range(400)]
    lefts = [("b", edited(rng, n, letters)) for _, n, _ in rights[:200]]
    want = brute(lefts, rights)
    assert found(spark, lefts, rights) == want and sum(s >= 50 for s, _ in want.values()) > 150


def crowd(spark, n):
    """One block: names of syllables, half of the left ones with an edit of a right one."""
    rng = random.Random(1)
    letters = [chr(0xAC00 + 28 * i) for i in range(399)]
    rights = [("b", word(rng, letters, 4, 9), f"{i:06d}") for i in range(n)]
    lefts = [("b", edited(rng, name, letters)) for _, name, _ in rights[: n // 2]]
    return local_table(spark, lefts, "block string, name string").distinct(), local_table(spark, rights, "block string, name string, master_order string").dropDuplicates(["block", "name"])


def test_compared_pairs_of_one_crowded_block(spark):
    pairs = {n: [names.compared_pairs(*crowd(spark, n), step).first()["pairs"] for step in names.ROUNDS[:2]] for n in (25_000, 50_000)}
    print("pairs that meet", pairs)
    every = 50_000 * 25_000
    assert sum(pairs[50_000]) < every / 1000 and sum(pairs[50_000]) < 3 * sum(pairs[25_000])
