"""The Euler tour against a trie built in memory; running totals and list ranks against plain loops."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from dealgrain.llm import prefix_trie, scans
from dealgrain.session import local_table


def brute(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own[conv].append((role or "", text or ""))
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        block = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(block, [])[:h] + turns[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                kids[path[: d - 1]].add(path[:d])

    def below(node):
        here = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        sums = [below(k) for k in kids[node]]
        return (sum(s[0] for s in sums) or 1, here + sum(s[1] for s in sums))

    out = set()
    for node, convs in list(members.items()):
        ends = ",".join(str(c) for c in sorted(c for c in convs if paths[c] == node))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(convs), len(node), parent, len(convs), len(kids[node]), *below(node), hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(df):
    got = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(got) == len(set(got))
    return set(got)


def table(spark, rows):
    return local_table(spark, [(*r, 1, "x", 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, number string, k1 int")


def talk(seed, convs=150):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-120, 420), convs):
        for turn in range(rng.randint(1, 7)):
            text = rng.choice(("hi", "é", "", None, "how are you", "long " * 9, str(rng.randint(0, 9))))
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(("user", "assistant", None)), text))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def small_runs():
    """Short runs and few links a task, so that small tables take every path."""
    patch = pytest.MonkeyPatch()
    patch.setattr(prefix_trie, "RUN", 3)
    patch.setattr(scans, "LOCAL_LINKS", 40)
    yield
    patch.undo()


def test_trie_equals_brute_force(spark):
    rows = talk(1)
    assert found(prefix_trie.conversation_trie(table(spark, rows))) == brute(rows)


def test_trie_over_several_levels_of_ranking(spark, small_runs):
    rows = talk(2, 90)
    assert found(prefix_trie.conversation_trie(table(spark, rows).repartition(4))) == brute(rows)


def test_trie_of_odd_rows(spark, small_runs):
    rows = [(None, 1, "user", "lost"), (7, None, None, None), (7, None, None, None), (7, 1, "b", "x"), (7, 1, "a", "y"), (-5, 1, "user", "é" * 10)]
    rows += [(900, i, "user", f"turn {i}") for i in range(40)] + [(100 + i, 0, "user", "same first turn") for i in range(30)]
    df = table(spark, rows)
    assert found(prefix_trie.conversation_trie(df, rebuild=False)) == brute(rows, rebuild=False)
    assert found(prefix_trie.conversation_trie(df)) == brute(rows)
    assert prefix_trie.conversation_trie(table(spark, [])).count() == 0
    assert prefix_trie.conversation_trie(table(spark, rows[:1])).count() == 0


def test_running_totals_of_a_long_segment(spark):
    rng = random.Random(3)
    rows = [(rng.choice((1, 1, 1, 1, 2, 9)), i, rng.randint(-9, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "s bigint, i bigint, v bigint").repartition(7)
    got = scans.running(df, "s", ["i"], {"total": ("v", "sum"), "mask": ("v", "xor")})
    want, sums, masks = set(), defaultdict(int), defaultdict(int)
    for s, i, v in sorted(rows):
        sums[s] += v
        masks[s] ^= v
        want.add((s, i, v, sums[s], masks[s]))
    assert {tuple(r) for r in got.collect()} == want


def test_list_ranks_of_two_lists(spark, small_runs):
    rng = random.Random(4)
    arcs = rng.sample(range(10**6), 900)
    rows = [(a, b, rng.randint(0, 5)) for a, b in zip(arcs[:600], [*arcs[1:600], None])] + [(a, b, 1) for a, b in zip(arcs[600:], [*arcs[601:], None])]
    want, total = {}, 0
    for a, b, w in reversed(rows):
        total = w if b is None else total + w
        want[a] = total
    got = scans.list_ranks(spark.createDataFrame(rows, "arc bigint, next bigint, weight bigint"))
    assert {r["arc"]: r["rank"] for r in got.collect()} == want
