"""Collocations against plain counting, on odd rows, ties and an empty table."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import islice

from dealgrain.llm import collocations as co
from dealgrain.session import local_table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, how):
    seen, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in (1, 2, 3):
                seen[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = set()
    for lang, count in seen.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= how.least}
        scored = []
        for p, a in found.items():
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= how.inside * a for q, b in found.items()):
                continue
            score, k = min((1000000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(islice(sorted(scored), how.top), 1):  # noqa: E741
            out.add((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return out


def table(spark, rows):
    return local_table(spark, [(t, g, "x", "y", 1) for t, g in rows], "text string, lang string, w1 string, bucket string, n int")


def found(df):
    got = [tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(got) == len(set(got))
    return set(got)


def texts(seed, rows=60):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "of", "élan", "a", "New", "York", "City", "x\x0by", "日本", "THE"] + [f"w{i}" for i in range(30)]
    out = []
    for _ in range(rows):
        words = rng.choices(vocabulary, weights=[8, 8, 8, 2, 6, 3, 3, 3, 1, 2, 2] + [1] * 30, k=rng.randint(0, 120))
        text = "".join(w + rng.choice((" ", " ", " ", "  ", "\t", ", ", ". ", "\n", " ;", "?!")) for w in words)
        out.append((text + " new york city" * rng.randint(0, 2), rng.choice(("en", "de", None, "und"))))
    return out


def test_collocations_equal_plain_counts(spark):
    for seed in (1, 2):
        rows = texts(seed)
        for how in (co.Collocations(), co.Collocations(least=3, inside=80, top=15)):
            assert found(co.collocations(table(spark, rows), how=how)) == brute(rows, how)


def test_pieces_and_parts_do_not_change_counts(spark, monkeypatch):
    monkeypatch.setattr(co, "COUNTED_BYTES", 200)
    rows = texts(3)
    assert found(co.collocations(table(spark, rows).repartition(5), how=co.Collocations(least=4))) == brute(rows, co.Collocations(least=4))


def test_odd_rows(spark):
    rows = [(None, "en"), ("", None), (" \t\n ", "en"), (". , ;", "de"), ("a b " * 30_000, "en"), ("a b", None), ("one two three", "fr")] + [("p q r", "es")] * 12 + [("q r", "es")] * 12 + [("p q", "es")]
    how = co.Collocations()
    got = found(co.collocations(table(spark, rows), how=how))
    assert got == brute(rows, how) and {g[0] for g in got} == {"en", "es"}
    # 12 of 24 occurrences of "q r" lie in "p q r": it goes, and so does "p q" (12 of 13).
    assert {g[2] for g in got if g[0] == "es"} == {"p q r"}
    assert co.collocations(table(spark, [])).count() == 0


def test_scores_beyond_64_bits(spark):
    cases = [(10**14 + 7, 10**14 + 9, 10**14 + 11), (999_999_999_999_999,) * 3, (3 * 10**9, 3 * 10**9 + 1, 10**13), (10, 10**17, 10**17)]
    df = spark.createDataFrame(cases, "a bigint, l bigint, r bigint").withColumn("s", co._score("a", "l", "r"))
    assert [r["s"] for r in df.collect()] == [1000000 * a * a // (x * y) for a, x, y in cases]
