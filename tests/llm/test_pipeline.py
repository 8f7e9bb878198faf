"""The pipeline against brute force, stage by stage, on a small table with odd rows and clashing names."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from dealgrain.llm import pii, templates
from dealgrain.session import local_table

from .conftest import CLASHING, prose
from .test_operators import QUESTION, brute_classes, brute_leaks, brute_measures, edited

ITEMS = [(1, QUESTION), (2, "Paris."), (3, None), (4, "the shop sells 7 apples and 9 pears for 12 dollars to Anna today")]


def corpus():
    rng = random.Random(11)
    rows = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, prose(1, 30_000)), (5, "short one"), (None, prose(3, 90)), (6, "UP!! " * 60), (7, "x y z " * 40)]
    rows += [(10 + i, prose(100 + i, rng.randint(40, 160))) for i in range(25)]
    rows += [(60 + i, edited(prose(200, 120), i, i % 3)) for i in range(9)] + [(80, prose(201, 70))] * 3 + [(81, prose(201, 70)), (79, prose(201, 70).upper())]
    other = QUESTION.replace("45 km", "60 miles").replace("Anna", "Peter")
    rows += [(90, f"{prose(301, 50)}. {QUESTION}. {prose(302, 20)}"), (91, f"{prose(303, 50)}. {other}. {prose(304, 20)}"), (92, f"paris {prose(305, 80)} Paris. {prose(306, 9)}")]
    rows += [(100 + i, f"{prose(400 + i, 60)} write to ann{i}@mail.example.com or +1 (555) 010-{1000 + i} from 10.0.{i}.7 {prose(500 + i, 10)}") for i in range(12)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents with columns whose names the operators use inside, and benchmark."""
    path = str(tmp_path_factory.mktemp("corpus"))
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    rows = [(i, t, "en", "web", len(t or ""), *(f"{c}{n}" for c in CLASHING)) for n, (i, t) in enumerate(corpus())]
    local_table(spark, rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}").write.parquet(f"{path}/documents.parquet")
    local_table(spark, ITEMS, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def passes(text):
    """The default rules, spelled out."""
    n, chars, symbols, dup, repeated = brute_measures(text)
    text = text or ""
    upper, lower = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    lines = sum(1 for x in text.encode().split(b"\n") if x.split())
    bad = n < 50 or 100 * repeated > 50 * n or 100 * symbols > 10 * n or 100 * upper > 50 * (upper + lower)
    return not (bad or 100 * text.count("!") > 20 * n or 100 * dup > 30 * lines or chars > 20 * n)


def pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near-duplicates", "benchmark decontamination", "personal data", "packing"]
    (_, quality), (_, near), (_, leaks), (_, personal), (_, pack) = corpus_pipeline.STAGES

    good = quality(spark, docs, folder)
    want = Counter((i, t) for i, t in corpus() if passes(t))
    assert pairs(good) == want and good.columns == docs.columns and len(want) > 40

    one = near(spark, good, folder)
    rows = [(r["doc_id"], r["text"]) for r in good.select("doc_id", "text").collect()]
    classes = defaultdict(set)
    for (i, t), label in zip(rows, brute_classes(rows)):
        classes[label if i is not None else "no id"].add((i, t))
    got = pairs(one)
    assert one.columns == docs.columns and set(got.values()) == {1} and len(got) == len(classes)
    assert all(sum(got[row] for row in members) == 1 and min((i for i, _ in members if i is not None), default=None) == next(i for i, t in got if (i, t) in members) for members in classes.values())

    clean = leaks(spark, one, folder)
    found = brute_leaks(list(got), ITEMS, templates.Matching())
    leaked = {doc for (doc, _), (is_leak, _) in found.items() if is_leak}
    assert pairs(clean) == Counter({row: 1 for row in got if row[0] not in leaked}) and leaked == {90, 91}

    safe = personal(spark, clean, folder)
    detector = pii.train(clean)
    want = Counter((i, pii.redacted(t, detector.spans(t))) for i, t in pairs(clean))
    assert pairs(safe) == want and safe.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"]) for r in safe.collect())
    assert all("[EMAIL]" in t and "[PHONE]" in t and "[IP]" in t for i, t in want if i is not None and 100 <= i < 112)

    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    told = defaultdict(list)
    for r in pack(spark, safe, folder).collect():
        told[r["doc_id"]].append(r)
    for i, t in want:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        own = sorted(told[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in own]
    assert set(told) == {i for i, _ in want}


def test_run_applies_all_stages(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert Counter(map(tuple, found.select(fields).collect())) == Counter(map(tuple, docs.select(fields).collect()))


def test_run_on_an_empty_table(spark, folder, tmp_path):
    empty = str(tmp_path)
    for table in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{table}.parquet").where("false").write.parquet(f"{empty}/{table}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
