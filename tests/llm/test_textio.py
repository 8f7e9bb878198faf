from __future__ import annotations

import numpy as np
import pyarrow as pa

from dealgrain.llm import textio
from dealgrain.llm.textio import BLANKS, PUNCTUATION, SPAN, Words, pieces, rolling

TEXTS = ["a bb  ccc\n", None, "", "Äx y\tz", "w" * (SPAN + 7) + " end", " bb a", "one.two,three"]


def test_words_match_a_plain_split():
    words = Words(pa.array(TEXTS))
    found = [words.string(i) for i in range(len(words.start))]
    assert found == [w.decode() for t in TEXTS for w in (t or "").encode().split()]
    assert words.count.tolist() == [len((t or "").encode().split()) for t in TEXTS]


def test_equal_words_hash_equally_and_others_do_not():
    words = Words(pa.array(TEXTS[:4] + TEXTS[5:]))
    names = [words.string(i) for i in range(len(words.start))]
    assert len(set(zip(names, words.hash.tolist()))) == len(set(names)) == len(set(words.hash.tolist()))


def test_lower_case_and_slices():
    array = pa.array(["skip", "AbC É", "abc é"]).slice(1)
    words = Words(array, lower=True)
    assert words.hash[0] == words.hash[2] and words.hash[1] != words.hash[3]
    assert Words(pa.array(["one.two,three"]), PUNCTUATION).count.tolist() == [3]


def test_windows_stay_inside_texts():
    at, key = Words(pa.array(["a b c", "a b", "b c"]), BLANKS).windows(2)
    assert at.tolist() == [0, 1, 3, 5] and key[0] == key[2] and key[1] == key[3]
    assert len(rolling(np.arange(3, dtype=np.uint64), 5)) == 0


def test_pieces_are_bounded_but_for_single_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10, None, "y" * 50, "z", "", "w" * 9])], names=["text"])
    found = [p.column("text").to_pylist() for p in pieces(iter([batch]), "text", 12)]
    assert sum(found, []) == batch.column("text").to_pylist()
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= 12 for p in found)
    assert list(pieces(iter([batch.slice(0, 0)]), "text")) == []


def test_short_hashes_are_those_of_spans():
    words = textio.Words(pa.array(["a bc def ghij é xyz", None, "", "  k  "]))
    length = words.end - words.start
    assert (textio.short_hashes(words.data, words.start, length, 4) == words.hash).all()
    assert not len(textio.short_hashes(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), 4))


def test_pieces_by_length_hold_texts_of_like_length():
    # One long text in every twenty: in the given order each piece runs as long as its longest text.
    data = [(i, "w" * (1000 if i % 20 == 0 else 10)) for i in range(200)] + [(200, None)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in data]), pa.array([t for _, t in data])], names=["id", "text"])

    def steps(found):
        return sum(max(len(t or "") for t in piece.column("text").to_pylist()) for piece in found)

    cut = list(textio.pieces(textio.by_length(iter([batch]), "text"), "text", 2000))
    assert sorted((r["id"], r["text"]) for piece in cut for r in piece.to_pylist()) == data
    assert steps(cut) < 0.8 * steps(textio.pieces(iter([batch]), "text", 2000))
    assert not list(textio.pieces(textio.by_length(iter([batch.slice(0, 0)]), "text"), "text"))
