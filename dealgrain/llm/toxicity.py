"""Toxicity of documents by a bidirectional gated recurrent network over words and characters.

A word enters as a learned vector of its hashed form and as the mean of learned vectors of its five-byte runs. Overlapping
windows of 32 words, 8 apart, cover every whole text, so any passage of up to 25 words lies in one; a window's states are pooled by attention into one logit,
and a document's score is the calibrated logit of its most toxic window. The network learns from windows of a bounded
sample of labelled documents: of each document the window that it finds most toxic at the time stands for the label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gru import Adam, Params, gradients, new_params, pool, run_side
from .tables import bounded_sample, pick
from .textio import PUNCTUATION, U64, Words, pieces

WINDOW, STRIDE = 32, 8
BUCKETS, RUN_BITS, WORD_SIZE, CHAR_SIZE, HIDDEN, ATTENTION = 1 << 15, 15, 6, 6, 8, 8
#: Words and runs seen in fewer documents of the sample keep a zero vector, so that nothing is learned by heart. A sample with
#: fewer toxic documents than this therefore teaches next to nothing, and scores stay near the share of the label.
LEAST_DOCUMENTS = 10
#: Labelled documents that the network learns from, at most, and the bytes of one of them.
TRAIN_DOCUMENTS, TRAIN_BYTES = 6000, 1 << 15
#: Windows scored at once inside a task.
BLOCK = 4096
#: Words whose run vectors are gathered at once, and documents scored at once in training.
CHUNK, DOCUMENTS = 1 << 15, 256


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, run buckets of every byte, bytes per word (as offsets) and the first word of each text.

    The run of a byte is the byte before it, itself and the three after it, blank outside of its word.
    """
    words = Words(texts, PUNCTUATION, lower=True)
    ids = (words.hash & U64(BUCKETS - 1)).astype(np.int32)
    inner = ~PUNCTUATION[words.data]
    padded = np.concatenate([np.zeros(1, np.uint32), np.where(inner, words.data, 0).astype(np.uint32), np.zeros(4, np.uint32)])
    n = len(inner)
    key, live = padded[:n] * np.uint32(769) + padded[1 : n + 1], np.ones(n, bool)
    for shift in range(1, 4):
        byte = padded[1 + shift : 1 + shift + n]
        live &= byte > 0
        key = key * np.uint32(769) + np.where(live, byte, 0).astype(np.uint32)
    runs = (key * np.uint32(2654435761) >> np.uint32(32 - RUN_BITS)).astype(np.uint16)[inner]
    return ids, runs, np.concatenate([[0], np.cumsum(words.end - words.start)]), words.first


def char_vectors(table: np.ndarray, runs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The mean vector of each word's runs, some words at a time."""
    out = np.zeros((len(at) - 1, table.shape[1]), np.float32)
    for i in range(0, len(out), CHUNK):
        own = at[i : i + CHUNK + 1]
        np.add.reduceat(table[runs[own[0] : own[-1]]], own[:-1] - own[0], axis=0, out=out[i : i + CHUNK])
    return out / np.maximum(np.diff(at), 1)[:, None].astype(np.float32)


def windows(first: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per window: its text, its first word and its words. Every word lies in a window; a text without words has one."""
    count = np.diff(first)
    many = np.maximum(1, -(-(count - (WINDOW - stride)) // stride))
    text = np.repeat(np.arange(len(count)), many)
    place = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    start = place * stride
    return text, first[:-1][text] + start, np.clip(count[text] - start, 0, WINDOW)


@dataclass(frozen=True)
class Scorer:
    """The trained network: word and run vectors, network weights and the calibration of document logits."""

    vectors: np.ndarray
    runs: np.ndarray
    params: Params
    slope: float
    shift: float

    def window_logits(self, ids: np.ndarray, chars: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        p, out = self.params, np.empty(len(start), np.float32)
        gates = {}
        for side in "fb":
            w = p[f"W{side}"]
            table = self.vectors @ w[:WORD_SIZE] + p[f"c{side}"]
            gates[side] = table[ids] + chars @ w[WORD_SIZE:]
            if not len(ids):
                gates[side] = np.zeros((1, w.shape[1]), np.float32)
        last = max(len(ids) - 1, 0)
        for at in range(0, len(start), BLOCK):
            begin, mask = start[at : at + BLOCK], np.arange(WINDOW) < size[at : at + BLOCK, None]
            sides = [run_side(p, s, lambda t, s=s: gates[s][np.minimum(begin + t, last)], mask, False)[0] for s in "fb"]
            out[at : at + BLOCK] = pool(p, np.concatenate(sides, axis=2), mask)[0]
        return out

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Score and number of windows of every text."""
        ids, runs, at, first = encode(texts)
        chars = char_vectors(self.runs, runs, at)
        text, start, size = windows(first, STRIDE)
        logit = self.window_logits(ids, chars, start, size)
        best = np.full(len(first) - 1, -np.inf)
        np.maximum.at(best, text, logit)
        return 1 / (1 + np.exp(-(self.slope * best + self.shift))), np.bincount(text, minlength=len(best))


def _fit_line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic calibration by Newton steps, the slope kept positive."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p) + 1e-6
        g = np.array([((y - p) * x).sum() - 0.1 * (a - 1), (y - p).sum()])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = float(np.clip(a + np.clip(step[0], -1, 1), 0.05, 20)), float(b + np.clip(step[1], -2, 2))
    return a, b


def _log_odds(items: np.ndarray, bounds: np.ndarray, label: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of each item between the documents of either label, and which items are frequent enough.

    ``bounds`` says where the items of each document start. Odds are drawn towards zero by three standard errors, so
    that chance finds start from nothing.
    """
    hits = np.zeros((2, size))
    for i, value in enumerate(label):
        if value >= 0:
            hits[value, np.unique(items[bounds[i] : bounds[i + 1]])] += 1
    positive, negative = (label == 1).sum(), (label == 0).sum()
    odds = np.log((hits[1] + 1) / (positive + 2)) - np.log((hits[0] + 1) / (negative + 2))
    error = 3 * np.sqrt(1 / (hits[1] + 1) + 1 / (hits[0] + 1))
    odds = np.sign(odds) * np.maximum(np.abs(odds) - error, 0)
    frequent = hits.sum(axis=0) >= LEAST_DOCUMENTS
    return np.clip(odds, -1, 4) * frequent, frequent


def fit(ids: np.ndarray, runs: np.ndarray, at: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 4, passes: int = 2, seed: int = 5) -> Scorer:
    """Train on documents given as ``encode`` gives them, with one label each. Every fifth document only calibrates."""
    rng = np.random.default_rng(seed)
    p = new_params(rng, WORD_SIZE + CHAR_SIZE, HIDDEN, ATTENTION)
    vectors = (0.1 * rng.standard_normal((BUCKETS, WORD_SIZE))).astype(np.float32)
    table = (0.1 * rng.standard_normal((1 << RUN_BITS, CHAR_SIZE))).astype(np.float32)
    docs = len(label)
    learning = np.arange(docs) % 5 != 4
    seen = label[learning]
    if not len(seen) or seen.min() == seen.max() or not len(ids):
        flat = float(label.sum()) if docs else 0.0
        return Scorer(vectors, table, p, 0.0, float(np.log((flat + 0.5) / (docs - flat + 0.5))))
    told = np.where(learning, label, -1)
    vectors[:, 0], frequent = _log_odds(ids, first, told, BUCKETS)
    vectors *= frequent[:, None]
    table[:, 0], common = _log_odds(runs, at[first], told, 1 << RUN_BITS)
    table *= common[:, None]
    doc, start, size = windows(first, STRIDE)
    mask = np.arange(WINDOW) < size[:, None]
    guess = vectors[ids, 0] + char_vectors(table[:, :1], runs, at)[:, 0]
    logit = np.concatenate([np.where(m, guess[np.minimum(s[:, None] + np.arange(WINDOW), len(ids) - 1)], -1).max(axis=1) for s, m in zip(np.array_split(start, 64), np.array_split(mask, 64))])
    adam, weight = Adam(0.01), np.where(label == 1, np.sqrt((~(seen == 1)).sum() / seen.sum()), 1.0)
    for turn in range(rounds + 1):
        order = np.lexsort((logit, doc))
        top = order[np.append(doc[order][1:] != doc[order][:-1], True)]  # each document's window with the highest logit
        if turn == rounds:
            held = top[~learning]
            return Scorer(vectors, table, p, *_fit_line(logit[held].astype(float), label[~learning].astype(float)))
        for _ in range(passes):
            for batch in np.array_split(rng.permutation(top[learning]), max(1, int(learning.sum()) // 64)):
                place = np.minimum(start[batch, None] + np.arange(WINDOW), len(ids) - 1)
                _learn(p, adam, vectors, table, (frequent, common), ids, runs, at, place, mask[batch], label[doc[batch]], weight[doc[batch]])
        logit = _all_logits(Scorer(vectors, table, p, 1.0, 0.0), ids, runs, at, first)


def _all_logits(scorer: Scorer, ids: np.ndarray, runs: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Logits of all windows, some documents at a time."""
    out = []
    for i in range(0, len(first) - 1, DOCUMENTS):
        own = first[i : i + DOCUMENTS + 1]
        words = slice(own[0], own[-1])
        chars = char_vectors(scorer.runs, runs, at[own[0] : own[-1] + 1])
        _, start, size = windows(own - own[0], STRIDE)
        out.append(scorer.window_logits(ids[words], chars, start, size))
    return np.concatenate(out)


def _learn(p: Params, adam: Adam, vectors: np.ndarray, table: np.ndarray, free: tuple, ids: np.ndarray, runs: np.ndarray, at: np.ndarray, place: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float = 0.2) -> None:
    """One step on a batch of windows."""
    words, which = np.unique(place, return_inverse=True)
    length = at[words + 1] - at[words]
    inside = np.repeat(at[words] - np.cumsum(length) + length, length) + np.arange(length.sum())
    own = runs[inside]
    chars = char_vectors(table, own, np.concatenate([[0], np.cumsum(length)]))
    x = np.concatenate([vectors[ids[words]], chars], axis=1)[which.reshape(place.shape)]
    _, g, d_x = gradients(p, x, mask, y.astype(np.float32), weight.astype(np.float32))
    adam.step(p, g)
    d_words = np.zeros((len(words), x.shape[2]), np.float32)
    np.add.at(d_words, which.reshape(place.shape)[mask], d_x[mask])
    np.subtract.at(vectors, ids[words], rate * d_words[:, :WORD_SIZE] * free[0][ids[words], None])
    np.subtract.at(table, own, rate * np.repeat(d_words[:, WORD_SIZE:] / length[:, None], length, axis=0) * free[1][own, None])


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", documents: int = TRAIN_DOCUMENTS) -> Scorer:
    """The network from at most ``documents`` labelled documents of at most ``TRAIN_BYTES`` bytes, picked by a hash.

    Null labels, ids and texts are left out. Of repeated labels of one id the largest counts. Without both labels the score
    is the share of the one that was seen.
    """
    known = pick(labels, doc_id=id_column, label=label_column).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    source = pick(docs, doc_id=id_column, text=text_column).where(F.octet_length("text") <= TRAIN_BYTES)
    some = source.join(F.broadcast(bounded_sample(known, documents, 13)), "doc_id")
    some = some.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            ids, runs, at, first = encode(piece.column("text"))
            rows = [(ids[a:b].astype("<i4").tobytes(), runs[at[a] : at[b]].astype("<u2").tobytes(), np.diff(at[a : b + 1]).astype("<i4").tobytes()) for a, b in zip(first[:-1], first[1:])]
            arrays = [piece.column("doc_id"), piece.column("label").cast(pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(3))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "label", "ids", "runs", "lengths"])

    schema = f"doc_id {dict(source.dtypes)['doc_id']}, label bigint, ids binary, runs binary, lengths binary"
    found = some.mapInArrow(cut, schema).toArrow().sort_by("doc_id")
    ids, runs, lengths = (np.frombuffer(b"".join(found.column(c).to_pylist()), kind) for c, kind in (("ids", "<i4"), ("runs", "<u2"), ("lengths", "<i4")))
    first = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found.column("ids").to_pylist()])]).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return fit(ids, runs, at, first, found.column("label").to_numpy().astype(np.int64))


def score_toxicity(docs: DataFrame, scorer: Scorer, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1) and windows.

    Null, empty and blank texts have one window without words; null ids and repeated rows keep their own rows; an empty
    table gives an empty result; other columns are ignored.
    """
    source = pick(docs, doc_id=id_column, text=text_column)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # about a megabyte, whatever the data

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 1 << 20):
            value, count = shared.value.scores(piece.column("text"))
            arrays = [piece.column("doc_id"), pa.array(value, pa.float64()), pa.array(count, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "windows"])

    return source.mapInArrow(score, f"doc_id {dict(source.dtypes)['doc_id']}, score double, windows bigint")
