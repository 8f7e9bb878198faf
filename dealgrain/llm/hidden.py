"""A hidden Markov language model over word classes.

A state emits a word class and the class emits the word. The class of a word is fixed (a hash of a short word, or of the
last three bytes of a longer one), so the tables of the model are bounded, while the words of a class and their counts
come from the whole corpus. Baum-Welch counts are worked out per task, summed over all tasks as whole numbers of fixed
point (so the sum does not depend on the order) and give the next model. A text's likelihood comes from the scaled
forward recursion over its classes, which is exact whatever its length, and from the corpus counts of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .tables import pick
from .textio import U64, Words, by_length, group_sums, pieces, short_hashes

STATES, CLASSES = 8, 4096
END = CLASSES
#: Tokens of a text that one run covers, in training and in scoring; runs of longer texts are joined by their transfer matrices.
STRETCH = 4096
#: Baum-Welch rounds; every round reads every training document.
ROUNDS = 3
PIECE = 6 << 20
#: Compression of a piece's stored tokens.
CODEC = "zstd"
#: Fixed point of expected counts.
UNIT = 1 << 12
ADD = 0.1


@dataclass(frozen=True)
class Model:
    """First-state, transition and emission probabilities."""

    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def classes_of(words: Words) -> np.ndarray:
    length = words.end - words.start
    long = length > 4
    code = short_hashes(words.data, np.where(long, words.end - 3, words.start), np.where(long, 3, length), 4)
    code ^= long * U64(0x5851F42D4C957F2D)
    return (code % U64(CLASSES)).astype(np.int64)


def sequences(words: Words, values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of each text's words followed by ``end``, and where each text starts."""
    first = words.first + np.arange(words.texts + 1)
    out = np.full(first[-1], end, dtype=np.int64)
    inside = np.ones(len(out), bool)
    inside[first[1:] - 1] = False
    out[inside] = values
    return out, first


def starting_model(seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    emit = 0.5 + rng.random((STATES, CLASSES + 1))
    move = np.full((STATES, STATES), 0.1 / max(STATES - 1, 1))
    np.fill_diagonal(move, 0.9)
    even = np.full(STATES, 1 / STATES)
    return Model(even, move, emit / emit.sum(axis=1, keepdims=True))


def _runs(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by falling length, and how many of them are still running at each step."""
    order = np.argsort(-length, kind="stable")
    running = len(length) - np.searchsorted(np.sort(length), np.arange(length.max() if len(length) else 0), side="right")
    return order, running


def _advance(model: Model, values: np.ndarray, start: np.ndarray, length: np.ndarray, prior: np.ndarray, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised forward vectors after ``length`` tokens from ``start`` on, and the logs of what was divided out.

    ``prior`` holds each row's state probabilities at its first token. Inside, states are rows and runs are columns, so that
    sums over states go over whole arrays.
    """
    order, running = _runs(length)
    at, state, log = start[order], np.ascontiguousarray(prior[order].T), np.zeros(len(order))
    move = np.ascontiguousarray(model.move.T)
    ahead, seen, total = np.empty(state.size), np.empty(state.size), np.empty(len(order))
    for t, n in enumerate(running):
        now, own = ahead[: STATES * n].reshape(STATES, n), state[:, :n]
        if t:
            np.matmul(move, own, out=now)
        else:
            now[:] = own
        now *= np.take(emitted, values[at[:n] + t], axis=1, out=seen[: STATES * n].reshape(STATES, n), mode="clip")
        np.sum(now, axis=0, out=total[:n])
        np.divide(now, total[:n], out=own)
        log[:n] += np.log(total[:n])
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return state.T[back], log[back]


def log_likelihood(model: Model, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log of each sequence's probability."""
    count = np.diff(first)
    many = np.maximum(1, -(-count // STRETCH))
    emitted = np.ascontiguousarray(model.emit)
    prior = np.tile(model.first, (len(count), 1))
    state, log = _advance(model, values, first[:-1], np.minimum(count, STRETCH), prior, emitted)
    for text in np.flatnonzero(many > 1):
        starts = first[text] + STRETCH * np.arange(1, many[text])
        size = np.minimum(first[text + 1] - starts, STRETCH)
        rows, logs = _advance(model, values, np.repeat(starts, STATES), np.repeat(size, STATES), np.tile(model.move, (len(starts), 1)), emitted)
        for run in range(len(starts)):  # one small matrix per stretch
            own = slice(run * STATES, (run + 1) * STATES)
            peak = logs[own].max()
            ahead = (state[text] * np.exp(logs[own] - peak)) @ rows[own]
            total = ahead.sum()
            state[text], log[text] = ahead / total, log[text] + peak + np.log(total)
    return log


def _joined_runs(model: Model, values: np.ndarray, start: np.ndarray, length: np.ndarray, place: np.ndarray, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of longer texts, in order: state probabilities at the end of the run before, and how likely what follows
    the run is from each state (up to a factor). ``place`` counts a text's runs from 0."""
    runs = len(start)
    prior = np.where((place == 0)[:, None, None], model.first, model.move)
    rows, logs = _advance(model, values, np.repeat(start, STATES), np.repeat(length, STATES), prior.reshape(-1, STATES), emitted)
    logs = logs.reshape(runs, STATES)
    transfer = rows.reshape(runs, STATES, STATES) * np.exp(logs - logs.max(axis=1, keepdims=True))[:, :, None]
    before, after = np.full((runs, STATES), 1 / STATES), np.ones((runs, STATES))
    for i in range(runs - 1):  # one small matrix per run
        if place[i + 1]:
            ahead = before[i] @ transfer[i]
            before[i + 1] = ahead / ahead.sum()
    for i in range(runs - 1, 0, -1):
        if place[i]:
            ahead = transfer[i] @ after[i]
            after[i - 1] = ahead / ahead.sum()
    return before, after


def expected_counts(model: Model, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """First-state, transition and emission counts of the sequences in one flat vector.

    Long texts are worked on in runs; what a run knows of the text before and after it makes the counts those of the whole text.
    """
    count = np.diff(first)
    many = np.maximum(1, -(-count // STRETCH))
    text = np.repeat(np.arange(len(count)), many)
    place = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    start = first[:-1][text] + STRETCH * place
    length = np.minimum(first[1:][text] - start, STRETCH)
    emitted = np.ascontiguousarray(model.emit)
    before, after = np.full((len(text), STATES), 1 / STATES), np.ones((len(text), STATES))
    long = np.flatnonzero(many[text] > 1)
    before[long], after[long] = _joined_runs(model, values, start[long], length[long], place[long], emitted)
    order, running = _runs(length)
    at, before, after = start[order], np.ascontiguousarray(before[order].T), np.ascontiguousarray(after[order].T)
    opening = (place == 0)[order]
    offsets = np.concatenate([[0], np.cumsum(running)])
    # States are rows and tokens are columns, so that sums over states go over whole arrays.
    forward = np.empty((STATES, offsets[-1]))
    scale = np.empty(offsets[-1])
    token = np.empty(offsets[-1], np.int64)
    move = np.ascontiguousarray(model.move.T)
    state = np.where(opening, model.first[:, None], move @ before)
    ahead, seen = np.empty(state.size), np.empty(state.size)  # kept for all steps: memory for every step would cost more than the sums
    for t, n in enumerate(running):
        own = slice(offsets[t], offsets[t + 1])
        token[own] = values[at[:n] + t]
        now = ahead[: STATES * n].reshape(STATES, n)
        if t:
            np.matmul(move, forward[:, offsets[t - 1] : offsets[t - 1] + n], out=now)
        else:
            now[:] = state
        now *= np.take(emitted, token[own], axis=1, out=seen[: STATES * n].reshape(STATES, n), mode="clip")
        np.sum(now, axis=0, out=scale[own])
        np.divide(now, scale[own], out=forward[:, own])
    # Runs end in falling order, so the last token of the i-th run stands i places after the first of its step.
    ends = forward[:, offsets[length[order] - 1] + np.arange(len(order))]
    moves = np.zeros((STATES, STATES))
    back = after / (ends * after).sum(axis=0)
    for t in range(len(running) - 1, 0, -1):
        n, own, earlier = running[t], slice(offsets[t], offsets[t + 1]), slice(offsets[t - 1], offsets[t - 1] + running[t])
        flow = np.take(emitted, token[own], axis=1, out=seen[: STATES * n].reshape(STATES, n), mode="clip")
        flow *= back[:, :n]
        flow /= scale[own]
        moves += forward[:, earlier] @ flow.T
        forward[:, own] *= back[:, :n]  # now the probability of each state given the whole text
        np.matmul(model.move, flow, out=back[:, :n])
    heads = slice(0, offsets[1] if len(running) else 0)
    moves += before[:, ~opening] @ (emitted[:, token[heads]] * back / scale[heads])[:, ~opening].T
    forward[:, heads] *= back
    firsts = forward[:, heads][:, opening].sum(axis=1)
    emits = np.stack([np.bincount(token, weights=forward[k], minlength=CLASSES + 1) for k in range(STATES)])
    return np.concatenate([firsts, (moves * model.move).ravel(), emits.ravel()])


def next_model(counts: np.ndarray) -> Model:
    """The model that the counts ask for; every class keeps a little probability in every state."""
    firsts, moves, emits = np.split(counts, [STATES, STATES + STATES * STATES])
    moves, emits = moves.reshape(STATES, STATES), emits.reshape(STATES, -1)
    plain = emits.sum(axis=0) + ADD
    plain /= plain.sum()
    total = emits.sum(axis=1)
    emit = (emits + plain) / (total + 1)[:, None]
    move = (moves + 0.01) / (moves.sum(axis=1, keepdims=True) + 0.01 * STATES)
    return Model((firsts + 0.01) / (firsts.sum() + 0.01 * STATES), move, emit)


def baum_welch_step(texts: DataFrame, model: Model) -> Model:
    """One pass over all ``texts``: counts per task, one sum per parameter, the next model."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # a fixed number of parameters

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STATES + STATES * STATES + STATES * (CLASSES + 1))
        for piece in pieces(by_length(batches, "text"), "text"):
            words = Words(piece.column("text"), lower=True)
            total += expected_counts(shared.value, *sequences(words, classes_of(words), END))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.rint(total[used] * UNIT).astype(np.int64))], names=["place", "amount"])

    sums = texts.select("text").mapInArrow(count, "place bigint, amount bigint").groupBy("place").agg(F.sum("amount").alias("amount")).toArrow()
    counts = np.zeros(STATES + STATES * STATES + STATES * (CLASSES + 1))
    counts[sums.column("place").to_numpy()] = sums.column("amount").to_numpy() / UNIT
    return next_model(counts)


def train(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", rounds: int = ROUNDS) -> Model:
    """Baum-Welch from a starting model, each round over all texts. An empty table gives a model of smoothing alone."""
    source, model = pick(df, doc_id=id_column, text=text_column), starting_model()
    for _ in range(rounds):
        model = baum_welch_step(source, model)
    return model


def _tokenised(source: DataFrame, model: Model) -> DataFrame:
    """One row per piece of some megabytes: its documents, their class likelihoods and words, and its vocabulary."""
    doc_type = dict(source.dtypes)["doc_id"]
    schema = f"piece string, doc_id array<{doc_type}>, training array<boolean>, log_class array<double>, sizes array<int>, tokens binary, words array<binary>, classes array<int>, uses array<bigint>"
    shared = source.sparkSession.sparkContext.broadcast(model)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, piece in enumerate(pieces(by_length(batches, "text"), "text", PIECE)):
            words = Words(piece.column("text"), lower=True)
            kind = classes_of(words)
            log = log_likelihood(shared.value, *sequences(words, kind, END))
            codes, keys = pd.factorize(words.hash)
            rank = np.empty(len(keys), np.int64)
            order = np.argsort(-np.bincount(codes, minlength=len(keys)), kind="stable")
            rank[order] = np.arange(len(keys))  # frequent words get small numbers
            codes = rank[codes] if len(codes) else np.zeros(0, np.int64)
            sample = np.zeros(len(keys), np.int64)
            sample[codes[::-1]] = np.arange(len(codes))[::-1]
            training = np.asarray(piece.column("training").to_numpy(zero_copy_only=False), bool)
            uses = np.bincount(codes, weights=training[words.text], minlength=len(keys)).astype(np.int64)
            raw = words.data.tobytes()
            vocabulary = [raw[a:b] for a, b in zip(words.start[sample].tolist(), words.end[sample].tolist())]
            lists = [piece.column("doc_id"), pa.array(training), pa.array(log), pa.array(words.count.astype(np.int32))]
            one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            rest = [pa.array(vocabulary, pa.binary()), pa.array(kind[sample].astype(np.int32)), pa.array(uses)]
            two = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in rest]
            packed = pa.array([pa.compress(codes.astype("<i4").tobytes(), CODEC, asbytes=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([f"{part}-{number}"]), *one, packed, *two], names=["piece", "doc_id", "training", "log_class", "sizes", "tokens", "words", "classes", "uses"])

    return source.mapInArrow(cut, schema)


@dataclass(frozen=True)
class Totals:
    """Training tokens and distinct tokens in all and by class, and training documents."""

    tokens: int
    distinct: int
    class_tokens: np.ndarray
    class_distinct: np.ndarray
    documents: int

    def log_share(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + ADD) / (self.tokens + ADD * (self.distinct + 1)))


def score_texts(df: DataFrame, model: Model, training: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, training, n_tokens, n_known, train_tokens, base_score and score (log10).

    ``training`` marks the rows whose words are counted (null: not). Null, empty and blank texts hold the end token alone;
    null ids and repeated rows keep their own rows; an empty table gives an empty result; other columns are ignored.
    """
    marked = df.withColumn("_training", F.coalesce(training, F.lit(False)))
    source = pick(marked, doc_id=id_column, text=text_column, training="_training")
    stored = materialise(_tokenised(source, model), "tokens")
    entry = F.explode(F.arrays_zip("words", "classes", "uses")).alias("w")
    counts = stored.select(entry).where("w.uses > 0").groupBy(F.col("w.words").alias("word")).agg(F.first("w.classes").alias("class"), F.sum("w.uses").alias("uses"))
    counts = materialise(counts, "counts")
    totals = _totals(stored, counts)
    place = F.posexplode("words").alias("place", "word")
    known = stored.select("piece", place).join(counts.select("word", "uses"), "word", "left")
    # At most one entry per distinct word of a piece, so the lists are bounded by the piece.
    looked_up = known.groupBy("piece").agg(F.collect_list(F.struct("place", F.coalesce("uses", F.lit(0)).alias("uses"))).alias("found"))
    joined = stored.select("piece", "doc_id", "training", "log_class", "sizes", "tokens", "classes").join(looked_up, "piece", "left")
    doc_type = dict(source.dtypes)["doc_id"]
    schema = f"doc_id {doc_type}, training boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                yield _scored(row, totals)

    return joined.mapInArrow(add, schema)


def _totals(stored: DataFrame, counts: DataFrame) -> Totals:
    by_class = counts.groupBy("class").agg(F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("words")).toArrow()  # one row per class
    documents = stored.select(F.sum(F.size(F.filter("training", lambda t: t)).cast("bigint"))).first()[0] or 0
    tokens, distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    kind = by_class.column("class").to_numpy()
    tokens[kind], distinct[kind] = by_class.column("uses").to_numpy(), by_class.column("words").to_numpy()
    return Totals(int(tokens.sum()) + documents, int(distinct.sum()) + (documents > 0), tokens, distinct, documents)


def _scored(row: dict, totals: Totals) -> pa.RecordBatch:
    sizes = np.asarray(row["sizes"].values.to_numpy(), np.int64)
    tokens = np.frombuffer(pa.decompress(row["tokens"].as_py(), 4 * int(sizes.sum()), CODEC), "<i4")
    kind = np.asarray(row["classes"].values.to_numpy(), np.int64)
    uses = np.zeros(len(kind), np.int64)
    if row["found"].is_valid:
        found = row["found"].values
        uses[found.field("place").to_numpy()] = found.field("uses").to_numpy()
    first = np.concatenate([[0], np.cumsum(sizes)])
    plain = totals.log_share(uses)
    within = np.log10((uses + ADD) / (totals.class_tokens[kind] + ADD * (totals.class_distinct[kind] + 1)))
    ends = int(totals.documents > 0)
    base = group_sums(plain[tokens], first) + totals.log_share(np.array([float(totals.documents)]))[0]
    score = group_sums(within[tokens], first) + np.asarray(row["log_class"].values.to_numpy()) / np.log(10)
    known = group_sums((uses > 0)[tokens], first) + ends
    n = len(sizes)
    arrays = [row["doc_id"].values, row["training"].values, pa.array(sizes + 1), pa.array(known), pa.array(np.full(n, totals.tokens)), pa.array(base), pa.array(score)]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "training", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
