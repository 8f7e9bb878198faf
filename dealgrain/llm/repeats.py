"""Passages that repeat within or across documents, by seed and extend over winnowed anchors.

Seeds are runs of ``seed`` words. Of the seeds in a window of ``least`` words the one that hashes lowest (the first of equal
ones) is its anchor. The choice depends on the window's words alone, so equal windows have equal anchors at equal places, and a
passage of ``least`` words is never without one. Neighbouring windows with one anchor form its reach.

Documents meet on anchors that occur twice. A match is extended both ways at once over the whole reach: occurrences whose
reach is equal word by word (by hash) repeat as a whole. Where the reaches of an anchor differ, single extensions, l words to the
left and r to the right with l + seed + r = least, are compared for the occurrences that stand alone, with one witness of every
group of equal reaches. Overlapping and touching extensions are one maximal repeat.

Nothing is compared in pairs: an anchor's occurrences meet in a hash aggregation, a row each, so a passage that a third of all
documents hold costs rows in proportion to its occurrences. Texts are read once for the anchors, once for the open extensions of
documents that have some, and once for the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .tables import pick
from .textio import U64, Words, pieces, signed, span_hasher

#: Documents' references are sent to all tasks up to this size; above, texts are joined by a shuffle.
SENT_BYTES, REFERENCE_BYTES = 32 << 20, 24


@dataclass(frozen=True)
class Repeats:
    """Windows of ``least`` words, chosen by seeds of ``seed`` words."""

    least: int = 35
    seed: int = 12

    @property
    def seeds(self) -> int:
        """Seeds that a window holds."""
        return self.least - self.seed + 1


def lowest_places(values: np.ndarray, size: int) -> np.ndarray:
    """Place of the lowest of each ``size`` neighbours, the first of equal ones, by doubling."""
    place, have = np.arange(len(values)), 1
    while have < size:
        step = min(have, size - have)
        left, right = place[: len(place) - step], place[step:]
        place = np.where(values[right] < values[left], right, left)
        have += step
    return place


def reaches(words: Words, how: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor: hash of its seed, hash of all words of its reach, first and last window (by word number in the batch)."""
    n = len(words.start) - how.least + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = span_hasher(words.hash)
    at = np.arange(len(words.start) - how.seed + 1)
    seed = of(at, at + how.seed)
    start = np.flatnonzero(words.text[:n] == words.text[how.least - 1 :])
    anchor = lowest_places(seed, how.seeds)[start]
    if not len(start):
        return np.zeros(0, U64), np.zeros(0, U64), start, start
    fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
    heads = np.flatnonzero(fresh)
    first, last = start[heads], start[np.append(heads[1:], len(start)) - 1]
    return seed[anchor[heads]], of(first, last + how.least), first, last


def referenced(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, text and ref, a hash of both; rows that repeat both share it."""
    return pick(df, doc_id=id_column, text=text_column).withColumn("ref", F.xxhash64("doc_id", "text"))


def _anchors(docs: DataFrame, how: Repeats) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words = Words(piece.column("text"))
            key, wide, first, last = reaches(words, how)
            text = words.text[first]
            begin = words.first[text]
            arrays = [piece.column("ref").take(pa.array(text)), pa.array(signed(key)), pa.array(signed(wide))]
            arrays += [pa.array((first - begin).astype(np.int32)), pa.array((last - begin).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["ref", "key", "wide", "first", "last"])

    return docs.select("ref", "text").mapInArrow(cut, "ref bigint, key bigint, wide bigint, first int, last int")


def _listed(docs: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The documents of ``lists`` (one row per ref) with their list, and all others; only one table if the refs are many.

    Texts are shuffled for documents with a list only, as long as the references may be sent.
    """
    if lists.count() * REFERENCE_BYTES > SENT_BYTES:
        return docs.join(lists, "ref", "left"), None
    refs = F.broadcast(lists.select("ref"))
    return docs.join(refs, "ref", "left_semi").join(lists, "ref"), docs.join(refs, "ref", "left_anti")


def _extensions(docs: DataFrame, runs: DataFrame, how: Repeats) -> DataFrame:
    """ref, start, key, window and single for every extension within the given reaches; ``window`` is the hash of its words."""
    held = F.struct("first", "last", "key", "single")
    lists = materialise(runs.groupBy("ref").agg(F.collect_set(held).alias("runs")), "runs")  # at most the text's own anchors
    texts = _listed(docs.select("ref", "text"), lists)[0].where("runs IS NOT NULL")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words = Words(piece.column("text"))
            of = span_hasher(words.hash)
            listed = piece.column("runs")
            flat, size = listed.flatten(), listed.value_lengths().to_numpy()
            first, last, key = (flat.field(c).to_numpy() for c in ("first", "last", "key"))
            single = flat.field("single").to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(piece.num_rows), size)
            count = last.astype(np.int64) - first + 1
            run = np.repeat(np.arange(len(first)), count)
            place = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + first[run]
            start = words.first[text[run]] + place
            arrays = [piece.column("ref").take(pa.array(text[run])), pa.array(place.astype(np.int32)), pa.array(key[run])]
            arrays += [pa.array(signed(of(start, start + how.least))), pa.array(single[run])]
            yield pa.RecordBatch.from_arrays(arrays, names=["ref", "start", "key", "window", "single"])

    return texts.select("ref", "text", "runs").mapInArrow(cut, "ref bigint, start int, key bigint, window bigint, single boolean")


def repeat_spans(docs: DataFrame, how: Repeats) -> DataFrame:
    """ref and spans (start and end in words, not joined yet) of a ``referenced`` table, for documents with a repeat."""
    anchors = materialise(_anchors(docs, how), "anchors")
    # Counts are stored before they are joined back, so that the rows of a crowded anchor can be split over tasks.
    keys = anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.min("wide") == F.max("wide")).alias("same")).where("n > 1")
    hits = materialise(anchors.join(materialise(keys.select("key", "same"), "shared-anchors"), "key"), "hits")
    apart = hits.where("NOT same")
    groups = apart.groupBy("key", "wide").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ref", "first")).alias("witness"))
    told = materialise(apart.join(materialise(groups, "reaches"), ["key", "wide"]).withColumn("single", F.col("n") == 1), "extended")
    whole = hits.where("same").unionByName(told.where("NOT single"), allowMissingColumns=True)
    witness = F.col("witness") == F.struct("ref", "first")
    single = materialise(_extensions(docs, told.where(F.col("single") | witness), how), "extensions")
    shared = single.groupBy("key", "window").agg(F.count(F.lit(1)).alias("n"), F.max("single").alias("any")).where("n > 1 AND any")
    parts = single.where("single").join(materialise(shared.select("key", "window"), "shared-extensions"), ["key", "window"], "left_semi")
    span = lambda a, b: F.struct(F.col(a).cast("bigint").alias("start"), (F.col(b) + how.least).cast("bigint").alias("end"))
    found = whole.select("ref", span("first", "last").alias("span")).unionByName(parts.select("ref", span("start", "start").alias("span")))
    return found.groupBy("ref").agg(F.collect_set("span").alias("spans"))  # at most the text's own windows


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans as one."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    heads = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return start[heads], reach[np.append(heads[1:], len(start)) - 1]


def kept_bytes(words: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text joined by one space, as bytes of all texts in a row and where each text starts."""
    data = words.data.copy()
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, words.start[kept], 1)
    np.add.at(inside, words.end[kept], -1)
    mask = np.cumsum(inside)[:-1] > 0
    # The byte after a word that another kept word of its text follows is a blank.
    goes_on = words.end[kept[:-1]][words.text[kept[1:]] == words.text[kept[:-1]]]
    data[goes_on] = 32
    mask[goes_on] = True
    sizes = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sizes[1:])
    return data[mask], sizes[words.offsets]


SPANS = "array<struct<start:bigint,`end`:bigint>>"
SPAN_LIST = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def remove_repeats(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", how: Repeats = Repeats()) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text (the kept words, joined by spaces) and spans.

    Spans are the maximal repeats of ``least`` words or more (start and end in words, the end exclusive); all their words go,
    every copy. Whether a window repeats is judged on the texts as given. Repeated rows repeat each other, equal ids or not.
    Words are runs of anything but space and tab to carriage return, compared as written. Null, empty and short texts have no spans;
    null ids are kept; an empty table gives an empty result; other columns are ignored.
    """
    docs = referenced(df, id_column, text_column)
    lists = materialise(repeat_spans(docs, how), "spans")
    listed, rest = _listed(docs, lists)
    if rest is not None:
        listed = listed.unionByName(rest.withColumn("spans", F.lit(None).cast(SPANS)))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words = Words(piece.column("text"))
            gone, out = np.zeros(len(words.start) + 1, np.int64), []
            for i, spans in enumerate(piece.column("spans")):
                if not spans.is_valid:
                    out.append(None)
                    continue
                start, end = merged(*(spans.values.field(c).to_numpy() for c in ("start", "end")))
                np.add.at(gone, words.first[i] + start, 1)
                np.add.at(gone, words.first[i] + end, -1)
                out.append([{"start": int(a), "end": int(b)} for a, b in zip(start, end)])
            removed = np.cumsum(gone)[:-1] > 0
            text, offsets = kept_bytes(words, np.flatnonzero(~removed))
            kept = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text.tobytes()))
            lost = np.bincount(words.text[removed], minlength=words.texts)
            arrays = [piece.column("doc_id"), pa.array(words.count), pa.array(lost), kept.cast(pa.string()), pa.array([x or [] for x in out], SPAN_LIST)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_text", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return listed.select("doc_id", "text", "spans").mapInArrow(remove, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string, spans {SPANS}")
