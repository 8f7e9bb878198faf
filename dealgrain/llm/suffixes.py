"""Repeated passages across documents, found with a sparse suffix array over words.

Suffixes are kept only at minimiser positions: of every run of neighbouring places the one whose next words hash lowest.
Equal passages choose equal places, so a passage of ``least`` words always holds a kept suffix whose first ``context``
words lie inside it. Suffixes with the same context are sorted by the words that follow and, in a second array, by the
words before, both in lexicographic order of short word codes. Neighbours of different documents are paired, and every
pair is extended left and right over the words of both texts. Where a suffix shares its context with another document,
the few windows of ``least`` words around it that no extension covered are then compared by hash, so that a passage whose
two texts were nobody's neighbours is found as well.

The sort is a range partitioning with the document and place as last keys, so a passage that millions of documents share
is spread over many tasks; a suffix meets its neighbours only, so such a passage costs two pairs per occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .tables import pick
from .textio import U64, Words, mix, pieces, rolling, signed

#: Size up to which the references of texts to compare are sent to all tasks; above, they are joined.
SENT_BYTES, REFERENCE_BYTES = 32 << 20, 24


@dataclass(frozen=True)
class Passages:
    """Passages of ``least`` words or more; a suffix is chosen by its first ``seed`` words and grouped by its first ``context``."""

    least: int = 50
    seed: int = 8
    context: int = 20

    @property
    def reach(self) -> int:
        """Places of which one is kept."""
        return self.least - self.context + 1


def _sliding(values: np.ndarray, size: int, pick_one: np.ufunc) -> np.ndarray:
    """The smallest or largest of each ``size`` neighbours, by doubling."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = pick_one(out[: len(out) - step], out[step:])
        have += step
    return out


def _prefix_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums that give the hash of any run of words, and the factors that move it to the origin."""
    base = 0xD6E8FEB86659FD93

    def powers(of: int) -> np.ndarray:
        out = np.full(len(hashes) + 1, of, dtype=U64)
        out[0] = 1
        return np.cumprod(out, dtype=U64)

    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * powers(base)[:-1], out=sums[1:])
    return sums, powers(pow(base, -1, 1 << 64))


def _codes(code: np.ndarray, at: np.ndarray, step: int, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """The codes of the next 20 words in one direction, ten to a number that sorts like them; 0 beyond the text."""
    out = []
    for part in range(2):
        packed = np.zeros(len(at), np.int64)
        for k in range(10 * part, 10 * part + 10):
            place = at + step * k
            inside = (place >= low) & (place < high)
            packed = packed * 64 + np.where(inside, code[np.clip(place, 0, len(code) - 1)], 0)
        out.append(packed)
    return out


def anchors(words: Words, how: Passages) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words (by number in the batch) where a kept suffix starts, the hash of its context, the codes after it and before it."""
    n, reach = len(words.start), how.reach
    starts = n - how.least + 1
    if starts <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64), [np.zeros(0, np.int64)] * 4
    seed = rolling(words.hash, how.seed)[: starts + reach - 1]
    fits = words.text[:starts] == words.text[how.least - 1 :][:starts]
    # In a run of one repeated seed only every so many places count, or all of them would be equal lowest ones.
    same = np.concatenate([[False], seed[1:] == seed[:-1]])
    run = np.arange(len(seed)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(seed))))
    seed = np.where(run % reach == 0, seed, np.iinfo(np.uint64).max)
    lowest = np.where(fits, _sliding(seed, reach, np.minimum), 0)
    padded = np.concatenate([np.zeros(reach - 1, U64), lowest, np.zeros(reach - 1, U64)])
    at = np.flatnonzero(_sliding(padded, reach, np.maximum) == seed)
    sums, down = _prefix_hashes(words.hash)
    key = mix((sums[at + how.context] - sums[at]) * down[at])
    low, high = words.first[:-1][words.text[at]], words.first[1:][words.text[at]]
    code = np.maximum(words.hash >> U64(58), U64(1)).astype(np.int64)
    return at, key, _codes(code, at + how.context, 1, low, high) + _codes(code, at - 1, -1, low, high)


SUFFIX = ["key", "after1", "after2", "before1", "before2"]


def _suffixes(source: DataFrame, how: Passages) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words = Words(piece.column("text"))
            at, key, codes = anchors(words, how)
            place = at - words.first[words.text[at]]
            ref = piece.column("ref").take(pa.array(words.text[at]))
            arrays = [pa.array(signed(key)), *(pa.array(c) for c in codes), ref, pa.array(place.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*SUFFIX, "ref", "place"])

    return source.select("ref", "text").mapInArrow(cut, ", ".join(f"{c} bigint" for c in SUFFIX) + ", ref bigint, place int")


class _Neighbours:
    """Pairs each suffix with the neighbouring document of equal context, batch by batch in sorted order."""

    def __init__(self) -> None:
        self.rows = np.zeros((0, 3), np.int64)  # key, ref, place; the first run may be there as context only
        self.context = False
        self.pairs: list[np.ndarray] = []
        self.edges: list[np.ndarray] = []
        self.shared: list[np.ndarray] = []
        self.begun = False

    def add(self, rows: np.ndarray) -> None:
        self._work(np.concatenate([self.rows, rows]), False)

    def close(self) -> None:
        if len(self.rows):
            self._work(self.rows, True)

    def _work(self, rows: np.ndarray, last: bool) -> None:
        fresh = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        heads = np.flatnonzero(fresh)
        run = np.cumsum(fresh) - 1
        runs = len(heads)
        done = runs if last else runs - 1  # the last run may go on in the next batch
        key = rows[heads, 0]
        joined = np.concatenate([[False], key[1:] == key[:-1]])  # the run before has the same context
        first = 1 if self.context else 0
        own = np.flatnonzero((run >= first) & (run < done))
        back = own[joined[run[own]]]
        self._pair(rows[back], rows[heads[run[back] - 1]])
        # Further places of a context's first document meet the document after it.
        ahead = own[~joined[run[own]] & ~fresh[own]]
        ahead = ahead[run[ahead] + 1 < runs]
        ahead = ahead[joined[run[ahead] + 1]]
        self._pair(rows[ahead], rows[heads[run[ahead] + 1]])
        follows = np.append(joined[1:], False)
        self.shared.append(rows[own[(joined | follows)[run[own]]], 1:])
        if not self.begun and done > first:
            self.begun = True
            self.edges.append(np.column_stack([np.zeros(int((run == first).sum()), np.int64), rows[run == first]]))
        if last:
            self.edges.append(np.column_stack([np.ones(int((run == runs - 1).sum()), np.int64), rows[run == runs - 1]]))
            return
        keep = heads[max(runs - 2, 0)]
        self.context = runs >= 2
        self.rows = rows[keep : keep + 1] if self.context else rows[:0]
        self.rows = np.concatenate([self.rows, rows[heads[runs - 1] :]])

    def _pair(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            swap = (a[:, 1] > b[:, 1])[:, None]
            low, high = np.where(swap, b[:, 1:], a[:, 1:]), np.where(swap, a[:, 1:], b[:, 1:])
            found = np.column_stack([low[:, 0], high[:, 0], low[:, 1] - high[:, 1]])
            self.pairs.append(np.unique(found, axis=0))

    def take(self, part: int) -> pa.RecordBatch:
        pairs = np.concatenate(self.pairs) if self.pairs else np.zeros((0, 3), np.int64)
        edges = np.concatenate(self.edges) if self.edges else np.zeros((0, 4), np.int64)
        shared = np.concatenate(self.shared) if self.shared else np.zeros((0, 2), np.int64)
        self.pairs, self.edges, self.shared = [], [], []
        # Suffixes that share their context are told as edges without a side.
        edges = np.concatenate([edges, np.column_stack([np.full((len(shared), 2), -1), shared])])
        n, m = len(pairs), len(edges)

        def column(values: np.ndarray, before: int, after: int) -> pa.Array:
            return pa.concat_arrays([pa.nulls(before, pa.int64()), pa.array(np.ascontiguousarray(values), pa.int64()), pa.nulls(after, pa.int64())])

        arrays = [column(pairs[:, i], 0, m) for i in range(3)] + [column(np.full(m, part), n, 0)] + [column(edges[:, i], n, 0) for i in range(4)]
        return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "line", "part", "side", "key", "ref", "place"])


def _neighbour_pairs(suffixes: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """a, b and line (place in a less place in b) for neighbours of different documents, a being the smaller reference;
    ref and place of suffixes that share their context with another document, or may do so across two partitions."""
    order = ["key", *by, "ref", "place"]
    ranged = suffixes.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).select("key", "ref", F.col("place").cast("bigint"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found = TaskContext.get().partitionId(), _Neighbours()
        for batch in batches:
            if batch.num_rows:
                found.add(np.column_stack([batch.column(i).to_numpy() for i in range(3)]))
                yield found.take(part)
        found.close()
        yield found.take(part)

    names = ("a", "b", "line", "part", "side", "key", "ref", "place")
    found = materialise(ranged.mapInArrow(compare, ", ".join(f"{c} bigint" for c in names)), "neighbours")
    edges = found.where("side >= 0").select("part", "side", "key", "ref", "place")
    # One row per sorted partition that has rows.
    following = edges.select("part").distinct().withColumn("next", F.lead("part").over(Window.partitionBy(F.lit(0)).orderBy("part")))
    last = edges.where("side = 1").join(following, "part").select(F.col("next").alias("part"), "key", F.col("ref").alias("r0"), F.col("place").alias("p0"))
    first = edges.where("side = 0").select("part", "key", F.col("ref").alias("r1"), F.col("place").alias("p1"))
    heads = first.groupBy("part", "key", "r1").agg(F.min("p1").alias("p1"))
    tails = last.groupBy("part", "key", "r0").agg(F.min("p0").alias("p0"))
    over = last.join(heads, ["part", "key"]).unionByName(tails.join(first, ["part", "key"])).where("r0 <> r1")
    low = F.col("r0") < F.col("r1")
    over = over.select(F.least("r0", "r1").alias("a"), F.greatest("r0", "r1").alias("b"), F.when(low, F.col("p0") - F.col("p1")).otherwise(F.col("p1") - F.col("p0")).alias("line"))
    pairs = found.where("a IS NOT NULL").select("a", "b", "line").unionByName(over)
    return pairs, found.where("side IS NOT NULL").select("ref", "place")


def equal_runs(a: np.ndarray, b: np.ndarray, line: int, least: int) -> np.ndarray:
    """Start in ``a`` and length of each longest run of equal words at one alignment, if long enough."""
    start, end = max(line, 0), min(len(a), len(b) + line)
    if end - start < least:
        return np.zeros((0, 2), np.int64)
    equal = np.concatenate([[False], a[start:end] == b[start - line : end - line], [False]]).astype(np.int8)
    turn = np.flatnonzero(np.diff(equal))
    begin, size = turn[::2], turn[1::2] - turn[::2]
    long = size >= least
    return np.column_stack([begin[long] + start, size[long]])


SPANS = "array<struct<start:bigint,`end`:bigint>>"
SPAN_LIST = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _joined_spans(spans: np.ndarray) -> list[dict]:
    """Overlapping and touching (start, end) rows as one."""
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    ends = reach[np.append(np.flatnonzero(first)[1:] - 1, len(spans) - 1)]
    return [{"start": int(a), "end": int(b)} for a, b in zip(spans[first, 0], ends)]


def _extended(pairs: DataFrame, texts: DataFrame, how: Passages) -> DataFrame:
    """ref, other and spans (in words): what a pair has in common, one row for either side."""
    left = texts.select(F.col("ref").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("ref").alias("b"), F.col("text").alias("b_text"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "lines", "a_text", "b_text")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for half in pieces(batches, "a_text"):
            for piece in pieces(iter([half]), "b_text"):
                a, b = Words(piece.column("a_text")), Words(piece.column("b_text"))
                refs = [piece.column(c).to_pylist() for c in ("a", "b")]
                out: tuple[list, list, list] = ([], [], [])
                for i, lines in enumerate(piece.column("lines")):
                    one, two = a.hash[a.first[i] : a.first[i + 1]], b.hash[b.first[i] : b.first[i + 1]]
                    runs = [(equal_runs(one, two, int(line), how.least), int(line)) for line in lines.values.to_numpy()]
                    here = np.concatenate([np.column_stack([r[:, 0], r[:, 0] + r[:, 1]]) for r, _ in runs])
                    there = np.concatenate([np.column_stack([r[:, 0] - n, r[:, 0] + r[:, 1] - n]) for r, n in runs])
                    if len(here):
                        for column, values in zip(out, ((refs[0][i], refs[1][i]), (refs[1][i], refs[0][i]), (_joined_spans(here), _joined_spans(there)))):
                            column.extend(values)
                arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], SPAN_LIST)]
                yield pa.RecordBatch.from_arrays(arrays, names=["ref", "other", "spans"])

    return joined.mapInArrow(extend, f"ref bigint, other bigint, spans {SPANS}")


def common_passages(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", how: Passages = Passages()) -> DataFrame:
    """ref, other and spans: passages that two rows have in common.

    ``ref`` is a 64-bit hash of id and text (see ``references``). ``other`` is the neighbour that shows the passage, or null
    where only a window's hash tells that some other row holds it.
    """
    source = references(df, id_column, text_column)
    kept = _suffixes(source, how)
    after, places = _neighbour_pairs(kept, SUFFIX[1:3])
    met = after.unionByName(_neighbour_pairs(kept, SUFFIX[3:])[0])
    # At most as many lines as the smaller text has kept suffixes.
    pairs = materialise(met.groupBy("a", "b").agg(F.collect_set("line").alias("lines")), "pairs")
    needed = materialise(pairs.select(F.explode(F.array("a", "b")).alias("ref")).distinct(), "needed")
    if needed.count() * REFERENCE_BYTES <= SENT_BYTES:
        needed = F.broadcast(needed)
    texts = materialise(source.join(needed, "ref", "left_semi").select("ref", "text").dropDuplicates(["ref"]), "texts")
    found = materialise(_extended(pairs, texts, how), "passages")
    spans = found.groupBy("ref").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # at most the text's own suffixes
    listed = places.join(needed, "ref", "left_semi").groupBy("ref").agg(F.collect_set("place").alias("places"))
    open_windows = materialise(_windows(texts.join(listed, "ref").join(spans, "ref", "left"), how), "open-windows")
    shared = open_windows.groupBy("window").agg(F.min("ref").alias("_lo"), F.max("ref").alias("_hi")).where("_lo <> _hi").select("window")
    missed = open_windows.where("open").join(shared, "window", "left_semi")
    span = F.array(F.struct("start", (F.col("start") + how.least).alias("end")))
    return found.unionByName(missed.select("ref", F.lit(None).cast("bigint").alias("other"), span.alias("spans")))


def _span_rows(spans: pa.ListScalar) -> np.ndarray:
    if not spans.is_valid:
        return np.zeros((0, 2), np.int64)
    return np.column_stack([spans.values.field(c).to_numpy() for c in ("start", "end")]).reshape(-1, 2)


def _windows(texts: DataFrame, how: Passages) -> DataFrame:
    """window (hash), ref, start and whether no span covers it, for windows that hold a suffix with a shared context."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words = Words(piece.column("text"))
            key = rolling(words.hash, how.least)
            out = []
            for i, (places, spans, ref) in enumerate(zip(piece.column("places"), piece.column("spans"), piece.column("ref").to_pylist())):
                n = int(words.count[i]) - how.least + 1
                if n <= 0:
                    continue
                held = (places.values.to_numpy()[:, None] - np.arange(how.reach)).ravel()
                start = np.unique(held[(held >= 0) & (held < n)])
                covered = np.zeros(n + 1, np.int64)
                for begin, end in _span_rows(spans):
                    covered[begin] += 1
                    covered[end - how.least + 1] -= 1
                free = np.cumsum(covered)[start] == 0
                out.append((signed(key[words.first[i] + start]), np.full(len(start), ref), start, free))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["window", "ref", "start", "open"])

    return texts.select("ref", "text", "places", "spans").mapInArrow(cut, "window bigint, ref bigint, start bigint, open boolean")


def references(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    source = pick(df, doc_id=id_column, text=text_column)
    return source.withColumn("ref", F.xxhash64("doc_id", "text"))


def repeated_passages(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", how: Passages = Passages()) -> DataFrame:
    """One row per input row: doc_id, n_words, repeated_words and spans (start and end in words, the end exclusive).

    Spans are the parts of a text that lie in a passage of ``least`` words or more found in another document. Rows that repeat
    both id and text are one document and no repeat of each other. Null, empty and short texts have no spans; null ids are
    kept; an empty table gives an empty result; other columns are ignored. Words are compared as they are written.
    """
    found = common_passages(df, id_column, text_column, how)
    spans = found.groupBy("ref").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # at most the text's own windows

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = [_joined_spans(_span_rows(s)) for s in batch.column("spans")]
            yield pa.RecordBatch.from_arrays([batch.column("ref"), pa.array(merged, SPAN_LIST)], names=["ref", "spans"])

    merged = spans.mapInArrow(merge, f"ref bigint, spans {SPANS}")
    source = references(df, id_column, text_column)
    counted = source.select("doc_id", "ref", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("bigint").alias("n_words"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    joined = counted.join(merged, "ref", "left").withColumn("spans", F.coalesce("spans", empty))
    total = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return joined.select("doc_id", "n_words", total.alias("repeated_words"), "spans")
