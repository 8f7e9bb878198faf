"""Benchmark questions in documents, also when numbers, names or units were exchanged.

Texts become templates: numbers, names and units turn into typed placeholders and other words into lower case. Windows
of template tokens with enough plain words, and windows of words as they stand, are joined by hash. Where windows of a
document and an item line up, the match is extended over the template tokens beside them and the values behind the
placeholders are compared: a leak maps every value of the item to one value of the document, whatever that is.

Items of one template, with equal values at the same slots, are a class, and a document is matched with a class once, by
its first item; the item whose values the document has is then found by a hash of these values. A thousand items that
differ in their numbers only cost a document as much as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .tables import fresh, pick
from .textio import LOWER, PUNCTUATION, U64, Words, byte_set, mix, pieces, rolling, signed

#: Fixed lists: units that count after a number, and number words.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes lb lbs "
    "pound pounds ounce ounces ml l liter liters litre litres gallon gallons second seconds s minute minutes min hour hours h day "
    "days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees mph kmh kph"
).split()
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()

ENDS = byte_set(b".!?:;\n")
DIGITS = byte_set(b"0123456789")
UPPER = byte_set(bytes(range(65, 91)))
JOINT = 0xFF
NUMBER, NAME, UNIT = (U64(0x6E756D0000000001), U64(0x6E616D0000000002), U64(0x756E690000000003))
SLOTS = np.array([NUMBER, NAME, UNIT]).view(np.int64)
EXACT = U64(0x6578610000000004)

#: Bits of the filter that document windows pass first; its size does not depend on the benchmark.
FILTER_BITS = 1 << 24
#: Size up to which the benchmark's windows are sent to all tasks; above, both sides are shuffled by hash.
SENT_BYTES, WINDOW_BYTES = 32 << 20, 96


@dataclass(frozen=True)
class Matching:
    """``window`` template tokens, of which ``literals`` at least are plain words. A leak covers ``share`` of the item or ``run`` tokens.

    An item of fewer than ``least_words`` words and ``least_chars`` characters is no evidence: it is reported, but never a leak.
    """

    window: int = 8
    literals: int = 5
    share: float = 0.5
    run: int = 16
    least_words: int = 4
    least_chars: int = 20


def _join_numbers(data: np.ndarray) -> np.ndarray:
    """Points and commas between digits become part of the number."""
    out = data.copy()
    inner = np.flatnonzero(((data[1:-1] == 46) | (data[1:-1] == 44)) & DIGITS[data[:-2]] & DIGITS[data[2:]]) + 1 if len(data) > 2 else []
    out[inner] = JOINT
    return out


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the two-byte Latin and Cyrillic letters, which keep their length."""
    out = LOWER[data]
    if len(out) > 1:
        lead, next_ = out[:-1], out[1:]
        latin = np.flatnonzero((lead == 0xC3) & (next_ >= 0x80) & (next_ <= 0x9E) & (next_ != 0x97)) + 1
        near = np.flatnonzero((lead == 0xD0) & (next_ >= 0x90) & (next_ <= 0x9F)) + 1
        far = np.flatnonzero((lead == 0xD0) & (next_ >= 0xA0) & (next_ <= 0xAF))
        out[latin] += 0x20
        out[near] += 0x20
        out[far] = 0xD1
        out[far + 1] -= 0x20
    return out


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.sort(np.unique(Words(pa.array(words)).hash))


class Template:
    """Template tokens of a batch: key (hash or placeholder), whether plain, value behind it, text and place in the text."""

    _units = _numbers = None

    def __init__(self, texts: pa.Array):
        if Template._units is None:
            Template._units, Template._numbers = _word_hashes(UNITS), _word_hashes(NUMBER_WORDS)
        words = Words(texts, PUNCTUATION, prepare=_join_numbers)
        data, start, end, text = words.data, words.start, words.end, words.text
        n = len(start)
        if not n:
            self.key = self.value = np.zeros(0, U64)
            self.plain, self.text, self.place = np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.word, self.word_text, self.token = self.key, self.text, self.text
            return
        head, second = data[start], data[np.minimum(start + 1, end - 1)]
        ends = np.concatenate([[0], np.cumsum(ENDS[data])])
        fresh = np.ones(n, bool)
        fresh[1:] = (text[1:] != text[:-1]) | (ends[start[1:]] > ends[end[:-1]])
        words.data = _lower(data)
        value = words.hash
        number = DIGITS[head] | np.isin(value, Template._numbers)
        name = UPPER[head] & ~UPPER[second] & (end - start > 1) & ~fresh & ~number
        after_number = np.zeros(n, bool)
        after_number[1:] = number[:-1] & (text[1:] == text[:-1])
        unit = after_number & np.isin(value, Template._units) & ~number & ~name
        key = np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, value)))
        again = np.zeros(n, bool)
        again[1:] = (number[1:] & number[:-1] | name[1:] & name[:-1]) & (text[1:] == text[:-1])
        first = np.flatnonzero(~again)  # neighbouring numbers, or names, are one slot
        self.key, self.text = key[first], text[first]
        self.word, self.word_text, self.token = value, text, np.cumsum(~again) - 1
        self.plain = ~(number | name | unit)[first]
        self.value = np.add.reduceat(value, first)
        heads = np.searchsorted(self.text, np.arange(words.texts))
        self.place = np.arange(len(first)) - heads[self.text]

    def windows(self, size: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
        """First token and hash of each window within one text that has enough plain words."""
        n = len(self.key) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        plain = np.concatenate([[0], np.cumsum(self.plain)])
        good = (self.text[:n] == self.text[size - 1 :]) & (plain[size:] - plain[:n] >= literals)
        at = np.flatnonzero(good)
        return at, rolling(self.key, size)[at]

    def word_windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last token and hash of each window of words, as they stand, within one text."""
        n = len(self.word) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.word_text[:n] == self.word_text[size - 1 :])
        return self.token[at], self.token[at + size - 1], mix(rolling(self.word, size)[at] ^ EXACT)

    def lists(self, values: np.ndarray, texts: int) -> pa.ListArray:
        """The values of each text's tokens."""
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(self.text, np.arange(texts + 1)), pa.int32()), pa.array(signed(values)))


def _benchmark_windows(items: DataFrame, how: Matching) -> DataFrame:
    """One row per window of an item: hash, item_code, first token and the one after the last, whether exact, size.

    An item shorter than a window is one window of its own size. Template windows with too few plain words are left out and come
    from the first item of a class only (``first``). Windows of words as they stand (exact) are there for every item unless they
    are plain words that a template window holds as well.
    """
    schema = "window bigint, item_code bigint, item_place bigint, item_upto bigint, exact boolean, size bigint"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            found = Template(piece.column("text"))
            tokens, words = np.bincount(found.text, minlength=len(piece)), np.bincount(found.word_text, minlength=len(piece))
            plain, first = np.concatenate([[0], np.cumsum(found.plain)]), piece.column("first").to_numpy(zero_copy_only=False)
            for exact, size in [(False, n) for n in range(how.literals, how.window + 1)] + [(True, n) for n in range(1, how.window + 1)]:
                if exact:
                    at, last, key = found.word_windows(size)
                else:
                    at, key = found.windows(size, how.literals)
                    last = at + size - 1
                use = np.ones(len(at), bool)
                if size < how.window:
                    use &= (words if exact else tokens)[found.text[at]] == size
                if exact:
                    use &= (plain[last + 1] - plain[at] < size) | (size < how.literals)
                else:
                    use &= first[found.text[at]]
                at, last, key = at[use], last[use], key[use]
                text = pa.array(found.text[at])
                arrays = [pa.array(signed(key)), piece.column("item_code").take(text), pa.array(found.place[at])]
                arrays += [pa.array(found.place[last] + 1), pa.array(np.full(len(at), exact)), pa.array(np.full(len(at), size))]
                yield pa.RecordBatch.from_arrays(arrays, names=["window", "item_code", "item_place", "item_upto", "exact", "size"])

    return items.select("text", "item_code", "first").mapInArrow(cut, schema)


def slot_pattern(values: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """For each slot the number of the first slot with the same value."""
    _, first, back = np.unique(values[slot], return_index=True, return_inverse=True)
    return first[back]


def _digest(*arrays: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(b"|".join(np.ascontiguousarray(a).tobytes() for a in arrays), digest_size=8).digest(), "little", signed=True)


def values_digest(values: np.ndarray, slot: np.ndarray) -> int:
    return _digest(np.asarray(values)[slot].astype(np.int64))


def _classed(items: DataFrame, how: Matching) -> DataFrame:
    """Items with their class, a hash of their values, whether they are the first of their class, and whether they are evidence."""
    kinds = {c: t for c, t in items.dtypes}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            found, out = Template(piece.column("text")), []
            keys, values = found.lists(found.key, len(piece)), found.lists(found.value, len(piece))
            words = np.bincount(found.word_text, minlength=len(piece))
            for i, text in enumerate(piece.column("text").to_pylist()):
                key, value = keys[i].values.to_numpy(), values[i].values.to_numpy()
                slot = np.isin(key, SLOTS)
                out.append((_digest(key, slot_pattern(value, slot)), values_digest(value, slot), bool(words[i] >= how.least_words or len(text or "") >= how.least_chars)))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*piece.columns, *columns], names=[*piece.schema.names, "class_code", "values_code", "evidence"])

    schema = ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", class_code bigint, values_code bigint, evidence boolean"
    known = materialise(items.mapInArrow(cut, schema), "items")
    lead = known.groupBy("class_code").agg(F.min("item_code").alias("lead"), F.count_distinct("item_code").alias("class_items"))
    return materialise(known.join(lead, "class_code").withColumn("first", F.col("lead") == F.col("item_code")).drop("lead"), "classed")


def _filter(windows: DataFrame) -> tuple[np.ndarray, list[tuple[bool, int]]]:
    """A bit for each window hash, in a table of fixed size, and the kinds and sizes of windows in use."""
    bit = F.pmod(F.col("window"), F.lit(FILTER_BITS))
    words = windows.groupBy(F.shiftright(bit, 6).alias("place")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(window, {FILTER_BITS}) % 64 as int))")).alias("bits"))
    found = words.toArrow()  # at most FILTER_BITS / 64 rows
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[found.column("place").to_numpy()] = found.column("bits").to_numpy()
    sizes = sorted((r["exact"], r["size"]) for r in windows.select("exact", "size").distinct().collect())  # at most twice the window size
    return np.unpackbits(table.astype("<i8").view(np.uint8), bitorder="little").astype(bool), sizes


def template_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    how: Matching = Matching(),
) -> DataFrame:
    """One row per document, text and class of benchmark items with a common template window.

    Columns: doc_id, text_key, item_id, class_items, matched_tokens (tokens of the item inside common windows or joined to one by
    equal tokens, at the alignment with most of them), item_tokens, slots and changed_slots there, consistent (each value of the
    item always met the same value), evidence (the item is long enough) and leaked (consistent, long enough a match, evidence).
    Items whose templates are equal, with equal values at the same slots, are a class; of its items the row names the one with the
    document's values, else the first by a hash, and of several ids with one text the smallest. Null and empty texts on either side
    match nothing; repeated rows count once; null ids are kept; empty tables give an empty result; other columns are ignored. An item
    of fewer words than a window is found as a whole; with exchanged values, only if it has ``literals`` plain words.
    """
    source = pick(docs, doc_id=id_column, text=text_column).withColumn("text_key", F.xxhash64("text"))
    items = pick(benchmark, item_id=item_column, text=item_text_column)
    items = _classed(items.groupBy("text").agg(F.min("item_id").alias("item_id")).withColumn("item_code", F.xxhash64("text")), how)
    windows = materialise(_benchmark_windows(items, how), "windows")
    bits, sizes = _filter(windows)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))  # FILTER_BITS / 8 bytes
    doc_type = dict(source.dtypes)["doc_id"]
    schema = f"doc_id {doc_type}, text_key bigint, window bigint, doc_place bigint"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(shared.value).view(bool)
        for piece in pieces(batches, "text"):
            found = Template(piece.column("text"))
            for exact, size in sizes:
                at, key = found.word_windows(size)[::2] if exact else found.windows(size, how.literals)
                hit = table[(key & U64(FILTER_BITS - 1)).astype(np.int64)]
                at, key = at[hit], key[hit]
                if len(at):
                    text = pa.array(found.text[at])
                    arrays = [piece.column("doc_id").take(text), piece.column("text_key").take(text), pa.array(signed(key)), pa.array(found.place[at])]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "window", "doc_place"])

    hits = source.mapInArrow(search, schema)
    small = windows.count() * WINDOW_BYTES <= SENT_BYTES
    joined = hits.join(F.broadcast(windows) if small else windows, "window")
    line = (F.col("doc_place") - F.col("item_place")).alias("line")
    matches = joined.select("doc_id", "text_key", "item_code", line, "item_place", "item_upto", "exact")
    return _aligned(materialise(matches.distinct(), "matches"), source, items, how)


def _tokens(texts: DataFrame, code: str, side: str) -> DataFrame:
    """Keys and values of all template tokens of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            found = Template(piece.column("text"))
            arrays = [piece.column(code), found.lists(found.key, len(piece)), found.lists(found.value, len(piece))]
            yield pa.RecordBatch.from_arrays(arrays, names=[code, f"{side}_keys", f"{side}_values"])

    return texts.select(code, "text").dropDuplicates([code]).mapInArrow(cut, f"{code} bigint, {side}_keys array<bigint>, {side}_values array<bigint>")


def extend(keys: np.ndarray, values: np.ndarray, doc_keys: np.ndarray, doc_values: np.ndarray, line: int, seeds: list[dict]) -> tuple[int, int, int, bool, int]:
    """Matched tokens, slots, changed slots and consistency of an item on one line of a document, and a hash of the values met.

    ``doc_keys`` and ``doc_values`` are the document's from the item's first token on, or from the document's start if that
    comes later. Seeds grow over equal tokens until a slot would give a value of the item a second value.
    """
    n, head = len(keys), max(-line, 0)
    m = min(n - head, len(doc_keys))
    equal, other = np.zeros(n, bool), values.copy()
    equal[head : head + m] = keys[head : head + m] == doc_keys[:m]
    other[head : head + m] = doc_values[:m]
    cover, exact = np.zeros(n, bool), np.zeros(n, bool)
    for seed in seeds:
        cover[seed["item_place"] : seed["item_upto"]] = True
        if seed["exact"]:
            exact[seed["item_place"] : seed["item_upto"]] = True
    other[exact] = values[exact]  # words as they stand; a slot at the border may go on in the document
    slot, met, changed, consistent = np.isin(keys, SLOTS), {}, set(), True
    for i in np.flatnonzero(cover & slot):
        consistent &= met.setdefault(values[i], other[i]) == other[i]
        if values[i] != other[i]:
            changed.add(values[i])
    for step in (1, -1):
        for i in np.flatnonzero(cover):
            i += step
            while 0 <= i < n and not cover[i] and equal[i]:
                if slot[i]:
                    if met.setdefault(values[i], other[i]) != other[i]:
                        break
                    if values[i] != other[i]:
                        changed.add(values[i])
                cover[i] = True
                i += step
    return int(cover.sum()), len(met), len(changed), bool(consistent), values_digest(other, slot)


def _aligned(matches: DataFrame, source: DataFrame, items: DataFrame, how: Matching) -> DataFrame:
    hit = matches.select("text_key").distinct()
    if hit.count() * 64 <= SENT_BYTES:
        hit = F.broadcast(hit)
    docs = _tokens(source.join(hit, "text_key", "left_semi"), "text_key", "doc")
    seeds = F.collect_set(F.struct("item_place", "item_upto", "exact")).alias("seeds")
    lines = matches.groupBy("text_key", "item_code", "line").agg(seeds).join(_tokens(items, "item_code", "item"), "item_code").join(docs, "text_key")
    start, length = F.greatest("line", F.lit(0)).cast("int") + 1, F.size("item_keys")
    lines = lines.select("text_key", "item_code", "line", "seeds", "item_keys", "item_values", *[F.slice(c, start, length).alias(c) for c in ("doc_keys", "doc_values")])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [[batch.column(c)[i].values.to_numpy() for i in range(len(batch))] for c in ("item_keys", "item_values", "doc_keys", "doc_values")]
            told = [extend(*arrays, line, seed) for *arrays, line, seed in zip(*flat, batch.column("line").to_pylist(), batch.column("seeds").to_pylist())]
            columns = [pa.array([t[k] for t in told], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()))]
            total = pa.array([len(x) for x in flat[0]], pa.int64())
            names = ["text_key", "item_code", "line", "item_tokens", "matched_tokens", "slots", "changed_slots", "consistent", "values_code"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names[:3]] + [total, *columns], names=names)

    numbers = "text_key bigint, item_code bigint, line bigint, item_tokens bigint, matched_tokens bigint, slots bigint, changed_slots bigint, consistent boolean, values_code bigint"
    judged = lines.mapInArrow(judge, numbers)
    known = items.select("item_code", "class_code", "class_items", "evidence", "item_id")
    long = (F.col("matched_tokens") >= how.share * F.col("item_tokens")) | (F.col("matched_tokens") >= how.run)
    judged = judged.join(known, "item_code").withColumn("leaked", F.col("consistent") & long & F.col("evidence"))
    # The item of the class that has the document's own values; its first item stands for it otherwise.
    same = items.groupBy("class_code", "values_code").agg(F.min("item_id").alias("own_id"), F.lit(True).alias("own"))
    judged = judged.join(same, ["class_code", "values_code"], "left").withColumns({
        "item_id": F.when(F.col("own"), F.col("own_id")).otherwise(F.col("item_id")),
        "changed_slots": F.when(F.col("own"), 0).otherwise(F.col("changed_slots")),
    })
    order = F.struct("leaked", "matched_tokens", -F.col("changed_slots"), -F.col("line"), F.col("item_code"))
    told = ("item_id", "class_items", "matched_tokens", "item_tokens", "slots", "changed_slots", "consistent", "evidence", "leaked")
    best = judged.groupBy("text_key", "class_code").agg(F.max_by(F.struct(*told), order).alias("_best"))
    owners = matches.select("doc_id", "text_key").distinct()
    return owners.join(best, "text_key").select("doc_id", "text_key", "_best.*")


def drop_leaked(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", how: Matching = Matching()) -> DataFrame:
    """The rows of ``docs`` without a leaked item, with all their columns."""
    code, text = fresh(docs, "_id"), fresh(docs, "_text")
    leaked = template_leaks(docs, benchmark, id_column, text_column, how=how).where("leaked")
    leaked = materialise(leaked.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(code), F.col("text_key").alias(text)).distinct(), "leaked")
    if leaked.count() * 64 <= SENT_BYTES:
        leaked = F.broadcast(leaked)
    tagged = docs.withColumns({code: F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")), text: F.xxhash64(F.col(f"`{text_column}`"))})
    return tagged.join(leaked, [code, text], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
