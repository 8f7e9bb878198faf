"""Words of whole texts as arrays, for functions that run inside Spark tasks on Arrow batches.

A batch is cut into pieces of a few megabytes of text (a longer text is a piece of its own), so the
memory of a task follows the longest text, not the number of rows. Words are found and hashed with
array operations over the UTF-8 bytes; no Python object is made per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes of text handled at once inside a task.
PIECE_BYTES = 4 << 20
#: Bytes hashed at once; a power table of this length is kept per worker.
SPAN = 1 << 19

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15


def byte_set(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Space and the five control characters from tab to carriage return.
BLANKS = byte_set(b" \t\n\x0b\x0c\r")
#: Everything in ASCII that is neither letter nor digit; other scripts count as letters.
PUNCTUATION = byte_set(bytes(b for b in range(128) if not chr(b).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (a fixed bijection)."""
    x = np.array(x, dtype=U64)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as the signed numbers that Spark holds."""
    return np.ascontiguousarray(x, dtype=U64).view(np.int64)


_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        inverse = pow(_BASE, -1, 1 << 64)
        for base in (_BASE, inverse):
            table = np.full(SPAN + 1, base, dtype=U64)
            table[0] = 1
            _powers.append(np.cumprod(table, dtype=U64))
        _powers.append(mix(np.arange(1, 257, dtype=U64)))
    return _powers


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans must be in order and must not overlap."""
    up, down, letters = _power_tables()
    out = np.empty(len(start), dtype=U64)
    at = 0
    while at < len(start):
        origin = start[at]
        upto = int(np.searchsorted(end, origin + SPAN, side="right"))
        if upto <= at:  # one span longer than the table
            digest = hashlib.blake2b(data[start[at] : end[at]].tobytes(), digest_size=8).digest()
            out[at] = int.from_bytes(digest, "little")
            at += 1
            continue
        piece = data[origin : end[upto - 1]]
        sums = np.zeros(len(piece) + 1, dtype=U64)
        np.cumsum(letters[piece] * up[: len(piece)], out=sums[1:])
        s, e = start[at:upto] - origin, end[at:upto] - origin
        out[at:upto] = (sums[e] - sums[s]) * down[s]
        at = upto
    return mix(out + (end - start).astype(U64))


def short_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray, longest: int) -> np.ndarray:
    """What ``hash_spans`` gives for spans of at most ``longest`` bytes, without sums over the bytes between them."""
    up, _, letters = _power_tables()
    out = length.astype(U64)
    for i in range(longest):
        letter = (letters * up[i])[np.take(data, start + i, mode="clip")]
        letter[length <= i] = 0
        out += letter
    return mix(out)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each text starts (one offset more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a batch of texts: byte spans, hashes and the text each belongs to."""

    def __init__(
        self,
        texts: pa.Array,
        separators: np.ndarray = BLANKS,
        lower: bool = False,
        prepare: Callable[[np.ndarray], np.ndarray] | None = None,
    ):
        self.data, self.offsets = text_bytes(texts)
        if prepare:
            self.data = prepare(self.data)
        if lower:
            self.data = LOWER[self.data]
        self.texts = len(self.offsets) - 1
        inside = np.zeros(len(self.data) + 1, bool)
        inside[:-1] = ~separators[self.data]
        first = inside[:-1].copy()
        first[1:] &= ~inside[:-2]
        heads = self.offsets[:-1]
        heads = heads[heads < len(self.data)]
        first[heads] = inside[heads]
        last = inside[:-1] & ~inside[1:]
        tails = self.offsets[1:] - 1
        tails = tails[tails >= 0]
        last[tails] = inside[tails]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: Index of the first word of each text, and the number of all words at the end.
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(self.texts), self.count)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = hash_spans(self.data, self.start, self.end)
        return self._hash

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of ``size`` words that lies within one text."""
        n = len(self.start) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.text[:n] == self.text[size - 1 :])
        return at, rolling(self.hash, size)[at]

    def string(self, word: int) -> str:
        return self.data[self.start[word] : self.end[word]].tobytes().decode("utf-8", "replace")


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` neighbouring hashes, in order."""
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), dtype=U64)
    for i in range(size if n > 0 else 0):
        out *= U64(0xD6E8FEB86659FD93)
        out += hashes[i : i + n]
    return mix(out)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, cut so that a piece holds at most ``limit`` bytes of text or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            upto = max(upto, at + 1)
            yield batch.slice(at, upto - at)
            at = upto


def by_length(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows, each batch's longest texts first, so that texts of one piece are of like length."""
    for batch in batches:
        size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        batch = batch.take(pa.array(np.argsort(-size.astype(np.int64), kind="stable")))  # the batch as it came is given up
        yield batch


def group_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; ``first`` has one entry more than there are runs."""
    sums = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype.kind in "bui" else values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def char_index(data: np.ndarray) -> np.ndarray:
    """Code points before each byte (one entry more than bytes)."""
    counts = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=counts[1:])
    return counts


_span_powers: list[np.ndarray] = []


def span_hasher(hashes: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function (start, end) -> hashes of runs of words of any length, each in constant time."""
    base = 0xD6E8FEB86659FD93
    if not _span_powers or len(_span_powers[0]) <= len(hashes):
        size = max(len(hashes) + 1, 1 << 20)
        _span_powers.clear()
        for of in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, of, dtype=U64)
            table[0] = 1
            _span_powers.append(np.cumprod(table, dtype=U64))
    up, down = _span_powers
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])

    def of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))

    return of
