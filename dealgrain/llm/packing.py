"""Packing by powers of two: documents become pieces of binary lengths, and equal lengths share a bucket.

A document of n tokens is cut into full pieces of the largest length and then into one piece for each
binary digit of the rest. Every piece is a sequence of its own, so no sequence crosses documents and
none needs padding. Sequences are numbered bucket by bucket, the longest first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .tables import pick
from .textio import char_index, group_sums, hash_spans, pieces, text_bytes

LONGEST = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"
#: Distinct word pieces whose ids a worker remembers; beyond it the memory is emptied and filled anew.
REMEMBERED = 500_000

LETTER, NUMBER, BLANK, OTHER, UNSURE = range(5)


@lru_cache(maxsize=1)
def char_kinds() -> np.ndarray:
    """Letter, number, blank or other for code points whose kind never changed between Unicode versions."""
    import unicodedata

    blanks = {*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}

    def kind(category: str) -> int:
        return {"L": LETTER, "N": NUMBER}.get(category[0], UNSURE if category in ("Cn", "Co", "Cs") else OTHER)

    table = np.full(0x10000, UNSURE, np.uint8)
    for code in range(0x10000):
        now, before = kind(unicodedata.category(chr(code))), kind(unicodedata.ucd_3_2_0.category(chr(code)))
        table[code] = BLANK if code in blanks else now if now == before and unicodedata.category(chr(code))[0] != "Z" else UNSURE
    return table


def word_piece_starts(chars: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Marks where the byte-level vocabulary's pattern starts a new word piece.

    ``first`` holds the code point offsets of the texts (one more than texts).
    """
    n = len(chars)
    starts = np.zeros(n + 4, bool)
    if not n:
        return starts[:0]
    heads = np.zeros(n + 1, bool)
    heads[first] = True
    starts[1:n] = kinds[1:] != kinds[:-1]
    starts[:n] |= heads[:n]
    # The last blank before a word stands alone or, if it is a space, opens the word.
    joint = np.flatnonzero((kinds[:-1] == BLANK) & (kinds[1:] != BLANK) & ~heads[1:n])
    starts[joint] = True
    starts[joint + 1] = chars[joint] != 32
    # Contractions: an apostrophe that opens a piece, with the letters that belong to it.
    padded = np.concatenate([chars, np.zeros(3, chars.dtype)])
    mark = np.flatnonzero((chars == 39) & starts[:n])
    one = padded[mark + 1]
    two = padded[mark + 2]
    close = np.append(heads, [True, True, True])
    single = np.isin(one, [ord(c) for c in "stmd"]) & ~close[mark + 1]
    double = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    double &= ~single & ~close[mark + 1] & ~close[np.minimum(mark + 2, n)]
    for chosen, length in ((mark[single], 2), (mark[double], 3)):
        starts[chosen + 1] = False
        after = chosen + length
        goes_on = after[after < n]
        goes_on = goes_on[(kinds[goes_on] == LETTER) & ~heads[goes_on]]
        starts[goes_on] = True
    return starts[:n]


class Encoder:
    """Token ids of whole texts; ids of word pieces seen before are looked up.

    Texts that hold the string of an added token go through the tokenizer whole, which gives that token its own id. With
    ``added_as_text`` special tokens are spelled out like other text.
    """

    def __init__(self, path: str, added_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = added_as_text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (t.special and added_as_text)]
        self.newline = self._plain("\n")
        self._forget()

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.row: dict[int, int] = {}
        self.start = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def _remember(self, keys: list[int], ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        """Keep ``ids``; the word piece of each key has ``length`` of them from ``start`` on."""
        row, n = len(self.row), len(keys)
        if row + n > len(self.start):
            size = 2 * (row + n)
            self.start, self.length = np.resize(self.start, size), np.resize(self.length, size)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.used + len(ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[row : row + n], self.length[row : row + n] = self.used + start, length
        self.row.update(zip(keys, range(row, row + n)))
        self.used += len(ids)

    def _learn(self, keys: list[int], texts: list[str]) -> None:
        """Ids of new word pieces; many are encoded in one text, a line each."""
        lines = [i for i, t in enumerate(texts) if not t[-1].isspace()] if len(self.newline) == 1 else []
        alone = set(range(len(texts))).difference(lines)
        for at in range(0, len(lines), 4000):
            some = lines[at : at + 4000]
            ids = np.array(self._plain("\n".join([texts[i] for i in some])), np.uint32)
            cuts = np.concatenate([[-1], np.flatnonzero(ids == self.newline[0]), [len(ids)]])
            if len(cuts) == len(some) + 1:
                self._remember([keys[i] for i in some], ids, cuts[:-1] + 1, np.diff(cuts) - 1)
            else:  # a vocabulary that joins line ends to words
                alone.update(some)
        for i in sorted(alone):
            ids = np.array(self._plain(texts[i]), np.uint32)
            self._remember([keys[i]], ids, np.zeros(1, np.int64), np.array([len(ids)]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids start (one offset more than texts)."""
        data, offsets = text_bytes(texts)
        chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        place = char_index(data)[offsets]
        kinds = np.where(chars < 0x10000, char_kinds()[np.minimum(chars, 0xFFFF)], UNSURE)
        starts = np.flatnonzero(word_piece_starts(chars, place, kinds))
        char_bytes = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        begin = char_bytes[starts]
        end = np.append(begin[1:], len(data))
        codes, keys = pd.factorize(hash_spans(data, begin, end))
        sample = np.zeros(len(keys), np.int64)
        sample[codes[::-1]] = np.arange(len(codes))[::-1]
        if len(self.row) + len(keys) > REMEMBERED:
            self._forget()
        known = [int(k) for k in keys]
        new = [i for i, k in enumerate(known) if k not in self.row]
        raw = data.tobytes()
        self._learn([known[i] for i in new], [raw[begin[sample[i]] : end[sample[i]]].decode("utf-8") for i in new])
        rows = np.fromiter((self.row[k] for k in known), np.int64, len(known))[codes]
        lengths = self.length[rows]
        at = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(lengths, out=at[1:])
        ids = self.ids[np.repeat(self.start[rows] - at[:-1], lengths) + np.arange(at[-1])]
        first = at[np.searchsorted(starts, place)]
        whole = group_sums(kinds == UNSURE, place) > 0
        for token in self.added:
            whole |= pc.match_substring(texts, token).fill_null(False).to_numpy(zero_copy_only=False)
        unsure = np.flatnonzero(whole)
        if len(unsure):  # characters whose kind depends on the Unicode version, or added tokens: the tokenizer decides
            raw_texts = texts.fill_null("")
            parts = [ids[first[i] : first[i + 1]] for i in range(len(first) - 1)]
            for i in unsure:
                parts[i] = np.array(self._plain(raw_texts[int(i)].as_py()), np.uint32)
            ids = np.concatenate(parts)
            first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, first


def binary_lengths(tokens: int, longest: int = LONGEST) -> list[int]:
    """Full pieces, then one piece for each binary digit of the rest, the longest first."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _vocabulary_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pack_documents(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    longest: int = LONGEST,
    end_id: int = END_ID,
    vocabulary: str | None = None,
    with_ids: bool = False,
    added_as_text: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, on request, ids.

    ``longest`` is a power of two. Null and empty texts hold the end id alone; null ids, repeated rows and ties keep their own
    pieces; an empty table gives an empty result; other columns are ignored. A sequence is one piece, so ``offset`` is 0.
    Without ``added_as_text`` the tokenizer is used as loaded: the string of a special token in a text becomes that token.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    source = pick(df, doc_id=id_column, text=text_column)
    id_type = dict(source.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, place bigint" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_vocabulary_path(vocabulary), added_as_text)
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for piece in pieces(batches, "text"):
            ids, first = encoder.encode(piece.column("text"))
            columns: list[list] = [[] for _ in range(6)]
            texts, starts, lengths, sums, totals, places = columns
            held = []
            for text in range(len(piece)):
                own = np.append(ids[first[text] : first[text + 1]], end_id).astype("<u4")
                raw, at = own.tobytes(), 0
                for length in binary_lengths(len(own), longest):
                    place = seen.get(length, 0)
                    seen[length] = place + 1
                    for column, value in zip(columns, (text, at, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), len(own), place)):
                        column.append(value)
                    if with_ids:
                        held.append(own[at : at + length].astype(np.int32))
                    at += length
            arrays = [piece.column("doc_id").take(pa.array(texts, pa.int64()))]
            arrays += [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]
            arrays += [pa.array(np.full(len(texts), part, np.int32)), pa.array(places, pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place"]
            if with_ids:
                arrays, names = [*arrays, pa.array(held, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    stored = materialise(source.mapInArrow(cut, schema), "pieces")
    counts = stored.groupBy("part", "length").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy(F.desc("length"), "part").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per task and binary length, whatever the number of documents.
    bases = counts.select("part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = stored.join(F.broadcast(bases), ["part", "length"])
    return numbered.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_base") + F.col("place")).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"), *(["ids"] if with_ids else []),
    )
