"""Collocations of two and three words, counted by top-order marginalisation.

Only the longest windows are counted: every word occurrence with the two words that lead it in its piece, padded with an empty
word where the piece ends. A shorter phrase starts exactly one window per occurrence, so its count is a sum of windows over what
follows the prefix; Spark's ROLLUP over (language, first, second, third) makes these sums, down to all words of a language. There
is no explosion into one-, two- and three-word phrases.

Most windows are rare. A window that cannot reach ``least`` counts to its prefix only, so its third word is blanked before the
ROLLUP, and its second word where the pair stays below ``least``; the sums of all prefixes that matter are unchanged. What ROLLUP
expands and shuffles is then one row per frequent window, pair or word of each partition.

Windows are counted in each task first and dealt by language, first word and a bucket of the second word, so the windows after
a very common word are spread over ``BUCKETS`` partitions while a pair stays in one; a common pair arrives as one row per
different third word and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .tables import pick
from .textio import U64, Words, byte_set, hash_spans, pieces, text_bytes

#: Bytes of text whose windows are counted together inside a task; a longer text alone.
COUNTED_BYTES = 8 << 20
#: Parts into which the windows after one word are dealt.
BUCKETS = 8
#: Parts in which a language's phrases are ranked before the last ranking.
RANKED_PARTS = 256

ENDS = byte_set(b".,;:!?\n\x0b\x0c\r")
GAPS = ENDS | byte_set(b" \t")
UNKNOWN = "und"


@dataclass(frozen=True)
class Collocations:
    """Phrases seen ``least`` times; a pair goes if a longer phrase around it has ``inside`` percent of its count; the ``top`` of each language."""

    least: int = 10
    inside: int = 50
    top: int = 2000


def windows(texts: pa.Array) -> pa.RecordBatch:
    """w1, bucket and rest of all padded windows of some texts; ``rest`` has a line "w2 w3 count" per different window."""
    words = Words(texts, separators=GAPS, lower=True)
    n = len(words.start)
    names = ["w1", "bucket", "rest"]
    if not n:
        return pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.int32()), pa.array([], pa.string())], names=names)
    ends = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(ENDS[words.data], out=ends[1:])
    goes_on = np.zeros(n + 1, bool)
    goes_on[: n - 1] = (words.text[1:] == words.text[:-1]) & (ends[words.start[1:]] == ends[words.end[:-1]])
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(words.end - words.start, out=offsets[1:])
    letters = words.data[~GAPS[words.data]]
    listed = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
    code = listed.indices.to_numpy().astype(np.int64)
    pad = len(listed.dictionary)
    values = pa.concat_arrays([listed.dictionary, pa.array([""], pa.large_string())])
    after = np.append(code[1:], [pad, pad])
    second = np.where(goes_on[:n], after[:n], pad)
    third = np.where(goes_on[:n] & goes_on[1:], after[1:], pad)
    data, where = text_bytes(values)
    bucket = (hash_spans(data, where[:-1], where[1:]) % U64(BUCKETS)).astype(np.int64)
    bucket[pad] = 0
    front, rest = code * BUCKETS + bucket[second], second * (pad + 1) + third
    order = np.lexsort((rest, front))
    front, rest = front[order], rest[order]
    heads = np.flatnonzero(np.concatenate([[True], (front[1:] != front[:-1]) | (rest[1:] != rest[:-1])]))
    counts = np.diff(np.append(heads, n))
    front, rest = front[heads], rest[heads]
    lines = pc.binary_join_element_wise(values.take(pa.array(rest // (pad + 1))), values.take(pa.array(rest % (pad + 1))), pa.array(counts).cast(pa.large_string()), pa.scalar(" ", pa.large_string()))
    rows = np.flatnonzero(np.concatenate([[True], front[1:] != front[:-1]]))
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.append(rows, len(front))), lines), pa.scalar("\n", pa.large_string()))
    front = front[rows]
    arrays = [values.take(pa.array(front // BUCKETS)).cast(pa.string()), pa.array((front % BUCKETS).astype(np.int32)), joined.cast(pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def phrase_counts(df: DataFrame, least: int) -> DataFrame:
    """lang, w1, w2, w3, n and level: occurrences of phrases of 3, 2 and 1 words seen ``least`` times, and of all words (level 0)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", COUNTED_BYTES):
            lang = piece.column("lang")
            for one in pc.unique(lang):
                counted = windows(piece.column("text").filter(pc.equal(lang, one)))
                yield pa.RecordBatch.from_arrays([pa.array([one.as_py()] * counted.num_rows, pa.string()), *counted.columns], names=["lang", *counted.schema.names])

    own = df.mapInArrow(cut, "lang string, w1 string, bucket int, rest string")
    lines = own.repartition("lang", "w1", "bucket").select("lang", "w1", "bucket", F.explode(F.split("rest", "\n")).alias("line"))
    part = F.split("line", " ")
    split = lines.select("lang", "w1", "bucket", part[0].alias("w2"), part[1].alias("w3"), part[2].cast("bigint").alias("n"))
    # All rows of a pair are in one partition, so none of these steps shuffles.
    counted = split.groupBy("lang", "w1", "bucket", "w2", "w3").agg(F.sum("n").alias("n"))
    pair = counted.withColumn("pair", F.sum("n").over(Window.partitionBy("lang", "w1", "bucket", "w2")))
    blanked = pair.select("lang", "w1", "bucket", F.when(F.col("pair") >= least, F.col("w2")).otherwise("").alias("w2"), F.when(F.col("n") >= least, F.col("w3")).otherwise("").alias("w3"), "n")
    folded = blanked.groupBy("lang", "w1", "bucket", "w2", "w3").agg(F.sum("n").alias("n"))
    summed = folded.rollup("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n"), F.grouping_id().alias("gid"))
    level = F.when(F.col("gid") == 0, 3).when(F.col("gid") == 1, 2).when(F.col("gid") == 3, 1).when(F.col("gid") == 7, 0)
    told = summed.withColumn("level", level).drop("gid")
    phrase = (F.col("n") >= least) & (F.coalesce("w2", F.lit("-")) != "") & (F.coalesce("w3", F.lit("-")) != "")
    return told.where((F.col("level") == 0) | ((F.col("level") > 0) & phrase))


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)) over whole numbers of up to 38 digits."""
    return F.expr(f"(cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0))) div (cast({l} as decimal(18,0)) * cast({r} as decimal(18,0)))")


def _first(df: DataFrame, top: int) -> DataFrame:
    """The ``top`` phrases of each language with their rank; parts are ranked first, so no task sorts a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", "_part").orderBy(*order)
    parts = df.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_PARTS)))
    best = parts.withColumn("_place", F.row_number().over(part)).where(F.col("_place") <= top).drop("_part", "_place")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)


def collocations(df: DataFrame, text_column: str = "text", lang_column: str = "lang", how: Collocations = Collocations()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of each language.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its lowest-scoring cut (the smallest of equal ones), ``n`` all words
    of the language. Only A-Z are lower-cased. Pieces end at . , ; : ! ? and line feed to carriage return; words end at spaces and
    tabs. A null language counts as ``und``, null and empty texts have no words; repeated rows count again; equal scores and
    counts are ranked by the bytes of the phrase. An empty table gives an empty result; other columns are ignored. Scores are
    exact for counts below 10^15.
    """
    docs = pick(df, text=text_column, lang=lang_column)
    docs = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    counts = materialise(phrase_counts(docs, how.least), "phrases")

    def level(size: int, *names: str, n: str) -> DataFrame:
        return counts.where(F.col("level") == size).select("lang", *[F.col(f"w{i + 1}").alias(c) for i, c in enumerate(names)], F.col("n").alias(n))

    two, three = level(2, "w1", "w2", n="a"), level(3, "w1", "w2", "w3", n="a")
    pairs = two.join(level(1, "w1", n="l"), ["lang", "w1"]).join(level(1, "w2", n="r"), ["lang", "w2"]).withColumn("score", _score("a", "l", "r"))
    # A pair's cover: the most frequent candidate around it.
    around = three.select("lang", "a", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    cover = around.groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("cover"))
    free = pairs.join(cover, ["lang", "w1", "w2"], "left").where(f"cover IS NULL OR 100 * cover < {how.inside} * a")
    cuts = three.join(level(1, "w1", n="l1"), ["lang", "w1"]).join(level(2, "w2", "w3", n="r1"), ["lang", "w2", "w3"])
    cuts = cuts.join(level(2, "w1", "w2", n="l2"), ["lang", "w1", "w2"]).join(level(1, "w3", n="r2"), ["lang", "w3"])
    cuts = cuts.withColumns({"s1": _score("a", "l1", "r1"), "s2": _score("a", "l2", "r2")})
    late = F.col("s2") < F.col("s1")
    triples = cuts.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", *[F.when(late, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(name) for c, name in (("l", "l"), ("r", "r"), ("s", "score"))])
    phrases = free.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", "score").unionByName(triples)
    best = _first(phrases, how.top)
    return best.join(level(0, n="n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
