"""Near-duplicates of documents as multisets of word shingles, with BagMinHash signatures.

A document is the multiset of its runs of five lower-cased words. For every shingle a Poisson process
on (0, count] is explored level by level (one level per power of two, so the weights are discretised and
a larger count only adds levels); a point has a time and falls into one register. A register holds the
earliest time, so two documents agree in a register with a probability equal to their weighted Jaccard
similarity. Registers are banded. A small bucket is compared pair by pair, a larger one with its centre, and
pairs whose multisets really overlap enough are linked. Texts of a large bucket that stay apart are then compared
with those that share a change against the centre. Large buckets that still hold several groups are cut into blocks,
and every pair of texts of different groups is compared there, so only banding can miss a pair. Classes are the
connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import components
from .tables import fresh, pick
from .textio import Words, group_sums, mix, pieces, rolling, signed

U64 = np.uint64

#: Texts and bytes of text of a block on average; a task holds two blocks at a time.
BLOCK_TEXTS, BLOCK_BYTES = 128, 2 << 20
#: Elements whose presence in the texts of two blocks is multiplied at once.
ELEMENTS = 1 << 13


@dataclass(frozen=True)
class Signature:
    """``registers`` = ``bands`` x ``rows``; a pair at the threshold is missed with (1 - 0.8 ** rows) ** bands."""

    shingle: int = 5
    registers: int = 64
    bands: int = 16
    #: A pair is linked from this weighted Jaccard similarity on, written as a fraction.
    at_least: tuple[int, int] = (4, 5)
    #: Buckets of up to so many texts are compared pair by pair, larger ones with their centre.
    small: int = 12

    @property
    def rows(self) -> int:
        return self.registers // self.bands


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Text number and hash of every shingle; a text of fewer words is one shingle of all its words."""
    words = Words(texts, lower=True)
    at, key = words.windows(size)
    text = words.text[at]
    for short in range(1, size):
        own = np.flatnonzero(words.count == short)
        if len(own):
            text = np.concatenate([text, own])
            key = np.concatenate([key, rolling(words.hash, short)[words.first[own]]])
    return text, key, words.texts


def multiset(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) pairs with their counts."""
    codes, _ = pd.factorize(key ^ mix(text.astype(U64) + U64(1)))
    count = np.bincount(codes)
    place = np.zeros(len(count), np.int64)
    place[codes[::-1]] = np.arange(len(codes))[::-1]
    return text[place], key[place], count


def _multiple(constant: int, times: int) -> np.uint64:
    return U64(constant * times & 0xFFFFFFFFFFFFFFFF)


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1 from 64 random bits."""
    return ((x >> U64(12)).astype(np.float64) + 0.5) * 2.0**-52


def signatures(text: np.ndarray, key: np.ndarray, count: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """Earliest times per text and register as 32-bit numbers; texts without shingles keep infinity."""
    out = np.full((texts, registers), np.inf)
    weight = np.bincount(text, weights=count, minlength=texts)
    open_texts = weight > 0
    reach = np.zeros(texts)
    reach[open_texts] = registers * (np.log(registers) + 3) / weight[open_texts]
    while open_texts.any():
        chosen = open_texts[text]
        _explore(out, text[chosen], key[chosen], count[chosen], reach, registers)
        # All points up to the reach are known; a text is done when every register was hit.
        open_texts = open_texts & ~np.isfinite(out).all(axis=1)
        out[open_texts] = np.inf
        reach *= 2
    return out.astype(np.float32)


def _explore(out: np.ndarray, text: np.ndarray, key: np.ndarray, count: np.ndarray, reach: np.ndarray, registers: int) -> None:
    flat = out.reshape(-1)
    level = 0
    while len(text):
        low = 0 if level == 0 else 1 << (level - 1)
        length = max(low, 1)
        here = count > low
        text, key, count = text[here], key[here], count[here]
        seed = mix(key + _multiple(0x632BE59BD9B4E019, level + 1))
        time = np.zeros(len(text))
        own, share = text, np.minimum((count - low) / length, 1.0)
        step = 0
        while len(own):
            draw = mix(seed + _multiple(0x9E3779B97F4A7C15, step))
            gap = _unit(draw)
            alive = gap > np.exp(-(reach[own] - time) * length) if step else gap > np.exp(-reach * length)[own]
            seed, draw, gap, own, share, time = seed[alive], draw[alive], gap[alive], own[alive], share[alive], time[alive]
            time = time - np.log(gap) / length
            second = mix(draw ^ U64(0xA0761D6478BD642F))
            hit = _unit(second) < share if level else slice(None)
            register = ((second & U64(0xFFF)) * U64(registers)) >> U64(12)
            np.minimum.at(flat, (own * registers + register.astype(np.int64))[hit], time[hit])
            step += 1
        level += 1


def band_hashes(values: np.ndarray, bands: int) -> np.ndarray:
    """A hash for each band of registers, different from band to band."""
    texts, registers = values.shape
    grouped = values.view(np.uint32).astype(U64).reshape(texts, bands, registers // bands)
    out = np.tile(np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), (texts, 1))
    for i in range(registers // bands):
        out = mix(out * U64(0xD6E8FEB86659FD93) + grouped[:, :, i])
    return out


def _sign(source: DataFrame, how: Signature) -> DataFrame:
    schema = f"doc_id {dict(source.dtypes)['doc_id']}, node binary, registers binary, bands array<bigint>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            text, key, texts = shingles(piece.column("text"), how.shingle)
            values = signatures(*multiset(text, key), texts, how.registers)
            blank = np.bincount(text, minlength=texts) == 0
            raw = values.tobytes()
            width = 4 * how.registers
            held = pa.array([None if blank[i] else raw[i * width : (i + 1) * width] for i in range(texts)], pa.binary())
            flat = pa.array(signed(band_hashes(values, how.bands)).reshape(-1))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(texts + 1) * how.bands, pa.int32()), flat)
            node = pa.array([None if blank[i] else x for i, x in enumerate(piece.column("node").to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), node, held, bands], names=["doc_id", "node", "registers", "bands"])

    return source.mapInArrow(sign, schema)


def overlaps(left: pa.Array, right: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the multiset intersections and unions of paired texts."""
    a_text, a_key, pairs = shingles(left, size)
    b_text, b_key, _ = shingles(right, size)
    text = np.concatenate([a_text, b_text])
    codes, _ = pd.factorize(np.concatenate([a_key, b_key]) ^ mix(text.astype(U64) + U64(1)))
    n = codes.max() + 1 if len(codes) else 0
    a, b = np.bincount(codes[: len(a_text)], minlength=n), np.bincount(codes[len(a_text) :], minlength=n)
    owner = np.zeros(n, np.int64)
    owner[codes] = text
    common = np.bincount(owner, weights=np.minimum(a, b), minlength=pairs).astype(np.int64)
    total = np.bincount(owner, weights=a + b, minlength=pairs).astype(np.int64)
    return common, total - common


def similar_pairs(left: pa.Array, right: pa.Array, how: Signature) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the texts of each pair, one from ``left`` and one from ``right``, whose multisets overlap enough."""
    text, key, texts = shingles(pa.concat_arrays([left, right]), how.shingle)
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    fresh_run = np.ones(len(text), bool)
    fresh_run[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    heads = np.flatnonzero(fresh_run)
    # Each further occurrence of a shingle is an element of its own, so multisets overlap as sets of elements do.
    again = np.arange(len(text)) - np.repeat(heads, np.diff(np.append(heads, len(text))))
    codes, _ = pd.factorize(mix(key + again.astype(U64) * U64(0x632BE59BD9B4E019)))
    size = np.bincount(text, minlength=texts).astype(np.int64)
    n, first = codes.max() + 1 if len(codes) else 0, text < len(left)
    both = (np.bincount(codes[first], minlength=n) > 0) & (np.bincount(codes[~first], minlength=n) > 0)
    column = np.cumsum(both) - 1
    used = both[codes]
    text, column = text[used], column[codes[used]]
    order = np.argsort(column, kind="stable")
    text, column = text[order], column[order]
    common = np.zeros((len(left), len(right)))
    for low in range(0, int(both.sum()), ELEMENTS):
        a, b = np.searchsorted(column, [low, low + ELEMENTS])
        held = np.zeros((texts, ELEMENTS), np.float32)
        held[text[a:b], column[a:b] - low] = 1
        common += held[: len(left)] @ held[len(left) :].T
    over, under = how.at_least
    union = size[: len(left), None] + size[None, len(left) :] - common
    return np.nonzero((under * common >= over * union) & (union > 0))


def additions(left: pa.Array, right: pa.Array, size: int) -> pa.ListArray:
    """Of each pair, the shingles that the right text holds more often than the left one."""
    a_text, a_key, pairs = shingles(left, size)
    b_text, b_key, _ = shingles(right, size)
    key, text = np.concatenate([a_key, b_key]), np.concatenate([a_text, b_text])
    codes, _ = pd.factorize(key ^ mix(text.astype(U64) + U64(1)))
    n = codes.max() + 1 if len(codes) else 0
    more = np.bincount(codes[len(a_text) :], minlength=n) > np.bincount(codes[: len(a_text)], minlength=n)
    owner, own = np.zeros(n, np.int64), np.zeros(n, U64)
    owner[codes], own[codes] = text, key
    owner, own = owner[more], own[more]
    order = np.argsort(owner, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=pairs))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(signed(own[order])))


def _verify(pairs: DataFrame, texts: DataFrame, how: Signature) -> DataFrame:
    """Pairs (a, b, centred) with ``linked``: their multisets overlap enough. Centred pairs also tell what b adds to a."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "centred", "a_text", "b_text")
    over, under = how.at_least

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for half in pieces(batches, "a_text"):
            for piece in pieces(iter([half]), "b_text"):
                a, b = piece.column("a_text"), piece.column("b_text")
                common, union = overlaps(a, b, how.shingle)
                linked = pa.array((under * common >= over * union) & (union > 0))
                centred = piece.column("centred")
                added = additions(pc.if_else(centred, a, ""), pc.if_else(centred, b, ""), how.shingle)
                yield pa.RecordBatch.from_arrays([piece.column("a"), piece.column("b"), linked, added], names=["a", "b", "linked", "added"])

    return joined.mapInArrow(compare, "a binary, b binary, linked boolean, added array<bigint>")


def _texts_of(nodes: DataFrame, source: DataFrame) -> DataFrame:
    """One text per node, read from the node's first document."""
    same = F.coalesce(source["doc_id"].cast("string"), F.lit(""))
    wanted = nodes.select("node", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"))
    found = source.select(F.col("node"), same.alias("_id"), "text").join(wanted, ["node", "_id"], "left_semi")
    return found.dropDuplicates(["node", "_id"]).select("node", "text")


def _buckets(entries: DataFrame) -> DataFrame:
    """The entries of buckets with more than one text, with the size of the bucket."""
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return materialise(entries.join(sizes, "bucket"), "buckets")


def _first_pairs(shared: DataFrame, how: Signature) -> DataFrame:
    """Pairs of texts that share a bucket: all pairs of a small one, centre and member of a larger one.

    The centre is the member that meets most texts over all its buckets, which in a group of edited copies is the text
    that the others were made from.
    """
    few = shared.where(F.col("size") <= how.small).select("bucket", "node")
    close = few.alias("x").join(few.alias("y"), "bucket").where("x.node < y.node").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    many = shared.where(F.col("size") > how.small)
    met = shared.join(many.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.sum(F.round(1000 * F.log2("size")).cast("bigint")).alias("met"))
    ranked = many.join(met, "node").select("bucket", "node", "met")
    centres = ranked.groupBy("bucket").agg(F.max_by("node", F.struct("met", "node")).alias("centre"))
    spokes = many.select("bucket", "node").join(centres, "bucket").where(F.col("node") != F.col("centre"))
    return _pairs(close, spokes.select(F.col("centre").alias("a"), F.col("node").alias("b")))


def _pairs(close: DataFrame, spokes: DataFrame) -> DataFrame:
    both = close.withColumn("centred", F.lit(False)).unionByName(spokes.withColumn("centred", F.lit(True)))
    return both.groupBy("a", "b").agg(F.max("centred").alias("centred"))


def _second_pairs(verified: DataFrame, labels: DataFrame, how: Signature) -> DataFrame:
    """Pairs of one centre's bucket, still in different groups, that share a change against the centre.

    Two texts closer to each other than to their centre have made a change in common. Groups of texts with one added
    shingle are treated as the buckets were: small ones pair by pair, larger ones by the member with the fewest changes.
    """
    changed = verified.where(F.size("added") > 0).select(F.col("a").alias("centre"), F.col("b").alias("node"), F.size("added").alias("changes"), F.explode("added").alias("shingle"))
    grouped = changed.select(F.xxhash64("centre", "shingle").alias("group"), "node", "changes")
    counts = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    labelled = grouped.join(counts, "group").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = materialise(labelled, "changes")
    mixed = labelled.groupBy("group").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.min(F.struct("changes", "node", "label")).alias("first")).where("_lo <> _hi")
    members = labelled.join(mixed.select("group", "first"), "group")
    few = members.where(F.col("size") <= how.small).select("group", "node", "label")
    close = few.alias("x").join(few.alias("y"), "group").where("x.node < y.node and x.label <> y.label").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    far = members.where((F.col("size") > how.small) & (F.col("label") != F.col("first.label"))).select(F.col("first.node").alias("a"), F.col("node").alias("b"))
    pairs = close.unionByName(far).distinct().join(verified.select("a", "b"), ["a", "b"], "left_anti")
    return pairs.withColumn("centred", F.lit(False))


def _cells(shared: DataFrame, labels: DataFrame, texts: DataFrame, how: Signature) -> DataFrame:
    """Texts of the large buckets that hold several groups, once for each cell: cell, side, node and label.

    A cell is a pair of blocks of one bucket. The bucket's largest group needs no comparison with itself, so its blocks meet
    only those of the other texts, which also meet each other. Buckets with the same texts count once.
    """
    sizes = texts.select("node", F.octet_length("text").cast("bigint").alias("bytes"))
    many = shared.where(F.col("size") > how.small).join(labels, "node", "left").join(sizes, "node")
    many = materialise(many.select("bucket", "node", F.coalesce("label", "node").alias("label"), "bytes"), "members")
    groups = many.groupBy("bucket", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")
    )
    largest = F.max(F.struct("n", "bytes", "label")).alias("main")
    buckets = groups.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), largest)
    buckets = buckets.where(F.col("n") > F.col("main.n")).groupBy("n", "x", "y").agg(F.min(F.struct("bucket", "bytes", "main")).alias("_b")).select("n", "_b.*")
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK_TEXTS), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    buckets = buckets.select(
        "bucket", F.col("main.label").alias("main"), blocks(F.col("main.n"), F.col("main.bytes")).alias("main_blocks"),
        blocks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("blocks"),
    )
    members = many.join(buckets, "bucket").withColumn("is_main", F.col("label") == F.col("main"))
    own = F.pmod(F.xxhash64("node", F.lit(2)), F.when(F.col("is_main"), F.col("main_blocks")).otherwise(F.col("blocks"))).cast("int")
    # Other texts are numbered from 0 on, the largest group's blocks after them; a cell is a pair of numbers, the lower first.
    number = F.when(F.col("is_main"), F.col("blocks") + F.col("own")).otherwise(F.col("own"))
    members = members.withColumn("own", own).withColumn("number", number)
    last = F.when(F.col("is_main"), F.col("blocks")).otherwise(F.col("blocks") + F.col("main_blocks")) - 1
    meets = members.select("bucket", "node", "label", "number", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    low, high = F.least("number", "other"), F.greatest("number", "other")
    side = F.when(low == high, 2).when(F.col("number") == low, 0).otherwise(1).alias("side")
    return meets.select(F.xxhash64("bucket", low, high).alias("cell"), side, "node", "label")


def _cell_links(cells: DataFrame, texts: DataFrame, how: Signature) -> DataFrame:
    """Links between texts of different groups that share a cell, as few as join the same texts."""

    def compare(table: pa.Table) -> pa.Table:
        side, node, label = table.column("side").to_numpy(), table.column("node").to_pylist(), table.column("label").to_pylist()
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        group = {x: x for x in label}

        def head(x: bytes) -> bytes:
            while group[x] != x:
                group[x] = x = group[group[x]]
            return x

        found: tuple[list, list] = ([], [])
        if len(left) and len(right) and len(group) > 1:
            text = table.column("text").combine_chunks()
            codes, _ = pd.factorize(np.array(label, object))
            a, b = similar_pairs(text.take(pa.array(left)), text.take(pa.array(right)), how)
            a, b = left[a], right[b]
            apart = codes[a] != codes[b]
            for i, j in zip(a[apart], b[apart]):
                x, y = head(label[i]), head(label[j])
                if x != y:
                    group[x] = y
                    found[0].append(node[i])
                    found[1].append(node[j])
        return pa.table({"a": pa.array(found[0], pa.binary()), "b": pa.array(found[1], pa.binary())})

    return cells.join(texts, "node").groupBy("cell").applyInArrow(compare, "a binary, b binary")


def near_duplicate_classes(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", how: Signature = Signature()) -> DataFrame:
    """One row per input row: doc_id, text_key, class_id and kept.

    ``class_id`` is the smallest id of the class (null only if all its ids are null), ``text_key`` a digest of the text, and
    ``kept`` is true for the class's first text under that id (for all its rows, if the row is repeated). Equal texts are one
    node whatever their number, so copies are never expanded into pairs. Null, empty and blank texts have no words: they are
    never linked and stay kept, each under its own id. An empty table gives an empty result; other columns are ignored.
    """
    source = pick(df, doc_id=id_column, text=text_column)
    keyed = source.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.unhex(F.md5("text")))
    signed_rows = materialise(_sign(keyed, how), "signatures")
    worded = signed_rows.where(F.col("node").isNotNull())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id"))
    nodes = materialise(
        worded.groupBy("node").agg(first.alias("first"), F.min("registers").alias("registers"), F.first("bands").alias("bands")), "nodes"
    )
    entries = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = _buckets(entries)
    pairs = materialise(_first_pairs(shared, how), "pairs")
    involved = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = nodes.join(involved, "node", "left_semi").select("node", F.col("first.doc_id").alias("doc_id"))
    texts = materialise(_texts_of(ids, keyed), "texts")
    verified = materialise(_verify(pairs, texts, how), "verified")
    links = verified.where("linked").select("a", "b")
    labels = materialise(components(links), "labels")
    more_pairs = materialise(_second_pairs(verified, labels, how), "pairs")
    if more_pairs.limit(1).count():
        more = materialise(_verify(more_pairs, texts, how), "verified").where("linked").select("a", "b")
        links = links.unionByName(more)
        labels = materialise(components(links), "labels")
    cells = materialise(_cells(shared, labels, texts, how), "cells")
    if cells.limit(1).count():
        rest = materialise(_cell_links(cells, texts, how), "links")
        if rest.limit(1).count():
            labels = materialise(components(links.unionByName(rest)), "labels")
    return _classes(signed_rows, nodes, labels)


def _classes(rows: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    labelled = nodes.select("node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = labelled.groupBy("label").agg(F.min(F.struct("first.blank", "first.doc_id", "node")).alias("head"))
    by_node = labelled.join(heads, "label").select("node", F.col("head.doc_id").alias("class_id"), F.col("head.node").alias("_head"))
    kept: Column = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("_head"))
    found = rows.where(F.col("node").isNotNull()).select("doc_id", "node").join(by_node, "node")
    blank = rows.where(F.col("node").isNull()).select("doc_id", F.col("node").alias("text_key"), F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return found.select("doc_id", F.col("node").alias("text_key"), "class_id", kept.alias("kept")).unionByName(blank)


def keep_one_per_class(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", how: Signature = Signature()) -> DataFrame:
    """One row of each class, with all columns of ``df``; rows without words all stay."""
    node, code = fresh(df, "_node"), fresh(df, "_id")
    classes = near_duplicate_classes(df, id_column, text_column, how).where("kept AND text_key IS NOT NULL")
    chosen = classes.select(F.col("text_key").alias(node), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(code)).distinct()
    text = F.col(f"`{text_column}`")
    tagged = df.withColumns({node: F.unhex(F.md5(F.coalesce(text, F.lit("")))), code: F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit(""))})
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    one = tagged.where(worded).join(chosen, [node, code], "left_semi").dropDuplicates([node, code])
    return one.unionByName(tagged.where(~worded)).select(*[F.col(f"`{c}`") for c in df.columns])
