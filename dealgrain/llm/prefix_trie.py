"""The prefix trie of conversations, with subtree figures from an Euler tour.

A node is a distinct sequence of first turns, known by its depth and two 64-bit hashes. Every node gives two arcs, enter and
exit; an arc's successor is the first child, the next sibling or the parent's exit. The tour is a linked list that ``list_ranks``
ranks over all tasks, whatever the trie's depth or width. Prefix sums at the arcs' places then give every subtree: what is
entered between a node's two arcs lies below it.

A conversation of any length is split over tasks: turns are numbered and hashed by running totals over a sorted table. Children are
numbered in a row, so an arc's successor needs the numbers of a node's first and last child only, and the parent of a crowded
family is joined to runs of ``RUN`` children. One list of members per node ends in a digest that only a single task can make;
ids are streamed through it in order, a batch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .scans import list_ranks, running
from .tables import pick

#: Rows of one key that meet its one row in a join.
RUN = 4096
#: Conversations of one block lend their first one's opening turns.
BLOCK, OPENINGS = 100, 6

EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


def _runs(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(first / RUN), F.floor(last / RUN))).alias("run")


def _run(number: str) -> Column:
    return F.floor(F.col(number) / RUN).alias("run")


def ordered_turns(df: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """conv, place (from 0), two hashes of role and text, and chars of every turn, in order of turn (null first), role and text."""
    turns = pick(df, conv=conv_column, turn=turn_column, role=role_column, text=text_column).where("conv IS NOT NULL")
    known = turns.withColumns({"conv": F.col("conv").cast("bigint"), "role": F.coalesce(F.col("role").cast("string"), F.lit("")), "text": F.coalesce("text", F.lit("")), "one": F.lit(1).cast("bigint"), "row": F.monotonically_increasing_id()})
    numbered = running(known, "conv", ["turn", "role", "text", "row"], {"place": ("one", "sum")})
    hashes = [F.xxhash64(F.lit(i), "role", "text").alias(f"h{i}") for i in (1, 2)]
    return numbered.select("conv", (F.col("place") - 1).alias("place"), *hashes, F.length("text").cast("bigint").alias("chars"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, place, h1, h2, chars, size) and conversations (conv, size) after each conversation's first turns, up to five by
    a checksum of its id, were replaced by those of the first conversation of its block."""
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    block = F.col("conv") - F.col("conv") % BLOCK
    lent = F.crc32(F.col("conv").cast("string").cast("binary")) % OPENINGS
    convs = sizes.select("conv", "n", block.alias("block"), lent.alias("lent"))
    convs = convs.join(sizes.select(F.col("conv").alias("block"), F.col("n").alias("there")), "block", "left")
    convs = convs.withColumn("lead", F.least("lent", F.coalesce("there", F.lit(0).cast("bigint"))))
    convs = materialise(convs.withColumn("size", F.col("lead") + F.greatest(F.col("n") - F.col("lent"), F.lit(0).cast("bigint"))), "conversations")
    own = turns.withColumn("run", _run("place")).join(convs.select("conv", "lent", "lead", "size", _runs(F.lit(0), F.col("n") - 1)), ["conv", "run"])
    own = own.where("place >= lent").select("conv", (F.col("lead") + F.col("place") - F.col("lent")).alias("place"), "h1", "h2", "chars", "size")
    openings = turns.where(F.col("place") < OPENINGS - 1).withColumnRenamed("conv", "block")
    taken = openings.join(convs.select("conv", "block", "lent", "size"), "block").where("place < lent").select("conv", "place", "h1", "h2", "chars", "size")
    return own.unionByName(taken), convs.select("conv", "size")


def memberships(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, depth, node hashes k1, k2, the parent's q1, q2, chars of the last turn, and whether the conversation ends there."""
    placed = turns.withColumns({f"v{i}": F.xxhash64(f"h{i}", "place") for i in (1, 2)}).select("conv", "place", "v1", "v2", "chars", "size")
    hashed = running(placed, "conv", ["place"], {"k1": ("v1", "xor"), "k2": ("v2", "xor")})
    parents = [F.col(f"k{i}").bitwiseXOR(F.col(f"v{i}")).alias(f"q{i}") for i in (1, 2)]
    depth = F.col("place") + 1
    nodes = hashed.select("conv", depth.alias("depth"), "k1", "k2", *parents, "chars", (depth == F.col("size")).alias("ends"))
    nothing = F.lit(0).cast("bigint")
    root = convs.select("conv", nothing.alias("depth"), nothing.alias("k1"), nothing.alias("k2"), *[F.lit(None).cast("bigint").alias(c) for c in ("q1", "q2")], nothing.alias("chars"), (F.col("size") == 0).alias("ends"))
    return materialise(nodes.unionByName(root), "members")


NODE = ["depth", "k1", "k2"]


def _digests(members: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at a node, ascending and joined by commas, as a stream."""
    ends = members.where("ends").select(*NODE, "conv").repartition(*NODE).sortWithinPartitions(*NODE, "conv")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            keys, done = list(zip(*(batch.column(c).to_pylist() for c in NODE))), []
            ids = batch.column("conv").to_pylist()
            at = 0
            while at < len(ids):
                upto = at + 1
                while upto < len(ids) and keys[upto] == keys[at]:
                    upto += 1
                if keys[at] != node:
                    if digest:
                        done.append((*node, digest.hexdigest()))
                    node, digest = keys[at], hashlib.sha256(str(ids[at]).encode())
                    at += 1
                digest.update("".join(f",{i}" for i in ids[at:upto]).encode())
                at = upto
            if done:
                yield _node_rows(done)
        if digest:
            yield _node_rows([(*node, digest.hexdigest())])

    return ends.mapInArrow(told, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def _node_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[*NODE, "ends_sha256"])


def numbered_nodes(members: DataFrame) -> DataFrame:
    """One row per node with its number; siblings follow each other by conv_id, shallower nodes come first, the root is 0.

    first and last are the numbers of its first and last child, null for a leaf.
    """
    nodes = members.groupBy(*NODE).agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.min(c).alias(c) for c in ("q1", "q2", "chars")])
    counted = nodes.withColumns({"all": F.lit(0).cast("bigint"), "one": F.lit(1).cast("bigint")})
    placed = running(counted, "all", ["depth", "q1", "q2", "conv_id"], {"number": ("one", "sum")})
    placed = placed.select(*NODE, "q1", "q2", "conv_id", "n_convs", "chars", (F.col("number") - 1).alias("number"))
    family = placed.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.min("number").alias("first"), F.max("number").alias("last"))
    return materialise(placed.join(family, NODE, "left"), "nodes")


def tour(nodes: DataFrame) -> DataFrame:
    """arc and next: enter (twice the node's number) and exit (one more) of every node, in the order of the Euler tour."""
    enter, leave = (F.col("number") * 2), (F.col("number") * 2 + 1)
    down = nodes.select(enter.alias("arc"), F.coalesce(F.col("first") * 2, leave).alias("next"))
    up = nodes.where("last IS NOT NULL").select(F.col("last").alias("number"), leave.alias("up"))
    across = nodes.select("number").join(up, "number", "left")
    beside = F.when(F.col("number") > 0, F.coalesce("up", (F.col("number") + 1) * 2))
    return down.unionByName(across.select(leave.alias("arc"), beside.alias("next")))


def subtree_sums(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """number, n_leaves and saved_tokens of every node's subtree, from prefix sums at the places of its two arcs."""
    ranks = list_ranks(links.withColumn("weight", F.lit(1).cast("bigint")))
    saved = (F.col("n_convs") - 1) * F.col("chars")
    weights = nodes.select((F.col("number") * 2).alias("arc"), F.col("first").isNull().cast("bigint").alias("leaf"), saved.alias("saved"))
    nothing = F.lit(0).cast("bigint")
    placed = ranks.join(weights, "arc", "left").select("arc", (-F.col("rank")).alias("place"), F.coalesce("leaf", nothing).alias("leaf"), F.coalesce("saved", nothing).alias("saved"), nothing.alias("all"))
    sums = running(placed, "all", ["place"], {"leaves": ("leaf", "sum"), "savings": ("saved", "sum")})

    def between(total: str, own: str) -> Column:
        return F.sum(F.when(F.col("arc") % 2 == 1, F.col(total)).otherwise(F.col(own) - F.col(total)))

    return sums.groupBy(F.floor(F.col("arc") / 2).alias("number")).agg(between("leaves", "leaf").alias("n_leaves"), between("savings", "saved").alias("saved_tokens"))


def conversation_trie(df: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", rebuild: bool = True) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Turns are ordered by turn, null first; equal ones by role, then text, and repeated rows are turns of their own. A null role
    or text is empty. Rows without a conversation id belong to no conversation. With ``rebuild`` every conversation first
    takes the opening turns of its block. An empty table has no node; other columns are ignored.
    """
    turns = ordered_turns(df, conv_column, turn_column, role_column, text_column)
    if rebuild:
        turns, convs = rebuilt(turns)
    else:
        convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("size"))
        turns = turns.withColumn("run", _run("place")).join(convs.select("conv", "size", _runs(F.lit(0), F.col("size") - 1)), ["conv", "run"]).drop("run")
    members = memberships(turns, convs)
    nodes = numbered_nodes(members)
    sums = subtree_sums(nodes, tour(nodes))
    inner = nodes.where("first IS NOT NULL")
    parents = inner.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), _runs(F.col("first"), F.col("last")))
    told = nodes.withColumn("run", _run("number")).join(parents, ["depth", "q1", "q2", "run"], "left").join(sums, "number").join(_digests(members), NODE, "left")
    children = F.coalesce(F.col("last") - F.col("first") + 1, F.lit(0).cast("bigint"))
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", children.alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_DIGEST)).alias("ends_sha256"))
