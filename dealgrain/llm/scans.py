"""Running totals over a total order, and places in a linked list, with no task holding a whole segment or list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import local_table, materialise

#: Up to so many links are ranked in one task (24 bytes each); longer lists are shortened first.
LOCAL_LINKS = 1 << 16
#: One link in so many stops a jump.
STRIDE = 16


def _accumulated(values: np.ndarray, fresh: np.ndarray, before: int, kind: str) -> np.ndarray:
    """Running totals that restart at ``fresh`` rows; rows in front of the first of these go on from ``before``."""
    plus, minus = (np.add, np.subtract) if kind == "sum" else (np.bitwise_xor, np.bitwise_xor)
    total = plus.accumulate(values)
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(values)), -1))
    base = np.where(start < 0, 0, minus(total, values)[np.maximum(start, 0)])
    out = minus(total, base)
    return np.where(start < 0, plus(out, np.int64(before)), out)


def running(df: DataFrame, segment: str, order: list[str], totals: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with running totals per segment: alias -> (column, "sum" or "xor"), both bigint and never null.

    Rows are sorted by segment (bigint, not null) and order over all tasks, so a segment of any length is split. Each sorted
    partition totals its own rows; what the partitions before add to its first segment is one row per partition.
    """
    kinds = T.StructType(df.schema.fields + [T.StructField(c, T.LongType()) for c in (*totals, "_part", "_row")] + [T.StructField("_open", T.BooleanType())])
    names = [f.name for f in kinds.fields]
    keys = [F.col(segment), *[F.asc_nulls_first(c) for c in order]]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    arrow = to_arrow_schema(kinds)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, last, first, before = TaskContext.get().partitionId(), 0, None, None, dict.fromkeys(totals, 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = batch.column(batch.schema.get_field_index(segment)).to_numpy()
            first = own[0] if first is None else first
            fresh = np.concatenate([[last is None or own[0] != last], own[1:] != own[:-1]])
            columns = []
            for alias, (source, kind) in totals.items():
                values = batch.column(batch.schema.get_field_index(source)).to_numpy()
                columns.append(_accumulated(values, fresh, before[alias], kind))
                before[alias] = int(columns[-1][-1])
            last = own[-1]
            columns += [np.full(n, part, np.int64), np.arange(row, row + n), own == first]
            row += n
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, *map(pa.array, columns)], arrow)], names=names)

    stored = materialise(ranged.mapInArrow(add, kinds), "running")
    tail = F.max_by(F.struct(F.col(segment).alias("segment"), *totals), "_row").alias("tail")
    # One row per sorted partition.
    ends = stored.groupBy("_part").agg(F.min_by(segment, "_row").alias("head"), tail).orderBy("_part").collect()
    rows, at, held = [], None, {}
    for end in ends:
        known = dict(held) if at == end["head"] else dict.fromkeys(totals, 0)
        rows.append((end["_part"], *[known[a] for a in totals]))
        whole = end["head"] == end["tail"]["segment"]  # one segment only: what came before goes on
        held = {a: _plus(end["tail"][a], known[a] if whole else 0, kind) for a, (_, kind) in totals.items()}
        at = end["tail"]["segment"]
    given = local_table(df.sparkSession, rows, "_part bigint, " + ", ".join(f"_b_{a} bigint" for a in totals))
    joined = stored.join(F.broadcast(given), "_part")
    added = {a: F.when(F.col("_open"), F.col(a) + F.col(f"_b_{a}") if kind == "sum" else F.col(a).bitwiseXOR(F.col(f"_b_{a}"))).otherwise(F.col(a)) for a, (_, kind) in totals.items()}
    return joined.withColumns(added).select(*df.columns, *totals)


def _plus(a: int, b: int, kind: str) -> int:
    return a + b if kind == "sum" else a ^ b


def _local_ranks(arc: np.ndarray, following: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of weights from each link to the end of its list, by pointer doubling; ``following`` is -1 at an end."""
    order = np.argsort(arc)
    at = np.where(following < 0, len(arc), order[np.minimum(np.searchsorted(arc, following, sorter=order), len(arc) - 1)])
    at, total = np.append(at, len(arc)), np.append(weight, 0)
    while (at < len(arc)).any():
        total, at = total + total[at], at[at]
    return total[:-1]


def list_ranks(links: DataFrame, level: int = 0) -> DataFrame:
    """arc and rank: the sum of weights from each link to the end of its list, itself included.

    ``links`` has arc (bigint, unique, not negative), next (null at the end) and weight. One link in ``STRIDE``, picked by a hash, is a stop. All
    links jump to the next stop, twice as far in every round, so the rounds grow with the logarithm of the longest gap between
    stops; the stops are a list of their own, shorter by ``STRIDE``, and are ranked the same way.
    """
    links = materialise(links.select("arc", "next", "weight"), "links")
    if links.count() <= LOCAL_LINKS:

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
            if table is not None and table.num_rows:
                arc, weight = (table.column(c).to_numpy() for c in ("arc", "weight"))
                following = table.column("next").combine_chunks().fill_null(-1).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(arc), pa.array(_local_ranks(arc, following, weight))], names=["arc", "rank"])

        return links.coalesce(1).mapInArrow(rank, "arc bigint, rank bigint")

    def stops(name: str):
        return F.pmod(F.xxhash64(name, F.lit(level)), F.lit(STRIDE)) == 0

    done = F.col("next").isNull() | stops("next")
    state = links.select("arc", F.col("next").alias("at"), F.col("weight").alias("total"), done.alias("done"))
    while not state.where("NOT done").isEmpty():
        target = state.select(F.col("arc").alias("at"), F.col("at").alias("beyond"), F.col("total").alias("more"), F.col("done").alias("there"))
        jumped = state.where("NOT done").join(target, "at").select("arc", F.col("beyond").alias("at"), (F.col("total") + F.col("more")).alias("total"), F.col("there").alias("done"))
        state = materialise(state.where("done").unionByName(jumped), "jumps")
    short = list_ranks(state.where(stops("arc")).select("arc", F.col("at").alias("next"), F.col("total").alias("weight")), level + 1)
    rest = short.select(F.col("arc").alias("at"), F.col("rank").alias("rest"))
    return state.join(rest, "at", "left").select("arc", (F.col("total") + F.coalesce("rest", F.lit(0))).alias("rank"))
