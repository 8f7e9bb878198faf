"""Building blocks that stay exact when one key holds a large share of all rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import any_of, value_bucket
from ..session import materialise

#: Rows up to which a group's known values may stand in one task, and the slots over which group sizes are counted.
FEW_ROWS, SLOTS = 1 << 16, 1 << 16


@dataclass(frozen=True)
class Quantile:
    """An exact quantile of ``value`` (interpolated), over the rows where ``value`` is not null."""

    value: Column
    share: float = 0.5


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on all keys (planned as an equi-join)."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys where null equals null, keeping the left copy of the keys."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def with_group(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """Add group aggregates to every row: partial aggregation first, then a join.

    Unlike an unordered window this never sorts a whole group into one task.
    """
    return join_keys(df, df.groupBy(*keys).agg(*aggregates), keys)


def pick_row(df: DataFrame, keys: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) in ``order``, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    best = pick(F.struct(*[F.col(c) for c in rest]), F.struct(*order)).alias("_row")
    # Rows of any width are aggregated by sorting; a leading hash makes that sort compare numbers.
    lead = [F.xxhash64(*keys).alias("_lead")] if len(keys) > 1 else []
    return df.groupBy(*lead, *keys).agg(best).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def smallest_row(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the smallest by its other columns from left to right, nulls first."""
    return pick_row(df, keys, [F.col(c) for c in df.columns if c not in keys])


def first_known(name: str, order: Column) -> Column:
    """The first non-null value of a column in ``order``."""
    return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), order)).alias(name)


def group_quantiles(
    df: DataFrame, keys: list[str], quantiles: dict[str, Quantile], others: dict[str, Column] | None = None, stored: bool = False
) -> DataFrame:
    """``groupBy(keys)`` with exact quantiles next to ordinary aggregates.

    Rows are counted per coarse order-preserving bucket before the shuffle, with the smallest and largest value, which settles
    the ranks at the ends of a bucket and in buckets of one value. What is still open is looked up among the values of its own
    bucket. No task holds more of a group than its buckets, or one bucket. NaN counts as unknown; infinities take their place in
    order.

    Nothing runs before the result is asked for. Callers that store the result anyway may have work ``stored`` at once: group sizes
    are then counted first, groups of few rows take one shuffle with all their values, and only the others go by buckets.
    """
    known = {f"_q_{a}": F.nanvl(q.value.cast("double"), F.lit(None).cast("double")) for a, q in quantiles.items()}
    work = df.withColumns(known)
    if stored and keys:
        small, large = rows_by_size(work, keys)
        found = _small_groups(small, keys, quantiles, others or {})
        return found if large is None else found.unionByName(_bucketed_groups(large, keys, quantiles, others or {}, stored))
    return _bucketed_groups(work, keys, quantiles, others or {}, stored)


def rows_by_size(work: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups that surely have few rows, and the others (None: there are none).

    Rows are counted per slot of a hash of the keys, which is no less than the rows of any group in it; at most one number per
    crowded slot comes back.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS))
    counted = work.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW_ROWS)
    crowded = [r.slot for r in counted.select("slot").collect()]
    return (work.where(~slot.isin(crowded)), work.where(slot.isin(crowded))) if crowded else (work, None)


def _small_groups(work: DataFrame, keys: list[str], quantiles: dict[str, Quantile], others: dict[str, Column]) -> DataFrame:
    """One shuffle: a group's known values come together, at most ``FEW_ROWS`` of them, and are sorted.

    Rows are dealt as they are: lists would be sorted by key before the shuffle as well as after it, and be no smaller. A leading
    hash makes the sort by key compare numbers.
    """
    listed = [F.sort_array(F.collect_list(f"_q_{a}")).alias(f"_q_{a}") for a in quantiles]
    found = work.repartition(*keys).groupBy(F.xxhash64(*keys).alias("_lead"), *keys).agg(*[e.alias(a) for a, e in others.items()], *listed)
    return found.select(*keys, *others, *[sorted_quantile(F.col(f"_q_{a}"), q.share).alias(a) for a, q in quantiles.items()])


def sorted_quantile(values: Column, share: float) -> Column:
    """The interpolated quantile of a sorted list, null for an empty one."""
    spot = (F.size(values) - 1) * F.lit(float(share))
    low, part = F.get(values, F.floor(spot).cast("int")), spot - F.floor(spot)
    high = F.get(values, F.ceil(spot).cast("int"))
    return F.when(low == high, low).otherwise(low * (1 - part) + high * part)


def _bucketed_groups(work: DataFrame, keys: list[str], quantiles: dict[str, Quantile], others: dict[str, Column], stored: bool) -> DataFrame:
    known = [f"_q_{a}" for a in quantiles]
    plain = [e.alias(a) for a, e in others.items()]
    base = work.groupBy(*keys).agg(F.count(F.lit(1)).alias("_group_rows"), *plain)
    picked = _ranked_quantiles(work.select(*keys, *known), keys, quantiles, stored)
    if not keys:
        # The whole table is one group: its quantiles ride along as a scalar subquery.
        value = picked.select(F.struct(*quantiles).alias("v")).scalar()
        return base.withColumn("_v", value).select(*others, *[F.col(f"_v.{a}").alias(a) for a in quantiles])
    return join_keys(base, picked, keys).select(*keys, *others, *quantiles)


def known_quantiles(df: DataFrame, keys: list[str], quantiles: dict[str, Quantile], stored: bool = False) -> DataFrame:
    """The exact quantiles of ``group_quantiles`` alone, without groups that have no known value."""
    known = {f"_q_{a}": F.nanvl(q.value.cast("double"), F.lit(None).cast("double")) for a, q in quantiles.items()}
    work = df.select(*keys, *[c.alias(a) for a, c in known.items()])
    if not (stored and keys):
        return _ranked_quantiles(work, keys, quantiles, stored)
    small, large = rows_by_size(work, keys)
    found = _small_groups(small, keys, quantiles, {}).where(any_of([F.col(a).isNotNull() for a in quantiles]))
    return found if large is None else found.unionByName(_ranked_quantiles(large, keys, quantiles, stored))


def _settled(end: str) -> Column:
    """The value at a rank as far as its bucket tells."""
    at = lambda c: F.col(f"{end}.{c}")
    return F.when((at("j") == 0) | (at("lo") == at("hi")), at("lo")).when(at("j") == at("c") - 1, at("hi"))


def _ranked_quantiles(df: DataFrame, keys: list[str], quantiles: dict[str, Quantile], stored: bool) -> DataFrame:
    """Exact quantiles by rank, from bucket counts."""
    names, group = list(quantiles), [*keys, "_metric"]
    pairs = F.array_compact(F.array(*[F.when(F.col(f"_q_{a}").isNotNull(), F.struct(F.lit(a).alias("_metric"), F.col(f"_q_{a}").alias("_value"))) for a in names]))
    long = df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p._metric", "_p._value").withColumn("_bucket", value_bucket(F.col("_value")))
    shares = F.create_map(*[x for a, q in quantiles.items() for x in (F.lit(a), F.lit(float(q.share)))])
    buckets = long.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_c"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi"))
    order = Window.partitionBy(*group).orderBy("_bucket")
    total = F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = buckets.withColumns({"_spot": (total - 1) * shares[F.col("_metric")], "_end": F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))})

    def at(rank: Column) -> Column:
        covers = (F.col("_end") > rank) & (F.col("_end") - F.col("_c") <= rank)
        return F.max(F.when(covers, F.struct(F.col("_bucket").alias("bucket"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_c").alias("c"), (rank - F.col("_end") + F.col("_c")).alias("j"))))

    low, high = F.floor("_spot"), F.ceil("_spot")
    located = placed.groupBy(*group).agg(at(low).alias("_low"), at(high).alias("_high"), F.max(F.col("_spot") - low).alias("_part"))
    located = materialise(located, "quantile-buckets") if stored else located
    ends = {"_vlo": _settled("_low"), "_vhi": _settled("_high")}
    is_open = ends["_vlo"].isNull() | ends["_vhi"].isNull()
    found = located.where(~is_open).select(*group, "_part", *[v.alias(a) for a, v in ends.items()])
    open_groups = located.where(is_open)
    if not (stored and open_groups.isEmpty()):
        found = found.unionByName(_inside_buckets(open_groups, long, group, stored))
    value = F.when(F.col("_vlo") == F.col("_vhi"), F.col("_vlo")).otherwise(
        F.col("_vlo") * (1 - F.col("_part")) + F.col("_vhi") * F.col("_part")
    )
    picks = [F.max(F.when(F.col("_metric") == a, value)).alias(a) for a in names]
    return found.groupBy(*keys).agg(*picks) if keys else found.agg(*picks)


def _inside_buckets(open_groups: DataFrame, long: DataFrame, group: list[str], stored: bool) -> DataFrame:
    """Both values of groups with a rank inside a bucket of several values, from the counted values of these buckets.

    Once the open buckets are stored their size is known, and values of other buckets leave before they are dealt.
    """
    wanted = open_groups.select(*group, F.explode(F.array(*[F.struct(F.lit(end).alias("end"), F.col(f"{side}.bucket").alias("bucket"), F.col(f"{side}.j").alias("j")) for end, side in (("_vlo", "_low"), ("_vhi", "_high"))])).alias("w"))
    wanted = wanted.select(*group, F.col("w.end").alias("_name"), F.col("w.bucket").alias("_bucket"), F.col("w.j").alias("_j"))
    if stored:
        wanted = materialise(wanted, "open-buckets")
        long = join_keys(long, wanted.select(*group, "_bucket").distinct(), [*group, "_bucket"], "left_semi")
    values = long.groupBy(*group, "_bucket", "_value").agg(F.count(F.lit(1)).alias("_c"))
    near = join_keys(wanted, values, [*group, "_bucket"], "inner")
    upto = F.sum("_c").over(Window.partitionBy(*group, "_name").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("_upto", upto).where((F.col("_j") < F.col("_upto")) & (F.col("_j") >= F.col("_upto") - F.col("_c")))
    picks = [F.max(F.when(F.col("_name") == a, F.col("_value"))).alias(a) for a in ("_vlo", "_vhi")]
    return join_keys(open_groups.select(*group, "_part"), near.groupBy(*group).agg(*picks), group)


def value_positions(df: DataFrame, keys: list[str], value: str, descending: bool = True) -> DataFrame:
    """Per key and distinct value: rows before it, rows equal to it and rows in all.

    ``rows_before + 1`` is the minimum rank. Null and NaN values have no position. Positions come from bucket totals, so no task
    sorts a whole group: neither one month of all complexes nor the whole table.
    """
    present = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counted = present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("rows_equal"))
    counted = counted.withColumn("_bucket", value_bucket(F.col(value)))
    totals = counted.groupBy(*keys, "_bucket").agg(F.sum("rows_equal").alias("_bc"))
    sort = F.desc if descending else F.asc
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    running = w.orderBy(sort("_bucket")).rowsBetween(Window.unboundedPreceding, 0)
    totals = (
        totals.withColumn("_start", F.sum("_bc").over(running) - F.col("_bc"))
        .withColumn("rows_total", F.sum("_bc").over(w))
        .drop("_bc")
    )
    placed = join_keys(counted, totals, [*keys, "_bucket"], "inner")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(sort(value)).rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("_start") + F.sum("rows_equal").over(inside) - F.col("rows_equal")
    return placed.withColumn("rows_before", before).drop("_bucket", "_start")


def with_rank(df: DataFrame, keys: list[str], value: str, alias: str, descending: bool = True) -> DataFrame:
    """Minimum rank (1, 1, 3) of a value within its group; null values get no rank."""
    positions = value_positions(df, keys, value, descending)
    positions = positions.select(*keys, value, (F.col("rows_before") + 1).alias(alias))
    return join_keys(df, positions, [*keys, value])


def with_percent_rank(df: DataFrame, keys: list[str], value: str, alias: str) -> DataFrame:
    """Average rank divided by the number of known values in the group."""
    positions = value_positions(df, keys, value, descending=False)
    mean_rank = F.col("rows_before") + (F.col("rows_equal") + 1) / 2
    positions = positions.select(*keys, value, (mean_rank / F.col("rows_total")).alias(alias))
    return join_keys(df, positions, [*keys, value])


def with_row_number(df: DataFrame, order: list[Column], alias: str) -> DataFrame:
    """Number all rows 1, 2, 3 .. in a total order without pulling them into one task.

    The sorted rows are stored once, so every later pass sees the same partitions; a row's
    number is its place in its partition plus the sizes of the partitions before it.
    """
    mark = {"_part": F.spark_partition_id(), "_mark": F.monotonically_increasing_id()}
    stored = materialise(df.orderBy(*order).withColumns(mark), "sorted")
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_mark").alias("_first"))
    upto = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per sorted partition, so this table is bounded by the partition count.
    starts = sizes.select("_part", "_first", F.coalesce(F.sum("_size").over(upto), F.lit(0)).alias("_start"))
    numbered = stored.join(F.broadcast(starts), "_part")
    return numbered.withColumn(alias, F.col("_start") + F.col("_mark") - F.col("_first") + 1).drop("_mark", "_part", "_start", "_first")


def unique_key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where(F.col("row_count") > 1)
