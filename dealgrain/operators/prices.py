"""Prices per valuation month, complex and area from the contracts of a trailing window, for one or several estimators.

All months are priced in one pass of counts. Contracts are counted per month and coarse price bucket; these counts, not the contracts,
are dealt once by complex and area. Valuation months are only unfolded inside a task, for some thousand counts at a time: the counts of
all windows, the choice of the window, and the buckets in which the wanted ranks lie come out as one narrow row per month. What a task
holds of one complex and area is bounded by months and buckets, not by contracts.

A bucket knows its count, sum, smallest and largest price, which settles most ranks. Only ranks inside a bucket of several
different prices are looked up among that bucket's own prices, by rank, in a second step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import months
from ..functions.numeric import value_bucket
from ..session import materialise
from .scale import join_keys

CODE, AREA = "kapt_code", "area_sqm"
# Fixed value: price windows in months.
WINDOWS = (3, 6, 12)
#: Valuation months that are unfolded at once for a crowded key; a contract reaches at most two such runs.
RUN = 12
#: Counts that are unfolded at once, whole keys at a time.
UNFOLDED = 50_000

Rank = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class PriceProvider:
    """An estimator made of order statistics of the prices in a window.

    ``values`` names ranks (counted from 0, given an array of numbers of prices) whose price is wanted, ``sums`` names ranks before
    which the sum of prices is wanted. ``price`` makes the price of these (by name) and the number of prices. Providers share one
    aggregation; their results are told apart by ``source``.
    """

    source: str
    price: Callable[[dict[str, Column], Column], Column]
    values: dict[str, Rank] = field(default_factory=dict)
    sums: dict[str, Rank] = field(default_factory=dict)
    method: str = "median"


def _whole(c: Column) -> Column:
    return F.floor(c).cast("long")


MEDIAN = PriceProvider(
    "transaction_median",
    lambda at, n: F.when(at["low"] == at["high"], at["low"]).otherwise(at["low"] * 0.5 + at["high"] * 0.5),
    values={"low": lambda n: (n - 1) // 2, "high": lambda n: n // 2},
)


def trimmed_mean(share: float = 0.1) -> PriceProvider:
    """The mean without the lowest and the highest ``share`` of the prices (whole contracts)."""
    cut = lambda n: np.floor(n * share).astype("int64")
    return PriceProvider(
        "transaction_trimmed_mean",
        lambda at, n: (at["upto"] - at["low"]) / (n - 2 * _whole(n * share)),
        sums={"low": cut, "upto": lambda n: n - cut(n)},
        method="trimmed_mean",
    )


def month_indexes(labels: Iterable[str] | Column) -> Column:
    """Valuation months as an array of month indexes; a column is taken to be one already."""
    return labels if isinstance(labels, Column) else F.array(*[months.label_to_index(F.lit(m)) for m in labels])


def every_month(dates: DataFrame, column: str) -> Column:
    """All months from the first to the last date, as an array of month indexes from a scalar subquery."""
    index = months.month_index(F.col(column))
    return dates.agg(F.sequence(F.min(index), F.max(index)).alias("months")).scalar()


def _price() -> Column:
    return F.nanvl(F.col("deal_amount_krw").cast("double"), F.lit(None).cast("double"))


def _runs(m: Column) -> Column:
    return F.explode(F.array_distinct(F.array(_whole(m / RUN), _whole((m + (WINDOWS[-1] - 1)) / RUN))))


def _dated(contracts: DataFrame, asked: Column) -> DataFrame:
    """Contracts that some window can hold, with month, price and bucket."""
    rows = contracts.withColumns({"_m": months.month_index(F.col("deal_date")), "_price": _price(), "_asked": asked})
    rows = rows.where((F.col("_m") <= F.array_max("_asked")) & (F.col("_m") >= F.array_min("_asked") - (WINDOWS[-1] - 1)))
    bucket = F.when(F.col("_price").isNotNull(), value_bucket(F.col("_price")))
    return rows.select(CODE, AREA, "_m", "_price", bucket.alias("_bucket"), "deal_date")


def _bucket_counts(rows: DataFrame, sums: bool) -> DataFrame:
    """One row per complex, area, contract month and bucket, all rows of a key next to each other."""
    found = [F.count(F.lit(1)).alias("_rows"), F.min("_price").alias("_lo"), F.max("_price").alias("_hi"), F.max("deal_date").alias("_date")]
    counted = rows.groupBy(CODE, AREA, "_m", "_bucket").agg(*found, *([F.sum("_price").alias("_s")] if sums else []))
    return counted.repartition(CODE, AREA).sortWithinPartitions(CODE, AREA)


def _wanted(providers: Iterable[PriceProvider]) -> list[tuple[str, bool, Rank]]:
    """Name, whether a sum is wanted, and rank of every order statistic."""
    out = []
    for i, p in enumerate(providers):
        out += [(f"v{i}_{a}", False, r) for a, r in p.values.items()] + [(f"s{i}_{a}", True, r) for a, r in p.sums.items()]
    return out


_ASKS = pa.list_(pa.struct([("fact", pa.int32()), ("bucket", pa.int64()), ("j", pa.int64()), ("before", pa.float64())]))


def _whole_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole keys of sorted batches, of about ``UNFOLDED`` rows or one key."""
    held, size, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = _key_numbers(batch)
        changes = np.flatnonzero(np.diff(key)) + 1
        first = (batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
        cut = int(changes[-1]) if len(changes) else 0
        if held and size >= UNFOLDED and (cut or str(first) != str(last)):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
        last = (batch.column(0)[-1].as_py(), batch.column(1)[-1].as_py())
    if held:
        yield pa.Table.from_batches(held)


def _key_numbers(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """A number per distinct key of the first two columns; null equals null."""
    number = 0
    for i in (0, 1):
        column = rows.column(i)
        coded = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
        number = number * (len(coded.dictionary) + 1) + coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False).astype("int64")
    return number


def _located(counts: DataFrame, minimum: int, wanted: list[tuple[str, bool, Rank]]) -> DataFrame:
    """Per valuation month, complex and area: the chosen window, counts and date in it, and every order statistic or what it asks for."""
    date = counts.schema["_date"].dataType
    whole, real = T.LongType(), T.DoubleType()
    facts = [(x, name, total, rank) for x in ("w", "1") for name, total, rank in wanted]
    names = ["_vm", "_w", "_n", "_n1", "_kw", "_k1"]
    ask = T.ArrayType(T.StructType([T.StructField("fact", T.IntegerType()), T.StructField("bucket", whole), T.StructField("j", whole), T.StructField("before", real)]))
    schema = T.StructType([counts.schema[CODE], counts.schema[AREA], *[T.StructField(c, whole) for c in names], T.StructField("_d", date),
                           *[T.StructField(f"_{x}_{name}", real) for x, name, _, _ in facts], T.StructField("_asks", ask)])

    def unfold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_keys(batches):
            m = rows.column("_m").to_numpy()
            if rows.num_rows <= 2 * UNFOLDED:
                yield from _priced(rows, int(m.min()), int(m.max()) + WINDOWS[-1] - 1, minimum, facts)
                continue
            for run in range(int(m.min()) // RUN, (int(m.max()) + WINDOWS[-1] - 1) // RUN + 1):
                yield from _priced(rows, run * RUN, run * RUN + RUN - 1, minimum, facts)

    return counts.mapInArrow(unfold, schema)


def _priced(rows: pa.Table, first: int, last: int, minimum: int, facts: list[tuple[str, str, bool, Rank]]) -> Iterator[pa.RecordBatch]:
    """The valuation months from ``first`` to ``last`` of whole keys."""
    m = rows.column("_m").to_numpy().astype("int64")
    near = np.flatnonzero((m <= last) & (m + (WINDOWS[-1] - 1) >= first))
    if not len(near):
        return
    number = lambda c, kind, none: rows.column(c).combine_chunks().cast(kind).fill_null(none).to_numpy(zero_copy_only=False)
    bucket = number("_bucket", pa.int64(), np.iinfo("int64").min)
    age = np.repeat(np.arange(WINDOWS[-1]), len(near))
    at = np.tile(near, WINDOWS[-1])
    vm, key = m[at] + age, _key_numbers(rows)[at]
    inside = (vm >= first) & (vm <= last)
    at, age, vm, key = at[inside], age[inside], vm[inside], key[inside]
    order = np.lexsort((bucket[at], vm, key))
    at, age, vm, key = at[order], age[order], vm[order], key[order]
    bucket, counted = bucket[at], number("_rows", pa.int64(), 0)[at]
    new_group = np.r_[True, (key[1:] != key[:-1]) | (vm[1:] != vm[:-1])]
    new_bucket = new_group | np.r_[True, bucket[1:] != bucket[:-1]]
    starts, cells = np.flatnonzero(new_group), np.flatnonzero(new_bucket)
    group, cell = np.cumsum(new_group) - 1, np.cumsum(new_bucket) - 1
    inside = lambda n: np.add.reduceat(np.where(age < n, counted, 0), starts)
    n = {w: inside(w) for w in (1, *WINDOWS)}
    window = np.where(n[3] >= minimum, 3, np.where(n[6] >= minimum, 6, 12))
    taken = age < window[group]
    date = rows.schema.field("_date").type
    day = number("_date", pa.int32() if pa.types.is_date32(date) else pa.int64(), np.iinfo("int32").min).astype("int64")
    latest = np.maximum.reduceat(np.where(taken, day[at], np.iinfo("int64").min), starts)
    any_day = latest > np.iinfo("int64").min
    latest = pa.array(np.where(any_day, latest, 0), pa.int64(), mask=~any_day).cast(pa.int32() if pa.types.is_date32(date) else pa.int64()).cast(date)
    low, high = number("_lo", pa.float64(), np.nan)[at], number("_hi", pa.float64(), np.nan)[at]
    sums = number("_s", pa.float64(), 0.0)[at] if "_s" in rows.column_names else None
    known = bucket != np.iinfo("int64").min
    values, open_facts, prices = [], [], {}
    for x, within in (("w", taken & known), ("1", (age < 1) & known)):
        c = np.where(within, counted, 0)
        upto = np.cumsum(c)
        base, k = upto[starts] - c[starts], np.add.reduceat(c, starts)
        prices[x] = k
        of_cell = (np.minimum.reduceat(np.where(within, low, np.inf), cells), np.maximum.reduceat(np.where(within, high, -np.inf), cells), np.add.reduceat(c, cells))
        cell_base = upto[cells] - c[cells]
        for number_of, (y, _, total, rank) in enumerate(facts):
            if y != x:
                continue
            r = rank(k).astype("int64")
            there = np.searchsorted(upto, base + np.clip(r, 0, np.maximum(k - 1, 0)), side="right")
            some = (k > 0) & (r >= 0) & ((r <= k) if total else (r < k))
            e = cell[np.where(some, there, 0)]
            lo, hi, cc = (v[e] for v in of_cell)
            j = r - (cell_base[e] - base)
            if total:
                s = np.append(np.where(within, sums, 0.0), 0.0)
                whole = np.add.reduceat(s[:-1], cells)[e]
                spans = np.column_stack((starts, np.where(some, cells[e], starts))).ravel()
                before = np.where(spans[1::2] > spans[::2], np.add.reduceat(s, spans)[::2], 0.0)
                with np.errstate(invalid="ignore"):
                    part = np.select([j == 0, j == cc, lo == hi, j == 1, j == cc - 1], [0.0, whole, lo * j, lo, whole - hi], np.nan)
                    value, is_open = before + part, some & ~((j <= 1) | (j >= cc - 1) | (lo == hi))
            else:
                before = np.zeros(len(k))
                value = np.select([(j == 0) | (lo == hi), j == cc - 1], [lo, hi], np.nan)
                is_open = some & ~((j == 0) | (lo == hi) | (j == cc - 1))
            values.append((number_of, pa.array(value, pa.float64(), mask=~some | is_open)))
            g = np.flatnonzero(is_open)
            open_facts.append((g, np.full(len(g), number_of), bucket[cells[e[g]]], j[g], before[g]))
    g, *asked = (np.concatenate(v) for v in zip(*open_facts))
    by_group = np.argsort(g, kind="stable")
    ends = np.r_[0, np.cumsum(np.bincount(g, minlength=len(starts)))]
    asks = pa.StructArray.from_arrays([pa.array(v[by_group], f.type) for v, f in zip(asked, _ASKS.value_type)], fields=list(_ASKS.value_type))
    keys = rows.select([CODE, AREA]).take(pa.array(at[starts])).combine_chunks()
    columns = [keys.column(0), keys.column(1), *[pa.array(v, pa.int64()) for v in (vm[starts], window, np.choose(np.searchsorted(WINDOWS, window), [n[w] for w in WINDOWS]), n[1], prices["w"], prices["1"])],
               latest, *[v for _, v in sorted(values, key=lambda v: v[0])], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), asks)]
    names = [CODE, AREA, "_vm", "_w", "_n", "_n1", "_kw", "_k1", "_d", *[f"_{x}_{name}" for x, name, _, _ in facts], "_asks"]
    yield from pa.table(columns, names=names).to_batches(max_chunksize=20_000)


def _looked_up(open_rows: DataFrame, rows: DataFrame, facts: list[tuple[str, str, bool]]) -> DataFrame:
    """The open order statistics of ``open_rows``, from the prices of their buckets alone."""
    key = [CODE, AREA, "_run", "_vm"]
    asked = open_rows.select(CODE, AREA, _whole(F.col("_vm") / RUN).alias("_run"), "_vm", "_w", F.explode("_asks").alias("a"))
    told = lambda values: F.element_at(F.array(*values), F.col("a.fact") + 1)
    asked = asked.select(
        *key, told([F.lit(f"_{x}_{name}") for x, name, _ in facts]).alias("name"), told([F.lit(total) for _, _, total in facts]).alias("total"),
        F.col("a.bucket").alias("_bucket"), F.col("a.j").alias("j"), told([F.col("_w") if x == "w" else F.lit(1).cast("long") for x, _, _ in facts]).alias("back"), F.col("a.before").alias("sb"),
    )
    # Stored, so that its size is known: contracts of other buckets leave before they are dealt.
    asked = materialise(asked, "open-ranks")
    place = [CODE, AREA, "_run", "_bucket"]
    own = join_keys(rows.withColumn("_run", _runs(F.col("_m"))), asked.select(*place).distinct(), place, "left_semi")
    prices = own.groupBy(*place, "_m", "_price").agg(F.count(F.lit(1)).alias("n"))
    met = join_keys(asked, prices, place, "inner").where((F.col("_m") <= F.col("_vm")) & (F.col("_m") > F.col("_vm") - F.col("back")))
    each = [*key, "name", "total", "j", "sb"]
    met = met.groupBy(*each, "_price").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*key, "name").orderBy("_price").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("upto", F.sum("n").over(upto))
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.col("j") - F.col("upto") + F.col("n")))
    here = (F.col("j") >= F.col("upto") - F.col("n")) & (F.col("j") < F.col("upto"))
    found = met.groupBy(*each).agg(F.max(F.when(here, F.col("_price"))).alias("v"), F.sum(F.col("_price") * taken).alias("s"))
    value = F.when(F.col("total"), F.col("sb") + F.col("s")).otherwise(F.col("v"))
    picks = [F.max(F.when(F.col("name") == f"_{x}_{name}", value)).alias(f"_{x}_{name}_found") for x, name, _ in facts]
    return found.groupBy(CODE, AREA, "_vm").agg(*picks)


def window_prices(contracts: DataFrame, labels: Iterable[str] | Column, minimum: int = 3, providers: Iterable[PriceProvider] = (MEDIAN,)) -> DataFrame:
    """One row per valuation month, complex, area and provider with contracts in the last twelve months.

    The window is the first of 3, 6 and 12 months with ``minimum`` contracts, else the twelve-month small sample; next to its price
    stands that of the valuation month alone. ``labels`` are valuation months, or an array of month indexes. Contracts without a
    price (null, NaN) count as contracts only; contracts without a date lie in no window; those without a complex or area form
    groups of their own. Repeated contracts count again.
    """
    providers = list(providers)
    return _told(price_facts(contracts, labels, minimum, providers), providers, minimum)


def price_facts(contracts: DataFrame, labels: Iterable[str] | Column, minimum: int = 3, providers: Iterable[PriceProvider] = (MEDIAN,)) -> DataFrame:
    """The numbers behind ``window_prices``, one narrow row per valuation month, complex and area; ``told_facts`` names them."""
    providers = list(providers)
    asked, wanted = month_indexes(labels), _wanted(providers)
    rows = _dated(contracts, asked)
    facts = [(x, name, total) for x in ("w", "1") for name, total, _ in wanted]
    located = _located(_bucket_counts(rows, any(total for _, total, _ in wanted)), minimum, wanted)
    located = located.withColumn("_asked", asked).where(F.array_contains("_asked", F.col("_vm"))).drop("_asked")
    # Settled rows keep their prices alone, open rows what the prices are made of.
    is_open, prices = F.size("_asks") > 0, [f"_p{x}{i}" for i in range(len(providers)) for x in ("w", "1")]
    parts = ["_kw", "_k1", *[f"_{x}_{name}" for x, name, _ in facts]]
    located = located.withColumns({f"_p{x}{i}": F.when(~is_open, _price_of(i, p, x)) for i, p in enumerate(providers) for x in ("w", "1")})
    located = located.withColumns({c: F.when(is_open, F.col(c)) for c in (*parts, "_asks")})
    located = materialise(located, "window-prices")
    done, still = located.where(F.col("_asks").isNull()), located.where(F.col("_asks").isNotNull())
    found = join_keys(still, _looked_up(still, rows, facts), [CODE, AREA, "_vm"], "inner")
    found = found.withColumns({f"_{x}_{name}": F.coalesce(f"_{x}_{name}", f"_{x}_{name}_found") for x, name, _ in facts})
    found = found.withColumns({f"_p{x}{i}": _price_of(i, p, x) for i, p in enumerate(providers) for x in ("w", "1")})
    kept = [CODE, AREA, "_vm", "_w", "_n", "_n1", "_d", *prices]
    return done.select(*kept).unionByName(found.select(*kept))


def _price_of(i: int, p: PriceProvider, x: str) -> Column:
    """The price of a provider from its order statistics; null without a known price."""
    k = F.col(f"_k{x}")
    at = {a: F.col(f"_{x}_{'v' if a in p.values else 's'}{i}_{a}") for a in (*p.values, *p.sums)}
    return F.when(k > 0, p.price(at, k))


def told_facts(provider: PriceProvider, minimum: int, i: int = 0) -> dict[str, Column]:
    """What ``window_prices`` tells of the facts of one provider, by name; null where there are none."""
    window, small = F.col("_w").cast("int"), F.col("_n") < minimum
    method = F.when(small, "small_sample").otherwise(F.concat(F.lit(f"{provider.method}_"), window, F.lit("m")))
    told = {
        "price_source": F.lit(provider.source), "price_krw": F.col(f"_pw{i}"), "window_months": window, "transaction_count": F.col("_n"),
        "latest_deal_date": F.col("_d"), "small_sample": small, "price_1m_krw": F.col(f"_p1{i}"), "count_1m": F.col("_n1"),
        "small_sample_1m": F.col("_n1") < minimum, "period_start": months.index_month_start(F.col("_vm") - (window - 1)),
        "period_end": months.index_month_end(F.col("_vm")), "old_transactions": window > 3, "method": method,
    }
    return {name: F.when(F.col("_w").isNotNull(), c) for name, c in told.items()}


def _told(stats: DataFrame, providers: list[PriceProvider], minimum: int) -> DataFrame:
    each = [told_facts(p, minimum, i) for i, p in enumerate(providers)]
    month, own = months.index_to_label(F.col("_vm")).alias("month"), ("price_source", "price_krw", "price_1m_krw", "method")
    if len(each) == 1:
        return stats.select(CODE, AREA, month, *[c.alias(name) for name, c in each[0].items()])
    rows = stats.withColumn("_p", F.explode(F.array(*[F.struct(*[told[name].alias(name) for name in own]) for told in each])))
    return rows.select(CODE, AREA, month, *[(F.col(f"_p.{name}") if name in own else c).alias(name) for name, c in each[0].items()])
