"""Rankings and searches over the latest months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bands, months, numeric
from .panel import first_known_value
from .scale import Quantile, group_quantiles, pick_row, with_row_number

COMPLEX = "internal_complex_id"


def top_rows(df: DataFrame, order: list[Column], top_n: int, alias: str = "rank") -> DataFrame:
    """The first rows of a total order with their number.

    The limit is planned as a distributed top-k, so only ``top_n`` rows reach the numbering.
    """
    if top_n < 1:
        raise ValueError("top_n must be at least 1")
    best = df.orderBy(*order).limit(top_n)
    return best.withColumn(alias, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def in_district(df: DataFrame, sigungu: str | None = None, dong: str | None = None) -> DataFrame:
    for column, value in (("sigungu", sigungu), ("dong", dong)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def household_lookup(master: DataFrame, column: str = "households") -> DataFrame:
    """The largest positive number of households per complex."""
    n = F.col(column).try_cast("double")
    return master.groupBy(COMPLEX).agg(F.max(F.when(n > 0, n)).alias("household_count"))


def volume_ranking(
    panel: DataFrame,
    window: int | str,
    master: DataFrame,
    sigungu: str | None = None,
    dong: str | None = None,
    top_n: int = 20,
    source_order: str | None = None,
) -> DataFrame:
    """Most traded complexes of the window with contracts per hundred households."""
    rows = in_district(months.in_month_window(panel, "year_month", window), sigungu, dong)
    count = F.coalesce(F.col("transaction_count").try_cast("double"), F.lit(0.0))
    totals = rows.groupBy(COMPLEX).agg(
        *[first_known_value(c, source_order).alias(c) for c in ("complex_name", "sigungu", "dong")],
        F.sum(count).alias("transaction_count"),
        F.max("window_start").alias("window_start"),
        F.max("window_end").alias("window_end"),
    )
    totals = totals.where("transaction_count > 0")
    totals = totals.withColumn("transaction_count", F.bround("transaction_count").cast("long"))
    order = [F.desc("transaction_count"), F.asc_nulls_last("complex_name"), F.asc(COMPLEX)]
    best = top_rows(totals, order, top_n)
    out = best.join(household_lookup(master), COMPLEX, "left")
    return out.withColumn("transaction_rate", numeric.ratio(F.col("transaction_count"), F.col("household_count")) * 100)


def region_volume(panel: DataFrame, window: int | str, by: str, sigungu: str | None = None) -> DataFrame:
    """Contracts of the window per district or dong; rows without one are left out."""
    rows = in_district(months.in_month_window(panel, "year_month", window), sigungu)
    count = F.coalesce(F.col("transaction_count").try_cast("double"), F.lit(0.0))
    totals = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.bround(F.sum(count)).cast("long").alias("transaction_count"))
    return totals.orderBy(F.desc("transaction_count"), by)


def _live(contracts: DataFrame) -> DataFrame:
    if "is_cancelled" not in contracts.columns:
        return contracts
    return contracts.where(~F.coalesce(F.col("is_cancelled"), F.lit(False)))


def unit_price_ranking(
    contracts: DataFrame, complexes: DataFrame, window: int = 3, sigungu: str | None = None, top_n: int = 20
) -> DataFrame:
    """Complexes by median price per pyeong of the window."""
    rows = _live(months.in_month_window(contracts, "year_month", window))
    price = F.col("price_per_3_3sqm").try_cast("double")
    rows = rows.withColumn("price_per_3_3sqm", price).where(F.col(COMPLEX).isNotNull() & (F.col("price_per_3_3sqm") > 0))
    others = {"transaction_count": F.count(F.lit(1)), "latest_deal_date": F.max("deal_date")}
    prices = group_quantiles(rows, [COMPLEX], {"price_per_3_3sqm": Quantile(F.col("price_per_3_3sqm"))}, others)
    named = pick_row(complexes.select(COMPLEX, "complex_name", "sigungu", "dong"), [COMPLEX], [F.col("complex_name")])
    out = in_district(prices.join(named, COMPLEX), sigungu)
    order = [F.desc("price_per_3_3sqm"), F.desc("transaction_count"), F.asc_nulls_last("complex_name"), F.asc(COMPLEX)]
    return top_rows(out, order, top_n)


def _one_each(complexes: DataFrame) -> DataFrame:
    rest = [F.col(c) for c in complexes.columns if c != COMPLEX]
    return pick_row(complexes, [COMPLEX], rest)


def household_ranking(complexes: DataFrame, sigungu: str | None = None, top_n: int = 20) -> DataFrame:
    """The largest complexes by households."""
    columns = [COMPLEX, "complex_name", "sigungu", "dong", "households", "approval_date"]
    rows = complexes.select(*[c for c in columns if c in complexes.columns])
    rows = in_district(_one_each(rows).where(F.col("households").try_cast("double") > 0), sigungu)
    return top_rows(rows, [F.desc("households"), F.asc_nulls_last("complex_name"), F.asc(COMPLEX)], top_n)


def oldest_ranking(complexes: DataFrame, as_of: str, sigungu: str | None = None, top_n: int = 20) -> DataFrame:
    """The oldest complexes with their age on the as-of date."""
    rows = complexes.select(COMPLEX, "complex_name", "sigungu", "dong", "approval_date")
    rows = in_district(_one_each(rows).where(F.col("approval_date").isNotNull()), sigungu)
    rows = rows.withColumn("apartment_age", numeric.age_anniversary(F.col("approval_date"), F.lit(as_of).cast("date")))
    return top_rows(rows, [F.asc("approval_date"), F.asc_nulls_last("complex_name"), F.asc(COMPLEX)], top_n)


def recent_prices(contracts: DataFrame, complexes: DataFrame, window: int = 1, source_order: str | None = None) -> DataFrame:
    """Median, lowest and highest price and number of contracts per complex in the window.

    Register names win over contract names.
    """
    rows = _live(months.in_month_window(contracts, "year_month", window))
    rows = rows.withColumn("deal_amount_krw", F.col("deal_amount_krw").try_cast("double"))
    rows = rows.where((F.col("deal_amount_krw") > 0) & F.col(COMPLEX).isNotNull())
    others = {
        **{f"_t_{c}": first_known_value(c, source_order) for c in ("complex_name", "sigungu", "dong")},
        "transaction_count": F.count(F.lit(1)),
        "min_price": F.min("deal_amount_krw"),
        "max_price": F.max("deal_amount_krw"),
        "window_start": F.max("window_start"),
        "window_end": F.max("window_end"),
        "provisional": F.max(F.coalesce(F.col("provisional"), F.lit(False)) if "provisional" in rows.columns else F.lit(False)),
    }
    prices = group_quantiles(rows, [COMPLEX], {"median_price": Quantile(F.col("deal_amount_krw"))}, others)
    wanted = ["complex_name", "sigungu", "dong", "households", "parking_per_household", "apartment_age", "road_address"]
    have = [c for c in wanted if c in complexes.columns]
    one = pick_row(complexes.select(COMPLEX, *have), [COMPLEX], [F.struct(*[F.col(c) for c in have])])
    out = prices.join(one, COMPLEX, "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_t_{c}")) for c in ("complex_name", "sigungu", "dong")})
    return out.drop("_t_complex_name", "_t_sigungu", "_t_dong")


def search_recent_prices(
    prices: DataFrame, price: tuple, households: tuple, parking: tuple, age: tuple, number: bool = True
) -> DataFrame:
    """Complexes within four inclusive ranges, numbered by price, contracts and name."""
    ranges = {"median_price": price, "households": households, "parking_per_household": parking, "apartment_age": age}
    if any(low > high for low, high in ranges.values()):
        raise ValueError("a range must not be reversed")
    rows = prices.where(numeric.all_of([bands.between_or_false(F.col(c), *r) for c, r in ranges.items()]))
    if not number:
        return rows
    order = [F.asc("median_price"), F.desc("transaction_count"), F.asc_nulls_last("complex_name"), F.asc(COMPLEX)]
    return with_row_number(rows, order, "row_no")


def recent_contracts(
    contracts: DataFrame,
    complex_id: str,
    first_month: str,
    last_month: str,
    group: str | None = None,
    limit: int = 50,
    tie: str = "source_row_id",
) -> DataFrame:
    """The newest contracts of one complex within a month range, amounts in 만원."""
    rows = _live(contracts.where((F.col(COMPLEX) == complex_id) & F.col("year_month").between(first_month, last_month)))
    if group is not None:
        rows = rows.where(F.col("area_group") == group)
    rows = rows.orderBy(F.desc("deal_date"), F.asc(tie)).limit(limit)
    return rows.withColumn("deal_amount_manwon", F.col("deal_amount_krw") / numeric.MANWON)


def named_like(df: DataFrame, part: str, column: str = "complex_name") -> DataFrame:
    """Rows whose name holds a literal piece of text."""
    return df.where(F.col(column).contains(part))


def median_rate(ranked: DataFrame) -> DataFrame:
    """Median transaction rate of the ranked rows, and how many have no known households."""
    others = {
        "rows_with_rate": F.count("transaction_rate"),
        "rows_without_households": F.count_if(F.col("transaction_rate").isNull()),
    }
    return group_quantiles(ranked, [], {"median_rate": Quantile(F.col("transaction_rate"))}, others)
