"""Gap-filled monthly panels and their rolling indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import months, numeric
from ..session import materialise
from .scale import Quantile, group_quantiles, join_keys, pick_row, sorted_quantile

SERIES = ["internal_complex_id", "area_group"]
KEYS = ["internal_complex_id", "year_month", "area_group"]
ATTRIBUTES = [
    "sigungu", "dong", "jibun", "complex_name", "sido", "region_code", "region_key", "region_name",
    "region_level_1", "region_level_2", "market_area", "is_busan", "is_satellite",
]
META = [
    "kapt_code", "households", "parking_per_household", "apartment_age", "approval_date", "parking_total",
    "road_address", "latitude", "longitude", "buildings",
]
VALUES = ["transaction_count", "median_price", "mean_price", "median_price_per_sqm", "median_price_per_3_3sqm"]
WINDOWS = (3, 6, 12)


def first_known_value(name: str, order: str | None) -> Column:
    """First non-null value in source order; the smallest value when no order column exists."""
    if order is None:
        return F.min(name)
    return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), F.col(order)))


def monthly_sales(
    contracts: DataFrame, attributes: list[str] = ATTRIBUTES, source_order: str | None = None, stored: bool = True
) -> DataFrame:
    """Counts, exact medians, mean and attributes per complex, month and area group.

    Contracts without a month are left out; a null area group forms its own group. The price per 3.3 square metres is 3.3 times
    the one per square metre, and so is its median.
    """
    owner = F.coalesce(F.col("internal_complex_id"), F.col("kapt_code")) if "kapt_code" in contracts.columns else F.col("internal_complex_id")
    rows = contracts.where(F.col("year_month").isNotNull()).withColumn("internal_complex_id", owner)
    others = {
        "transaction_count": F.count(F.lit(1)),
        "mean_price": F.avg("deal_amount_krw"),
        **{a: first_known_value(a, source_order) for a in attributes if a in rows.columns},
        "provisional": F.max("provisional"),
    }
    medians = {
        "median_price": Quantile(F.col("deal_amount_krw")),
        "median_price_per_sqm": Quantile(F.col("price_per_sqm")),
    }
    found = group_quantiles(rows, KEYS, medians, others, stored)
    return found.withColumn("median_price_per_3_3sqm", F.col("median_price_per_sqm") * numeric.PYEONG_SQM)


def attach_master(panel: DataFrame, master: DataFrame, columns: list[str] = META) -> DataFrame:
    """Add register columns by complex id; missing ones become null.

    The picked rows are stored, so that Spark knows their size: the panel is dealt by complex only if they are too many to be sent to
    every task.
    """
    have = [c for c in columns if c in master.columns]
    one = pick_row(master.select(*have), ["kapt_code"], [F.struct(*[F.col(c) for c in have])])
    one = materialise(one, "register-rows").withColumn("_id", F.col("kapt_code"))
    out = panel.drop(*[c for c in have if c in panel.columns]).join(one, F.col("internal_complex_id") == F.col("_id"), "left")
    return out.drop("_id")


def fill_calendar(panel: DataFrame, series: list[str] = SERIES, carried: list[str] = (), repeated: list[str] = (), since: Column | None = None) -> DataFrame:
    """Every series gets one row per month from its own first month to the last month of the data.

    A month repeats up to the one before the next known month, its values only in the first row: one
    window over a series, whose partitioning the indicators use again. ``panel`` has a row per series and month.
    Attributes to be ``carried`` are filled among the known months, as ``fill_attributes`` does, and repeat with them; columns
    that are ``repeated`` do so as they are. With ``since`` only rows from that month index on are made.
    """
    rows = panel.withColumn("_midx", months.label_to_index(F.col("year_month"))).where(F.col("_midx").isNotNull())
    last = rows.agg(F.max("_midx").alias("m")).scalar()
    if carried:
        rows = fill_attributes(rows, carried, series)
    following = F.lead("_midx").over(Window.partitionBy(*series).orderBy("_midx"))
    until = F.greatest(F.coalesce(following - 1, last), F.col("_midx"))
    spread = rows.withColumn("_until", until).withColumn("_from", F.col("_midx"))
    if since is not None:
        spread = spread.withColumn("_from", F.greatest("_from", since)).where("_from <= _until")
    spread = spread.withColumn("_at", F.explode(F.sequence("_from", "_until")))
    known = F.col("_at") == F.col("_midx")
    values = [c for c in rows.columns if c not in {*series, "_midx", "year_month"}]
    filled = spread.select(*series, F.col("_at").alias("_midx"), *[F.col(c) if c in {*carried, *repeated} else F.when(known, F.col(c)).alias(c) for c in values])
    return filled.withColumn("year_month", months.index_to_label(F.col("_midx")))


def fill_attributes(df: DataFrame, columns: list[str], series: list[str] = SERIES) -> DataFrame:
    """Carry attributes forward, then backward, along the months of a series.

    Where nothing is known before a row, the next known value is the first one of the series,
    so the backward step uses the whole series once instead of a frame per row.
    """
    w = Window.partitionBy(*series).orderBy("_midx")
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(whole)) for c in columns}
    )


def with_rolling_medians(df: DataFrame, medians: dict[str, tuple[str, int]], w) -> DataFrame:
    """Exact medians of a column over its last so many months, by name, nulls skipped.

    A frame is a sorted list of at most so many values in a column of its own, so that it is made once.
    """
    lists = {f"_frame_{a}": F.sort_array(F.collect_list(F.col(c).cast("double")).over(w.rowsBetween(-(rows - 1), 0))) for a, (c, rows) in medians.items()}
    found = df.withColumns(lists).withColumns({a: sorted_quantile(F.col(f"_frame_{a}"), 0.5) for a in medians})
    return found.drop(*lists)


def _path_and_peaks(so_far) -> tuple[dict[str, Column], dict[str, Column]]:
    """The last known price, and its highest and lowest value up to a month."""
    peaks = {f"rolling_{a}": F.when(F.col("_path").isNotNull(), f("_path").over(so_far)) for a, f in (("peak", F.max), ("trough", F.min))}
    return {"_path": F.last("median_price", ignorenulls=True).over(so_far)}, peaks


def add_indicators(
    filled: DataFrame,
    provisional_months: DataFrame | None = None,
    low_sample: int = 3,
    series: list[str] = SERIES,
    since: Column | None = None,
) -> DataFrame:
    """Rolling counts, prices, returns, turnover, peaks and troughs of a gap-filled panel.

    All windows share one partitioning and order, so Spark shuffles and sorts once. A
    partition is one series, bounded by the number of months in the calendar. With ``since`` only rows from that
    month index on are returned. A panel that starts later than its data brings ``_path`` and its peaks and troughs along.
    """
    w = Window.partitionBy(*series).orderBy("_midx")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = filled
    if "households" not in out.columns:
        out = out.withColumn("households", F.lit(None).cast("double"))
    out = out.withColumn("transaction_count", F.coalesce(F.col("transaction_count").cast("double"), F.lit(0.0)))
    path, peaks = ({}, {}) if "_path" in out.columns else _path_and_peaks(so_far)
    step = {}
    for n in WINDOWS:
        step[f"transactions_{n}m"] = F.sum("transaction_count").over(w.rowsBetween(-(n - 1), 0))
    step |= path
    medians = {f"price_{n}m": ("median_price", n) for n in WINDOWS}
    medians |= {"price_per_sqm_3m": ("median_price_per_sqm", 3), "price_per_3_3sqm_3m": ("median_price_per_3_3sqm", 3)}
    out = with_rolling_medians(out.withColumns(step), medians, w)
    step = {f"return_{n}m": numeric.ratio(F.col(f"price_{n}m"), F.lag(f"price_{n}m", n).over(w)) - 1 for n in WINDOWS}
    step["transaction_yoy"] = numeric.ratio(F.col("transactions_12m"), F.lag("transactions_12m", 12).over(w)) - 1
    out = out.withColumns(step | peaks)
    if since is not None:
        out = out.where(F.col("_midx") >= since)
    out = out.withColumns(
        {
            "turnover_12m": numeric.ratio(F.col("transactions_12m"), F.col("households")),
            "drawdown_from_peak": numeric.ratio(F.col("_path"), F.col("rolling_peak")) - 1,
            "recovery_from_trough": numeric.ratio(F.col("_path"), F.col("rolling_trough")) - 1,
            "sample_count": F.col("transactions_6m"),
            "low_sample_flag": F.col("transactions_6m") < low_sample,
        }
    )
    if provisional_months is not None:
        # At most one entry per month: a list beside the plan, where a join would first deal the whole panel by month.
        marked = provisional_months.agg(F.collect_set("_midx")).scalar()
        out = out.withColumn("provisional", F.coalesce(F.array_contains(marked, F.col("_midx")), F.lit(False)))
    return out.drop("_path")


def add_relative_turnover(panel: DataFrame) -> DataFrame:
    """Turnover relative to the median of the district in that month.

    The medians are stored, so that Spark knows that they are few: else the panel would be dealt by district and month.
    """
    medians = materialise(group_quantiles(panel, ["sigungu", "year_month"], {"_district": Quantile(F.col("turnover_12m"))}), "district-turnover")
    out = join_keys(panel, medians, ["sigungu", "year_month"])
    return out.withColumn("district_relative_turnover", numeric.ratio(F.col("turnover_12m"), F.col("_district"))).drop("_district")


def sale_panel(contracts: DataFrame, master: DataFrame | None = None, low_sample: int = 3, source_order: str | None = None) -> DataFrame:
    """The monthly sale panel without the district comparison.

    The monthly aggregate, far smaller than the contracts, is stored once because the spine,
    the latest month and the filled rows all read it. Register columns join it where it is read,
    so they are not written for every month.
    """
    monthly = materialise(monthly_sales(contracts, source_order=source_order), "monthly-sales")
    if master is not None:
        monthly = attach_master(monthly, master)
    return panel_of(monthly, low_sample)


def panel_of(monthly: DataFrame, low_sample: int = 3, recent: int | None = None) -> DataFrame:
    """The gap-filled panel with indicators of stored monthly aggregates.

    With ``recent`` it holds the last so many months alone, as they are in the whole panel: peaks and troughs of the known months
    are worked out before months are filled in, and months are filled in as far back as frames and what they are compared with reach.
    """
    indexed = monthly.withColumn("_midx", months.label_to_index(F.col("year_month")))
    carried = [c for c in monthly.columns if c not in {*SERIES, *VALUES, "provisional", "year_month"}]
    if recent is None:
        return add_indicators(fill_calendar(monthly, carried=carried), indexed.where("provisional"), low_sample).drop("_midx")
    since = indexed.agg((F.max("_midx") - (recent - 1)).alias("m")).scalar()
    path, peaks = _path_and_peaks(Window.partitionBy(*SERIES).orderBy("_midx").rowsBetween(Window.unboundedPreceding, 0))
    known = indexed.where(F.col("_midx").isNotNull()).withColumns(path).withColumns(peaks).drop("_midx")
    filled = fill_calendar(known, carried=carried, repeated=[*path, *peaks], since=since - (2 * max(WINDOWS) - 1))
    out = add_indicators(filled, indexed.where("provisional"), low_sample, since=since)
    return out.drop("_midx")


def latest_per_series(panel: DataFrame, series: list[str] = SERIES) -> DataFrame:
    """The row of the latest month of every series.

    The panel is already partitioned by series, so this needs no further shuffle.
    """
    rest = [c for c in panel.columns if c not in series]
    row = F.max_by(F.struct(*rest), "year_month").alias("_row")
    return panel.groupBy(*series).agg(row).select(*series, *[F.col(f"_row.{c}").alias(c) for c in rest])


def latest_per_area(panel: DataFrame, complex_id: str) -> DataFrame:
    """The last row of every area group of one complex."""
    return latest_per_series(panel.where(F.col("internal_complex_id") == complex_id))


def monthly_volume(panel: DataFrame, complex_id: str | None = None) -> DataFrame:
    """Contracts per month, of one complex or of every complex."""
    if complex_id is None:
        return panel.groupBy("internal_complex_id", "year_month").agg(F.sum("transaction_count").alias("transaction_count"))
    one = panel.where(F.col("internal_complex_id") == complex_id)
    return one.groupBy("year_month").agg(F.sum("transaction_count").alias("transaction_count"))


def price_series(panel: DataFrame, group: str, ids: list[str] = (), unit: float = 1.0) -> DataFrame:
    """Monthly median price of one area group, optionally of some complexes."""
    rows = panel.where(F.col("area_group") == group)
    if ids:
        rows = rows.where(F.col("internal_complex_id").isin(list(ids)))
    return rows.select("internal_complex_id", "year_month", (F.col("median_price") / unit).alias("median_price"))


def dong_price_grid(complexes: DataFrame) -> DataFrame:
    """Median reference price of every district and dong, one row per cell of the grid."""
    return group_quantiles(complexes, ["sigungu", "dong"], {"price": Quantile(F.col("price_84"))})


def fill_coordinates(df: DataFrame, cache: DataFrame, key: str = "kapt_code", order: str = "cached_at") -> DataFrame:
    """Fill missing coordinates from the last complete cached pair; known ones stay."""
    complete = cache.where(F.col(key).isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    last = pick_row(complete.select(key, order, "latitude", "longitude"), [key], [F.col(order)], last=True)
    last = last.select(key, F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    for c in ("latitude", "longitude"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    out = df.join(last, key, "left")
    out = out.withColumns({"latitude": F.coalesce("latitude", "_lat"), "longitude": F.coalesce("longitude", "_lon")})
    return out.drop("_lat", "_lon")


def newly_located(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Number of rows that had no complete coordinates before and have them after a fill."""
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    old = before.select(*key, located.alias("_before"))
    joined = join_keys(after.withColumn("_after", located), old, key, "inner")
    return joined.agg(F.count_if(F.col("_after") & ~F.col("_before")).alias("newly_located"))
