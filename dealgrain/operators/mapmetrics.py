"""Map metrics: combined values, weighted prices and scaled markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bands, numeric
from .scale import Quantile, group_quantiles, pick_row

COMPLEX = "internal_complex_id"
# Marker size range, winsorising shares and the smallest sample for them.
MARKER_RANGE = (5.0, 26.0)
CUT_SHARES = (0.02, 0.98)
CUT_MINIMUM = 10
LEGEND_SHARES = {"q25": 0.25, "q50": 0.50, "q75": 0.75}


def liquidity(contracts: DataFrame) -> DataFrame:
    """Contracts and amount per complex in the twelve months up to the latest contract date."""
    live = contracts
    if "is_cancelled" in contracts.columns:
        live = live.where(~F.coalesce(F.col("is_cancelled"), F.lit(False)))
    live = live.where(F.col(COMPLEX).isNotNull() & F.col("deal_date").isNotNull() & (F.col("deal_amount_krw") >= 0))
    latest = live.agg(F.max("deal_date").alias("d")).scalar()
    recent = live.withColumn("latest_trade_date", latest).where(F.col("deal_date") > F.add_months("latest_trade_date", -12))
    return recent.groupBy(F.col(COMPLEX).cast("string").alias(COMPLEX)).agg(
        F.count(F.lit(1)).alias("transaction_count_12m"), F.sum("deal_amount_krw").alias("transaction_value_12m")
    )


def overview_metrics(ids: DataFrame, contracts: DataFrame | None, caps: DataFrame | None, school_gaps: DataFrame | None = None) -> DataFrame:
    """Market value, recent liquidity and school gap per complex.

    A missing source leaves nulls; a present source without rows for a complex gives zero
    contracts.
    """
    out = ids.select(F.col(COMPLEX).cast("string").alias(COMPLEX)).distinct()
    if caps is not None:
        best = F.col("market_cap_krw").cast("double")
        if "adjusted_market_cap_krw" in caps.columns:
            best = F.coalesce(F.col("adjusted_market_cap_krw").cast("double"), best)
        one = caps.select(F.col("kapt_code").cast("string").alias(COMPLEX), best.alias("market_cap_krw"))
        out = out.join(pick_row(one, [COMPLEX], [F.col("market_cap_krw").isNull(), F.col("market_cap_krw")]), COMPLEX, "left")
    else:
        out = out.withColumn("market_cap_krw", F.lit(None).cast("double"))
    if contracts is not None:
        out = out.join(liquidity(contracts), COMPLEX, "left").na.fill({"transaction_count_12m": 0, "transaction_value_12m": 0.0})
    else:
        out = out.withColumns({"transaction_count_12m": F.lit(None).cast("long"), "transaction_value_12m": F.lit(None).cast("double")})
    if school_gaps is not None:
        gap = school_gaps.select(F.col("apartment_id").cast("string").alias(COMPLEX), F.col("school_value_gap_pct").try_cast("double").alias("school_value_gap_pct"))
        return out.join(pick_row(gap, [COMPLEX], [F.col("school_value_gap_pct")]), COMPLEX, "left")
    return out.withColumn("school_value_gap_pct", F.lit(None).cast("double"))


def weighted_prices(complexes: DataFrame, panel: DataFrame) -> DataFrame:
    """Mean price per complex weighted by contracts; zero contracts where none are known."""
    n, price = F.coalesce(F.col("transaction_count").try_cast("double"), F.lit(0.0)), F.col("mean_price").try_cast("double")
    rows = panel.select(COMPLEX, n.alias("_n"), price.alias("_p")).where(F.col("_p").isNotNull() & (F.col("_n") > 0))
    sums = rows.groupBy(COMPLEX).agg(F.sum(F.col("_p") * F.col("_n")).alias("_v"), F.sum("_n").alias("map_transaction_count"))
    sums = sums.select(COMPLEX, (F.col("_v") / F.col("map_transaction_count")).alias("map_average_price_krw"), "map_transaction_count")
    out = complexes.drop("map_average_price_krw", "map_transaction_count").join(sums, COMPLEX, "left")
    return out.withColumn("map_transaction_count", F.coalesce("map_transaction_count", F.lit(0.0)))


def with_price_band(df: DataFrame, price: str = "map_average_price_krw") -> DataFrame:
    return df.withColumn("price_band", bands.price_band(F.col(price) / numeric.EOK))


def _usable(value: Column) -> Column:
    v = value.try_cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(finite, v)


def legend_values(df: DataFrame, value: str) -> DataFrame:
    """Exact quartiles of the non-negative values."""
    v = _usable(F.col(value))
    v = F.when(v >= 0, v)
    return group_quantiles(df, [], {n: Quantile(v, s) for n, s in LEGEND_SHARES.items()}, {"value_count": F.count(v)})


def scale_markers(
    df: DataFrame, value: str, alias: str = "marker_size", method: str = "sqrt", reference: DataFrame | None = None
) -> DataFrame:
    """Marker size between 5 and 26 from a root or log scale of winsorised values.

    Missing and negative values get the smallest marker. The scale comes from ``reference``
    (the table itself by default) as one aggregated row.
    """
    if method not in ("sqrt", "log1p"):
        raise ValueError("method must be 'sqrt' or 'log1p'")
    low_size, high_size = MARKER_RANGE
    transform = F.sqrt if method == "sqrt" else F.log1p
    source = df if reference is None else reference
    known = _usable(F.col(value))
    known = F.when(known >= 0, known)
    limits = group_quantiles(
        source, [],
        {"_cut_low": Quantile(known, CUT_SHARES[0]), "_cut_high": Quantile(known, CUT_SHARES[1])},
        {"_min": F.min(known), "_max": F.max(known), "_n": F.count(known)},
    )
    cut = (F.col("_n") >= CUT_MINIMUM) & (F.col("_min") < F.col("_max"))
    bounds = limits.select(
        F.struct(
            F.when(cut, F.col("_cut_low")).otherwise(F.col("_min")).alias("low"),
            F.when(cut, F.col("_cut_high")).otherwise(F.col("_max")).alias("high"),
        ).alias("b")
    ).scalar()
    out = df.withColumn("_v", known).withColumn("_b", bounds)
    low, high = transform(F.col("_b.low")), transform(F.col("_b.high"))
    clipped = transform(F.greatest(F.least(F.col("_v"), F.col("_b.high")), F.col("_b.low")))
    flat = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(high), F.abs(low))
    size = F.when(F.col("_v").isNull() | F.col("_b.low").isNull() | flat, F.lit(low_size)).otherwise(
        low_size + (high_size - low_size) * (clipped - low) / (high - low)
    )
    return out.withColumn(alias, F.greatest(F.least(size, F.lit(high_size)), F.lit(low_size))).drop("_v", "_b")


def centred_ratio(df: DataFrame, value: str, alias: str = "gap_ratio") -> DataFrame:
    """Signed share of a symmetric limit: the 98 % quantile of sizes, or the largest size of few values."""
    known = _usable(F.col(value))
    limits = group_quantiles(df, [], {"_cut": Quantile(F.abs(known), CUT_SHARES[1])}, {"_n": F.count(known), "_max": F.max(F.abs(known))})
    limit = limits.select(
        F.greatest(F.when(F.col("_n") >= CUT_MINIMUM, F.col("_cut")).otherwise(F.col("_max")), F.lit(1e-12)).alias("v")
    ).scalar()
    out = df.withColumn("_v", known).withColumn("_limit", limit)
    clipped = F.greatest(F.least(F.col("_v"), F.col("_limit")), -F.col("_limit"))
    return out.withColumn(alias, clipped / F.col("_limit")).drop("_v", "_limit")
