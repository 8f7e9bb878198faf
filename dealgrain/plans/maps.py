"""Registered queries: map metrics, weighted prices, legends and marker scales."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands
from ..operators import mapmetrics, panel, scale
from . import adapters as a
from .registry import query
from .shape import settle

ID = "internal_complex_id"
_LIQUID = """liquid AS (SELECT internal_complex_id, count(*) AS n, sum(deal_amount_krw) AS v FROM live
    WHERE deal_date > (SELECT max(deal_date) FROM live) - INTERVAL 12 MONTH GROUP BY 1)"""


@query("liquidity", a.with_views("live") + f", {_LIQUID} SELECT internal_complex_id, n AS transaction_count_12m, round(v + 0.00000001, 2) AS transaction_value_12m FROM liquid")
def liquidity(spark, folder):
    return settle(mapmetrics.liquidity(a.sales(spark, folder)), scale=2)


@query(
    "overview_metrics",
    a.with_views("live", "master") + f""", {_LIQUID} SELECT m.internal_complex_id, CASE WHEN k % 4 = 0 THEN households * 2 WHEN k % 4 = 1 THEN households END AS market_cap_krw,
    coalesce(n, 0) AS transaction_count_12m, round(coalesce(v, 0) + 0.00000001, 2) AS transaction_value_12m, CASE WHEN k % 3 = 0 THEN k / 100.0 END AS school_value_gap_pct
    FROM (SELECT *, CAST(kapt_code AS BIGINT) AS k FROM master) m LEFT JOIN liquid USING (internal_complex_id)""",
)
def overview_metrics(spark, folder):
    m = a.master(spark, folder)
    k = F.col("kapt_code").cast("long")
    caps = m.where(k % 4 < 2).select("kapt_code", F.col("households").alias("market_cap_krw"), F.when(k % 4 == 0, F.col("households") * 2).alias("adjusted_market_cap_krw"))
    gaps = m.where(k % 3 == 0).select(F.col("kapt_code").alias("apartment_id"), (k / 100.0).alias("school_value_gap_pct"))
    return settle(mapmetrics.overview_metrics(m, a.sales(spark, folder), caps, gaps), scale=2)


@query(
    "weighted_prices",
    a.with_views("live", "master") + """, p AS (SELECT internal_complex_id, year_month, area_group, avg(deal_amount_krw) AS mean_price, count(*) AS n FROM live GROUP BY 1, 2, 3),
    w AS (SELECT internal_complex_id, sum(mean_price * n) / sum(n) AS price, sum(n) AS n FROM p GROUP BY 1)
    SELECT m.internal_complex_id, round(price + 0.00000001, 4) AS map_average_price_krw, coalesce(n, 0)::DOUBLE AS map_transaction_count, CASE WHEN price IS NOT NULL THEN '4억 미만' END AS price_band
    FROM master m LEFT JOIN w USING (internal_complex_id)""",
)
def weighted_prices(spark, folder):
    monthly = panel.monthly_sales(a.live_sales(spark, folder))
    df = mapmetrics.with_price_band(mapmetrics.weighted_prices(a.master(spark, folder), monthly))
    return settle(df, ID, "map_average_price_krw", "map_transaction_count", "price_band", scale=4)


@query(
    "legend_values",
    "SELECT round(quantile_cont(o_totalprice, 0.25) + 0.00000001, 6) AS q25, round(median(o_totalprice) + 0.00000001, 6) AS q50, round(quantile_cont(o_totalprice, 0.75) + 0.00000001, 6) AS q75, count(*) AS value_count FROM orders",
)
def legend_values(spark, folder):
    return settle(mapmetrics.legend_values(a.table(spark, folder, "orders"), "o_totalprice"))


@query(
    "legend_values_split",
    """SELECT round(quantile_cont(o_totalprice, 0.25) + 0.00000001, 6) AS q25, round(quantile_cont(o_totalprice, 0.98) + 0.00000001, 6) AS q98, count(*) AS n FROM orders""",
)
def legend_values_split(spark, folder):
    """Quantiles of a whole table next to its row count."""
    q = {"q25": scale.Quantile(F.col("o_totalprice"), 0.25), "q98": scale.Quantile(F.col("o_totalprice"), 0.98)}
    return settle(scale.group_quantiles(a.table(spark, folder, "orders"), [], q, {"n": F.count(F.lit(1))}))


def _marker(fn: str, close: str) -> str:
    return f"""WITH v AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS x FROM customer),
    b AS (SELECT quantile_cont(x, 0.02) AS lo, quantile_cont(x, 0.98) AS hi FROM v)
    SELECT c_custkey, round(CASE WHEN x IS NULL THEN 5.0 ELSE 5.0 + 21.0 * ({fn}greatest(least(x, hi), lo){close} - {fn}lo{close}) / ({fn}hi{close} - {fn}lo{close}) END + 0.00000001, 6) AS marker_size FROM v, b"""


@query("marker_sizes", _marker("sqrt(", ")"))
def marker_sizes(spark, folder):
    return settle(mapmetrics.scale_markers(a.table(spark, folder, "customer"), "c_acctbal"), "c_custkey", "marker_size")


@query("marker_sizes_log", _marker("ln(1 + ", ")"))
def marker_sizes_log(spark, folder):
    return settle(mapmetrics.scale_markers(a.table(spark, folder, "customer"), "c_acctbal", method="log1p"), "c_custkey", "marker_size")


@query(
    "centred_ratios",
    """SELECT c_custkey, round(greatest(least(c_acctbal, l), -l) / l + 0.00000001, 6) AS gap_ratio FROM customer, (SELECT quantile_cont(abs(c_acctbal), 0.98) AS l FROM customer)""",
)
def centred_ratios(spark, folder):
    return settle(mapmetrics.centred_ratio(a.table(spark, folder, "customer"), "c_acctbal"), "c_custkey", "gap_ratio")


@query(
    "coordinate_check",
    "WITH " + a.SQL["schools"] + " SELECT school_id, coalesce(latitude BETWEEN 32 AND 39 AND longitude BETWEEN 124 AND 132, false) AS valid FROM schools",
)
def coordinate_check(spark, folder):
    return a.schools(spark, folder).select("school_id", bands.coordinate_valid(F.col("latitude"), F.col("longitude")).alias("valid"))
