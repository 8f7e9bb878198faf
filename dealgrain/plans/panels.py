"""Registered queries: monthly panels, rolling indicators, summaries, scores and watchlists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import months
from ..operators import panel, rent, summary
from ..operators.scale import Quantile, group_quantiles
from ..session import materialise
from . import adapters as a
from .registry import query
from .shape import rounds, settle, wides

ID = "internal_complex_id"
SERIES = "internal_complex_id, area_group, year_month"
KEYS = [ID, "area_group", "year_month"]


def sale_panel(spark: SparkSession, folder: str) -> DataFrame:
    return panel.sale_panel(a.live_sales(spark, folder), a.master(spark, folder).drop("internal_complex_id"))


def complexes(spark: SparkSession, folder: str) -> DataFrame:
    """The complex summary, stored once because summaries read it several times."""
    return materialise(summary.complex_summary(sale_panel(spark, folder)), "complexes")


@query(
    "monthly_sales",
    a.with_views("monthly") + f"""SELECT {SERIES}, transaction_count, {rounds('median_price', 'mean_price', 'median_price_per_sqm',
    'median_price_per_3_3sqm')}, sigungu, dong, complex_name, provisional FROM monthly""",
)
def monthly_sales(spark, folder):
    df = panel.monthly_sales(a.live_sales(spark, folder))
    return settle(df, *KEYS, "transaction_count", "median_price", "mean_price", "median_price_per_sqm", "median_price_per_3_3sqm",
                  "sigungu", "dong", "complex_name", "provisional")


@query(
    "monthly_sales_split_groups",
    a.with_views("live") + """SELECT sigungu, area_group, count(*) AS transaction_count, round(median(deal_amount_krw) + 0.00000001, 6) AS median_price,
    round(quantile_cont(price_per_sqm, 0.25) + 0.00000001, 6) AS q25 FROM live GROUP BY ALL""",
)
def monthly_sales_split_groups(spark, folder):
    """District medians and quartiles next to a count."""
    q = {"median_price": Quantile(F.col("deal_amount_krw")), "q25": Quantile(F.col("price_per_sqm"), 0.25)}
    df = group_quantiles(a.live_sales(spark, folder), ["sigungu", "area_group"], q, {"transaction_count": F.count(F.lit(1))})
    return settle(df, "sigungu", "area_group", "transaction_count", "median_price", "q25")


@query(
    "monthly_sales_with_register",
    a.with_views("monthly", "master") + f"""SELECT {', '.join('m.' + c for c in SERIES.split(', '))}, m.transaction_count,
    {rounds('households')}, CAST(r.apartment_age AS BIGINT) AS apartment_age, r.approval_date
    FROM monthly m LEFT JOIN master r ON m.internal_complex_id = r.kapt_code""",
)
def monthly_sales_with_register(spark, folder):
    df = panel.attach_master(panel.monthly_sales(a.live_sales(spark, folder)), a.master(spark, folder).drop("internal_complex_id"))
    return settle(df, *KEYS, "transaction_count", "households", "apartment_age", "approval_date")


@query("calendar_fill", a.with_views("filled") + f"SELECT {SERIES}, transaction_count, sigungu, dong, complex_name, provisional FROM filled")
def calendar_fill(spark, folder):
    return settle(sale_panel(spark, folder), *KEYS, "transaction_count", "sigungu", "dong", "complex_name", "provisional")


def _panel_query(name: str, *columns: str) -> None:
    """Register one query over chosen columns of the sale panel."""
    doubles = [c for c in columns if c != "low_sample_flag"]
    flags = [c for c in columns if c == "low_sample_flag"]
    picks = ", ".join([SERIES, rounds(*doubles), *flags])

    def run(spark, folder):
        return settle(sale_panel(spark, folder), *KEYS, *columns)

    query(name, a.with_views("panel") + f"SELECT {picks} FROM panel")(run)


_panel_query("rolling_volume", "transactions_3m", "transactions_6m", "transactions_12m")
_panel_query("rolling_price", "price_3m", "price_6m", "price_12m", "price_per_sqm_3m", "price_per_3_3sqm_3m")
_panel_query("rolling_return", "return_3m", "return_6m", "return_12m")
_panel_query("volume_year_on_year", "transaction_yoy")
_panel_query("peaks_and_troughs", "rolling_peak", "drawdown_from_peak", "rolling_trough", "recovery_from_trough")
_panel_query("turnover_and_sample", "turnover_12m", "sample_count", "low_sample_flag")


@query(
    "relative_turnover",
    a.with_views("panel") + f"""SELECT {', '.join('p.' + c for c in SERIES.split(', '))},
    round(turnover_12m / nullif(d, 0) + 0.00000001, 6) AS district_relative_turnover
    FROM panel p JOIN (SELECT sigungu, year_month, median(turnover_12m) AS d FROM panel GROUP BY ALL) USING (sigungu, year_month)""",
)
def relative_turnover(spark, folder):
    # Stored, since the medians read it more than once.
    stored = materialise(sale_panel(spark, folder).select(*KEYS, "sigungu", "turnover_12m"), "turnover")
    df = panel.add_relative_turnover(stored)
    return settle(df, *KEYS, "district_relative_turnover")


@query("latest_rows", a.with_views("summary") + f"SELECT {SERIES}, {rounds('price_3m', 'transactions_12m')} FROM latest")
def latest_rows(spark, folder):
    df = panel.latest_per_series(sale_panel(spark, folder).select(*KEYS, "price_3m", "transactions_12m"))
    return settle(df, *KEYS, "price_3m", "transactions_12m")


@query("latest_rows_of_complex", a.with_views("summary") + f"SELECT {SERIES}, {rounds('price_3m')} FROM latest WHERE internal_complex_id = '7'")
def latest_rows_of_complex(spark, folder):
    return settle(panel.latest_per_area(sale_panel(spark, folder).select(*KEYS, "price_3m"), "7"), *KEYS, "price_3m")


@query("monthly_volume", a.with_views("live") + "SELECT internal_complex_id, year_month, count(*)::DOUBLE AS transaction_count FROM live GROUP BY ALL")
def monthly_volume(spark, folder):
    df = panel.monthly_volume(sale_panel(spark, folder)).where("transaction_count > 0")
    return settle(df, ID, "year_month", "transaction_count")


@query(
    "price_series",
    a.with_views("filled") + """SELECT internal_complex_id, year_month, round(median_price / 10000.0 + 0.00000001, 6) AS median_price
    FROM filled WHERE area_group = '80_90' AND internal_complex_id IN ('1', '2', '3', '5', '8')""",
)
def price_series(spark, folder):
    return settle(panel.price_series(sale_panel(spark, folder), "80_90", ["1", "2", "3", "5", "8"], 10_000))


_SUMS = ["transactions_3m", "transactions_6m", "transactions_12m", "turnover_12m", "households", "parking_total", "parking_per_household"]
_REF = ["price_84", "price_84_per_3_3sqm", "price_change_3m", "price_change_6m", "price_change_12m", "rolling_peak", "drawdown_from_peak",
        "rolling_trough", "recovery_from_trough", "sample_count"]
_NAMES = [ID, "complex_name", "sigungu", "dong", "approval_date", "provisional", "low_sample_flag"]


@query(
    "complex_summary",
    a.with_views("summary") + f"SELECT {', '.join(_NAMES)}, {rounds(*_SUMS, *_REF)}, {wides('apartment_age', 'area_variety')} FROM summary",
)
def complex_summary(spark, folder):
    df = summary.complex_summary(sale_panel(spark, folder))
    return settle(df, *_NAMES, *_SUMS, *_REF, "apartment_age", "area_variety")


_DISTRICT = """count(DISTINCT internal_complex_id) AS complex_count, round(sum(households) + 0.00000001, 6) AS household_count,
    round(avg(apartment_age) + 0.00000001, 6) AS average_age, round(median(apartment_age) + 0.00000001, 6) AS median_age,
    round(avg((apartment_age <= 10)::INT) + 0.00000001, 6) AS under_10year_ratio, round(avg((apartment_age > 20)::INT) + 0.00000001, 6) AS over_20year_ratio,
    round(avg((apartment_age > 30)::INT) + 0.00000001, 6) AS over_30year_ratio, count(*) FILTER (households >= 500) AS large_complex_count,
    round(avg(parking_per_household) + 0.00000001, 6) AS average_parking_per_household, round(sum(transactions_12m) + 0.00000001, 6) AS transactions_12m,
    round(sum(transactions_12m) / nullif(sum(households), 0) + 0.00000001, 6) AS turnover_12m, round(median(price_84) + 0.00000001, 6) AS median_84_price,
    round(median(price_84_per_3_3sqm) + 0.00000001, 6) AS median_84_price_per_3_3sqm, round(median(price_change_6m) + 0.00000001, 6) AS price_change_6m,
    round(median(price_change_12m) + 0.00000001, 6) AS price_change_12m, round(median(drawdown_from_peak) + 0.00000001, 6) AS drawdown_from_peak"""


@query("district_summary", a.with_views("summary") + f"SELECT sigungu, {_DISTRICT} FROM summary GROUP BY sigungu")
def district_summary(spark, folder):
    return settle(summary.district_summary(complexes(spark, folder)))


@query(
    "dong_summary",
    a.with_views("summary") + """SELECT sigungu, dong, count(DISTINCT internal_complex_id) AS complex_count,
    round(sum(households) + 0.00000001, 6) AS households, round(sum(transactions_12m) + 0.00000001, 6) AS transactions_12m,
    round(sum(transactions_12m) / nullif(sum(households), 0) + 0.00000001, 6) AS turnover_12m, round(median(apartment_age) + 0.00000001, 6) AS median_age,
    round(median(price_84) + 0.00000001, 6) AS median_84_price, round(median(price_change_6m) + 0.00000001, 6) AS change_6m,
    round(median(price_change_12m) + 0.00000001, 6) AS change_12m, round(median(drawdown_from_peak) + 0.00000001, 6) AS drawdown
    FROM summary GROUP BY sigungu, dong""",
)
def dong_summary(spark, folder):
    return settle(summary.dong_summary(complexes(spark, folder)))


def _share(metric: str, scope: str) -> str:
    part = "sigungu" if scope == "district" else "sigungu, dong"
    return (f"CASE WHEN {metric} IS NOT NULL THEN (rank() OVER (PARTITION BY {part}, {metric} IS NULL ORDER BY {metric}) "
            f"+ (count(*) OVER (PARTITION BY {part}, {metric}) - 1) / 2.0) / count({metric}) OVER (PARTITION BY {part}) END")


def _scores(scope: str) -> str:
    cols = {"p_households": "households", "p_turnover": "turnover_12m", "p_price_84": "price_84", "p_area_variety": "area_variety"}
    picks = ", ".join(f"{_share(m, scope)} AS {n}" for n, m in cols.items())
    return f"SELECT internal_complex_id, sigungu, dong, '{scope}' AS scope, {picks} FROM summary"


_SCORED = f"""scored AS (
    SELECT *, coalesce(p_households, 0) * 0.30 + coalesce(p_turnover, 0) * 0.30 + coalesce(p_price_84, 0) * 0.25
        + coalesce(p_area_variety, 0) * 0.15 AS representative_score
    FROM ({_scores('district')} UNION ALL {_scores('dong')}))"""
_PERCENTS = ("p_households", "p_turnover", "p_price_84", "p_area_variety", "representative_score")


@query("percentile_scores", a.with_views("summary") + f", {_SCORED} SELECT internal_complex_id, scope, {rounds(*_PERCENTS)} FROM scored")
def percentile_scores(spark, folder):
    return settle(summary.percentile_scores(complexes(spark, folder)), ID, "scope", *_PERCENTS)


@query(
    "representatives",
    a.with_views("summary") + f""", {_SCORED}, ranked AS (
    SELECT *, row_number() OVER (PARTITION BY scope, sigungu, CASE WHEN scope = 'dong' THEN dong END
        ORDER BY round(representative_score, 12) DESC, internal_complex_id) AS rank FROM scored)
    SELECT internal_complex_id, scope, rank, {rounds('representative_score')} FROM ranked WHERE rank <= 5""",
)
def representatives(spark, folder):
    return settle(summary.representatives(complexes(spark, folder)), ID, "scope", "rank", "representative_score")


_EARLIER = """earlier AS (
    SELECT internal_complex_id, sum(transaction_count) AS previous_6m_transactions FROM panel
    WHERE midx BETWEEN (SELECT max(midx) FROM panel) - 11 AND (SELECT max(midx) FROM panel) - 6 GROUP BY 1)"""


@query(
    "recovery_watchlist",
    a.with_views("summary") + f""", {_EARLIER}
    SELECT s.internal_complex_id, round(coalesce(previous_6m_transactions, 0) + 0.00000001, 6) AS previous_6m_transactions,
        round(s.transactions_6m + 0.00000001, 6) AS transactions_6m, '시장회복 관찰대상' AS watch_label
    FROM summary s LEFT JOIN earlier USING (internal_complex_id)
    WHERE s.transactions_6m > coalesce(previous_6m_transactions, 0)
        AND (price_change_3m >= 0 OR price_change_3m >= price_change_6m - 0.02)
        AND abs(drawdown_from_peak) BETWEEN 0.1 AND 0.6 AND s.transactions_6m >= 3 AND NOT coalesce(low_sample_flag, true)""",
)
def recovery_watchlist(spark, folder):
    whole = sale_panel(spark, folder)
    df = summary.recovery_watchlist(summary.complex_summary(whole), whole)
    return settle(df, ID, "previous_6m_transactions", "transactions_6m", "watch_label")


@query(
    "two_period_volume",
    a.with_views("summary") + f""", {_EARLIER} SELECT internal_complex_id,
    round(s.transactions_6m + 0.00000001, 6) AS transactions_6m, round(coalesce(previous_6m_transactions, 0) + 0.00000001, 6) AS previous_6m_transactions
    FROM summary s LEFT JOIN earlier USING (internal_complex_id)""",
)
def two_period_volume(spark, folder):
    whole = sale_panel(spark, folder)
    # Stored, since both the latest month and the sums read it.
    counts = materialise(whole.select(ID, "year_month", "transaction_count"), "history")
    latest = counts.agg(F.max("year_month").alias("m")).scalar()
    rows = counts.withColumn("_age", months.label_to_index(latest) - months.label_to_index(F.col("year_month")))
    sums = rows.groupBy(ID).agg(F.sum(F.when(F.col("_age").between(6, 11), F.col("transaction_count"))).alias("previous_6m_transactions"))
    out = summary.complex_summary(whole).join(sums, ID, "left").na.fill({"previous_6m_transactions": 0.0})
    return settle(out, ID, "transactions_6m", "previous_6m_transactions")


@query(
    "old_watchlist",
    a.with_views("summary") + """SELECT internal_complex_id, CAST(apartment_age AS BIGINT) AS apartment_age, round(price_84 + 0.00000001, 6) AS price_84,
    round(price_84 / nullif(avg(price_84) OVER (PARTITION BY sigungu, dong), 0) - 1 + 0.00000001, 6) AS discount_vs_dong_mean,
    '데이터 기반 노후단지' AS watch_label FROM summary WHERE apartment_age >= 30""",
)
def old_watchlist(spark, folder):
    return settle(summary.old_watchlist(complexes(spark, folder)), ID, "apartment_age", "price_84", "discount_vs_dong_mean", "watch_label")


@query(
    "headline_figures",
    a.with_views("summary") + """SELECT count(DISTINCT internal_complex_id) AS complex_count, round(sum(households) + 0.00000001, 6) AS household_count,
    round(sum(transactions_12m) + 0.00000001, 6) AS transactions_12m, round(median(price_84) + 0.00000001, 6) AS median_84_price FROM summary""",
)
def headline_figures(spark, folder):
    return settle(summary.headline_figures(complexes(spark, folder)))


@query(
    "latest_month_provisional",
    a.with_views("filled") + "SELECT year_month, bool_or(provisional) AS any_provisional FROM filled GROUP BY 1 ORDER BY 1 DESC LIMIT 1",
)
def latest_month_provisional(spark, folder):
    return summary.latest_month_provisional(sale_panel(spark, folder))


@query(
    "dong_price_grid",
    a.with_views("summary") + "SELECT sigungu, dong, round(median(price_84) + 0.00000001, 6) AS price FROM summary GROUP BY 1, 2",
)
def dong_price_grid(spark, folder):
    return settle(panel.dong_price_grid(complexes(spark, folder)))


# Rent panel ------------------------------------------------------------------------------

_RENT_MONTHLY = """rent_monthly AS (
    SELECT internal_complex_id, area_group, year_month, midx, min(complex_name) AS complex_name, min(sigungu) AS sigungu, min(dong) AS dong,
        max(provisional) AS provisional, nullif(count(*) FILTER (rent_type = '전세'), 0) AS jeonse_count,
        median(deposit_krw) FILTER (rent_type = '전세') AS median_jeonse_deposit,
        nullif(count(*) FILTER (rent_type = '월세'), 0) AS monthly_rent_count,
        median(deposit_krw) FILTER (rent_type = '월세') AS median_monthly_deposit,
        median(monthly_rent_krw) FILTER (rent_type = '월세') AS median_monthly_rent FROM rents GROUP BY ALL),
sale_monthly AS (SELECT internal_complex_id, area_group, year_month, midx, count(*) AS sale_count,
    median(deal_amount_krw) AS median_sale_price FROM market GROUP BY ALL),
both_markets AS (SELECT * FROM rent_monthly FULL JOIN sale_monthly USING (internal_complex_id, area_group, year_month, midx))"""
_RENT_VALUES = ("median_jeonse_deposit", "median_monthly_deposit", "median_monthly_rent")


@query(
    "monthly_rents",
    a.with_views("rents", "market") + f""", {_RENT_MONTHLY} SELECT {SERIES}, jeonse_count, monthly_rent_count, {rounds(*_RENT_VALUES)},
    complex_name, provisional FROM rent_monthly""",
)
def monthly_rents(spark, folder):
    return settle(rent.monthly_rents(a.rents(spark, folder)), *KEYS, "jeonse_count", "monthly_rent_count", *_RENT_VALUES, "complex_name", "provisional")


@query(
    "monthly_sale_prices",
    a.with_views("rents", "market") + f", {_RENT_MONTHLY} SELECT {SERIES}, sale_count, {rounds('median_sale_price')} FROM sale_monthly",
)
def monthly_sale_prices(spark, folder):
    return settle(rent.monthly_sale_prices(a.market_sales(spark, folder)), *KEYS, "sale_count", "median_sale_price")


@query(
    "both_markets",
    a.with_views("rents", "market") + f""", {_RENT_MONTHLY} SELECT {SERIES}, jeonse_count, monthly_rent_count, sale_count,
    {rounds('median_jeonse_deposit', 'median_sale_price')} FROM both_markets""",
)
def both_markets(spark, folder):
    df = rent.combine_markets(rent.monthly_rents(a.rents(spark, folder)), rent.monthly_sale_prices(a.market_sales(spark, folder)))
    return settle(df, *KEYS, "jeonse_count", "monthly_rent_count", "sale_count", "median_jeonse_deposit", "median_sale_price")


def _year(fn: str, c: str) -> str:
    return f"{fn}({c}) OVER (PARTITION BY internal_complex_id, area_group ORDER BY midx ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"


_RENT_PANEL = f"""{_RENT_MONTHLY},
rent_spine AS (SELECT internal_complex_id, area_group, unnest(generate_series(f, (SELECT max(midx) FROM both_markets))) AS midx
    FROM (SELECT internal_complex_id, area_group, min(midx) AS f FROM both_markets GROUP BY ALL)),
rent_filled AS (SELECT s.*, coalesce(jeonse_count, 0) AS jeonse_count, coalesce(monthly_rent_count, 0) AS monthly_rent_count,
    coalesce(sale_count, 0) AS sale_count, median_jeonse_deposit, median_sale_price, coalesce(provisional, false) AS provisional,
    CAST(s.midx // 12 AS VARCHAR) || '-' || lpad(CAST(s.midx % 12 + 1 AS VARCHAR), 2, '0') AS year_month
    FROM rent_spine s LEFT JOIN both_markets USING (internal_complex_id, area_group, midx)),
rent_panel AS (SELECT *, {_year('sum', 'jeonse_count')} AS jeonse_count_12m, {_year('sum', 'monthly_rent_count')} AS monthly_rent_count_12m,
    {_year('sum', 'sale_count')} AS sale_count_12m, {_year('median', 'median_jeonse_deposit')} AS median_jeonse_deposit_12m,
    {_year('median', 'median_sale_price')} AS median_sale_price_12m,
    {_year('median', 'median_jeonse_deposit')} / nullif({_year('median', 'median_sale_price')}, 0) AS jeonse_ratio_12m FROM rent_filled)"""
_RENT_ROLLED = ("jeonse_count_12m", "monthly_rent_count_12m", "sale_count_12m", "median_jeonse_deposit_12m", "median_sale_price_12m", "jeonse_ratio_12m")


def rent_panel(spark, folder):
    return rent.rent_panel(a.rents(spark, folder), a.market_sales(spark, folder))


@query("rent_panel", a.with_views("rents", "market") + f", {_RENT_PANEL} SELECT {SERIES}, provisional, {rounds(*_RENT_ROLLED)} FROM rent_panel")
def rent_panel_query(spark, folder):
    return settle(rent_panel(spark, folder), *KEYS, "provisional", *_RENT_ROLLED)


@query(
    "price_and_deposit_lines",
    a.with_views("rents", "market") + f""", {_RENT_PANEL} SELECT {SERIES}, round(jeonse_ratio_12m * 100 + 0.00000001, 6) AS jeonse_ratio_pct, price_type,
    round(price + 0.00000001, 6) AS price FROM (SELECT *, '매매가 중앙값' AS price_type, median_sale_price_12m AS price FROM rent_panel
    UNION ALL SELECT *, '전세 보증금 중앙값', median_jeonse_deposit_12m FROM rent_panel) WHERE price IS NOT NULL AND area_group = '80_90'""",
)
def price_and_deposit_lines(spark, folder):
    df = rent.price_and_deposit_lines(rent_panel(spark, folder), group="80_90")
    return settle(df, *KEYS, "jeonse_ratio_pct", "price_type", "price")
