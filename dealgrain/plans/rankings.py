"""Registered queries: rankings, searches and recent contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands, months, numeric
from ..operators import clean, ranking, regions
from . import adapters as a
from .registry import query
from .shape import rounds, settle, wides

ID = "internal_complex_id"
_COUNTS = """counts AS (SELECT internal_complex_id, year_month, midx, area_group, min(complex_name) AS complex_name, min(sigungu) AS sigungu,
    min(dong) AS dong, count(*) AS transaction_count FROM live GROUP BY ALL)"""


def _window(months_back: int | str, table: str = "counts") -> str:
    last = f"(SELECT max(midx) FROM {table})"
    first = f"{last} // 12 * 12" if months_back == "ytd" else f"{last} - {months_back - 1}"
    return f"midx BETWEEN {first} AND {last}"


def counts(spark, folder):
    """Contracts per complex, month and area group: the input of volume rankings."""
    names = ["complex_name", "sigungu", "dong"]
    return a.live_sales(spark, folder).groupBy(ID, "year_month", "area_group", *names).agg(F.count(F.lit(1)).alias("transaction_count"))


def _volume(window, top_n: int, where: str = "TRUE") -> str:
    return a.with_views("live", "master") + f""", {_COUNTS},
    totals AS (SELECT internal_complex_id, min(complex_name) AS complex_name, min(sigungu) AS sigungu, min(dong) AS dong,
        sum(transaction_count) AS transaction_count FROM counts WHERE {_window(window)} AND {where} GROUP BY 1)
    SELECT CAST(row_number() OVER (ORDER BY t.transaction_count DESC, t.complex_name, internal_complex_id) AS BIGINT) AS rank,
        internal_complex_id, t.complex_name, t.sigungu, t.dong, CAST(transaction_count AS BIGINT) AS transaction_count,
        round(households + 0.00000001, 6) AS household_count, round(transaction_count / households * 100 + 0.00000001, 6) AS transaction_rate
    FROM totals t LEFT JOIN master m USING (internal_complex_id) ORDER BY rank LIMIT {top_n}"""


_VOLUME = ["rank", ID, "complex_name", "sigungu", "dong", "transaction_count", "household_count", "transaction_rate"]


@query("volume_ranking", _volume(3, 20))
def volume_ranking(spark, folder):
    """The flagship: the most traded complexes of the last three months."""
    return settle(ranking.volume_ranking(counts(spark, folder), 3, a.master(spark, folder)), *_VOLUME)


@query("volume_ranking_ytd_district", _volume("ytd", 10, "sigungu = 'ASIA'"))
def volume_ranking_ytd_district(spark, folder):
    return settle(ranking.volume_ranking(counts(spark, folder), "ytd", a.master(spark, folder), sigungu="ASIA", top_n=10), *_VOLUME)


@query(
    "median_transaction_rate",
    f"""WITH ranked AS ({_volume(12, 50)}) SELECT round(median(transaction_rate) + 0.00000001, 6) AS median_rate, count(transaction_rate) AS rows_with_rate,
    count(*) FILTER (transaction_rate IS NULL) AS rows_without_households FROM ranked""",
)
def median_transaction_rate(spark, folder):
    ranked = ranking.volume_ranking(counts(spark, folder), 12, a.master(spark, folder), top_n=50)
    return settle(ranking.median_rate(settle(ranked, *_VOLUME)))


@query("district_volume", a.with_views("live") + f", {_COUNTS} SELECT sigungu, CAST(sum(transaction_count) AS BIGINT) AS transaction_count FROM counts WHERE {_window(6)} GROUP BY 1")
def district_volume(spark, folder):
    return ranking.region_volume(counts(spark, folder), 6, "sigungu")


@query(
    "dong_volume",
    a.with_views("live") + f", {_COUNTS} SELECT dong, CAST(sum(transaction_count) AS BIGINT) AS transaction_count FROM counts WHERE {_window('ytd')} AND sigungu = 'EUROPE' GROUP BY 1",
)
def dong_volume(spark, folder):
    return ranking.region_volume(counts(spark, folder), "ytd", "dong", sigungu="EUROPE")


@query("household_lookup", a.with_views("master") + "SELECT internal_complex_id, CASE WHEN households > 0 THEN households END AS household_count FROM master")
def household_lookup(spark, folder):
    return settle(ranking.household_lookup(a.master(spark, folder)))


@query(
    "month_window",
    a.with_views("sales") + f"""SELECT year_month, count(*) AS contract_count, '2001-06' AS window_start, max(year_month) OVER () AS window_end
    FROM sales WHERE {_window(6, 'sales')} GROUP BY year_month""",
)
def month_window(spark, folder):
    rows = months.in_month_window(a.sales(spark, folder), "year_month", 6)
    return rows.groupBy("year_month", "window_start", "window_end").agg(F.count(F.lit(1)).alias("contract_count"))


@query(
    "unit_price_ranking",
    a.with_views("sales") + f""", prices AS (SELECT internal_complex_id, median(price_per_3_3sqm) AS price_per_3_3sqm, count(*) AS transaction_count,
        max(deal_date) AS latest_deal_date, min(complex_name) AS complex_name, min(sigungu) AS sigungu, min(dong) AS dong
        FROM sales WHERE {_window(12, 'sales')} AND NOT is_cancelled AND price_per_3_3sqm > 0 GROUP BY 1)
    SELECT row_number() OVER (ORDER BY price_per_3_3sqm DESC, transaction_count DESC, complex_name, internal_complex_id) AS rank,
        internal_complex_id, complex_name, sigungu, dong, {rounds('price_per_3_3sqm')}, transaction_count, latest_deal_date
    FROM prices ORDER BY rank LIMIT 20""",
)
def unit_price_ranking(spark, folder):
    df = ranking.unit_price_ranking(a.sales(spark, folder), a.master(spark, folder), window=12)
    return settle(df, "rank", ID, "complex_name", "sigungu", "dong", "price_per_3_3sqm", "transaction_count", "latest_deal_date")


@query(
    "household_ranking",
    a.with_views("master") + """SELECT row_number() OVER (ORDER BY households DESC, complex_name, internal_complex_id) AS rank,
    internal_complex_id, complex_name, sigungu, households, approval_date FROM master WHERE households > 0 ORDER BY rank LIMIT 20""",
)
def household_ranking(spark, folder):
    return settle(ranking.household_ranking(a.master(spark, folder)), "rank", ID, "complex_name", "sigungu", "households", "approval_date")


@query(
    "oldest_ranking",
    a.with_views("master") + f"""SELECT row_number() OVER (ORDER BY approval_date, complex_name, internal_complex_id) AS rank, internal_complex_id,
    complex_name, dong, approval_date, CAST(date_diff('year', approval_date, DATE '{a.AS_OF}')
        - CASE WHEN strftime(approval_date, '%m-%d') > '{a.AS_OF[5:]}' THEN 1 ELSE 0 END AS BIGINT) AS apartment_age
    FROM master ORDER BY rank LIMIT 20""",
)
def oldest_ranking(spark, folder):
    return settle(ranking.oldest_ranking(a.master(spark, folder), a.AS_OF), "rank", ID, "complex_name", "dong", "approval_date", "apartment_age")


_RECENT = a.with_views("sales", "master") + f""", recent AS (
    SELECT s.internal_complex_id, median(deal_amount_krw) AS median_price, min(deal_amount_krw) AS min_price, max(deal_amount_krw) AS max_price,
        count(*) AS transaction_count, bool_or(s.provisional) AS provisional
    FROM sales s WHERE {_window(6, 'sales')} AND NOT is_cancelled AND deal_amount_krw > 0 GROUP BY 1),
prices AS (SELECT r.*, m.complex_name, m.sigungu, m.dong, m.households, m.parking_per_household, m.apartment_age
    FROM recent r LEFT JOIN master m USING (internal_complex_id))"""
_PRICES = [ID, "complex_name", "sigungu", "dong", "median_price", "min_price", "max_price", "transaction_count", "households", "provisional"]


def recent_prices_table(spark, folder):
    return ranking.recent_prices(a.sales(spark, folder), a.master(spark, folder), window=6)


@query(
    "recent_prices",
    _RECENT + f"SELECT internal_complex_id, complex_name, sigungu, dong, {rounds('median_price', 'min_price', 'max_price', 'households')}, transaction_count, provisional FROM prices",
)
def recent_prices(spark, folder):
    return settle(recent_prices_table(spark, folder), *_PRICES)


@query(
    "search_recent_prices",
    _RECENT + f"""SELECT row_number() OVER (ORDER BY median_price, transaction_count DESC, complex_name, internal_complex_id) AS row_no,
    internal_complex_id, {rounds('median_price', 'households')} FROM prices WHERE median_price BETWEEN 10000 AND 90000
    AND households BETWEEN 200 AND 1800 AND parking_per_household BETWEEN 0.1 AND 5 AND apartment_age BETWEEN 0 AND 60""",
)
def search_recent_prices(spark, folder):
    df = ranking.search_recent_prices(recent_prices_table(spark, folder), (10_000, 90_000), (200, 1800), (0.1, 5.0), (0, 60))
    return settle(df, "row_no", ID, "median_price", "households")


@query(
    "recent_contracts",
    a.with_views("live") + """SELECT deal_date, source_row_id, area_group, round(deal_amount_krw / 10000.0 + 0.00000001, 6) AS deal_amount_manwon, floor::BIGINT AS floor
    FROM live WHERE internal_complex_id = '7' AND year_month BETWEEN '1998-01' AND '2001-12' ORDER BY deal_date DESC, source_row_id LIMIT 50""",
)
def recent_contracts(spark, folder):
    df = ranking.recent_contracts(a.sales(spark, folder), "7", "1998-01", "2001-12")
    return settle(df, "deal_date", "source_row_id", "area_group", "deal_amount_manwon", "floor")


@query("name_search", a.with_views("master") + "SELECT internal_complex_id, complex_name FROM master WHERE contains(complex_name, '0003')")
def name_search(spark, folder):
    return ranking.named_like(a.master(spark, folder), "0003").select(ID, "complex_name")


@query(
    "metadata_filter",
    a.with_views("master") + """SELECT internal_complex_id, households, CAST(coalesce(year(approval_date), 2001 - apartment_age) AS BIGINT) AS approval_year
    FROM master WHERE households BETWEEN 300 AND 1500 AND coalesce(year(approval_date), 2001 - apartment_age) BETWEEN 1950 AND 1990""",
)
def metadata_filter(spark, folder):
    df = regions.with_approval_year(a.master(spark, folder), a.AS_OF)
    return settle(df.where(regions.metadata_filter((300, 1500), (1950, 1990))), ID, "households", "approval_year")


@query(
    "explore_panel",
    a.with_views("live", "master") + f""", {_COUNTS} SELECT year_month, area_group, CAST(sum(transaction_count) AS BIGINT) AS transaction_count,
    count(DISTINCT internal_complex_id) AS complex_count FROM counts WHERE year_month BETWEEN '1996-01' AND '1999-12'
    AND area_group IN ('65_80', '80_90') AND internal_complex_id IN (SELECT internal_complex_id FROM master
        WHERE households BETWEEN 300 AND 1500 AND year(approval_date) BETWEEN 1940 AND 2000 AND sigungu IN ('ASIA', 'EUROPE')) GROUP BY 1, 2""",
)
def explore_panel(spark, folder):
    meta = regions.with_approval_year(a.master(spark, folder), a.AS_OF)
    _, rows = regions.explore(
        counts(spark, folder), meta, regions.metadata_filter((300, 1500), (1940, 2000)), districts=["ASIA", "EUROPE"],
        month_range=("1996-01", "1999-12"), area_groups=["65_80", "80_90"],
    )
    return rows.groupBy("year_month", "area_group").agg(
        F.sum("transaction_count").alias("transaction_count"), F.countDistinct(ID).alias("complex_count")
    )


@query(
    "ages_and_sizes",
    a.with_views("master") + """SELECT internal_complex_id, CASE WHEN apartment_age IS NULL THEN NULL WHEN apartment_age <= 5 THEN '0~5년'
    WHEN apartment_age <= 10 THEN '6~10년' WHEN apartment_age <= 20 THEN '11~20년' WHEN apartment_age <= 30 THEN '21~30년' ELSE '30년 초과' END AS age_group,
    coalesce(households >= 500, false) AS is_500plus, coalesce(households >= 1000, false) AS is_1000plus, apartment_age <= 10 AS is_under_10years,
    apartment_age > 20 AS is_over_20years, apartment_age > 30 AS is_over_30years FROM master""",
)
def ages_and_sizes(spark, folder):
    flags = bands.size_and_age_flags(F.col("households"), F.col("apartment_age"))
    return a.master(spark, folder).select(
        ID, bands.age_group(F.col("apartment_age")).alias("age_group"), *[c.alias(n) for n, c in flags.items()]
    )


@query(
    "relabelled_watchlist",
    a.with_views("live") + """SELECT internal_complex_id AS "단지", round(max(deal_amount_krw) / 100000000 + 0.00000001, 6) AS "고점(억원)",
    round(max(price_per_3_3sqm) / 10000 + 0.00000001, 6) AS "평당(만원)", CASE WHEN bool_or(provisional) THEN '예' ELSE '아니오' END AS "잠정"
    FROM live GROUP BY 1""",
)
def relabelled_watchlist(spark, folder):
    rows = a.live_sales(spark, folder).groupBy(ID).agg(
        F.max("deal_amount_krw").alias("rolling_peak"), F.max("price_per_3_3sqm").alias("unit"), F.max("provisional").alias("provisional")
    )
    labels = {ID: "단지", "rolling_peak": "고점(억원)", "unit": "평당(만원)", "provisional": "잠정"}
    return settle(clean.relabel(rows, labels, eok=["rolling_peak"], manwon=["unit"], flags=["provisional"]))


@query(
    "price_bands",
    """SELECT CASE WHEN p < 4 THEN '4억 미만' WHEN p >= 12 THEN '12억 이상' ELSE CAST(floor(p) AS INTEGER) || '~' || CAST(floor(p) + 1 AS INTEGER) || '억' END AS price_band,
    count(*) AS contract_count FROM (SELECT l_extendedprice * 1500 / 100000000 * 10 AS p FROM lineitem) GROUP BY 1""",
)
def price_bands(spark, folder):
    p = F.col("l_extendedprice") * 1500 / 100_000_000 * 10
    rows = a.table(spark, folder, "lineitem").select(bands.price_band(p).alias("price_band"))
    return rows.groupBy("price_band").agg(F.count(F.lit(1)).alias("contract_count"))


@query(
    "review_priorities",
    """SELECT CASE WHEN n >= 30 THEN 'P1' WHEN n >= 10 THEN 'P2' ELSE 'P3' END AS priority, count(*) AS key_count
    FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1""",
)
def review_priorities(spark, folder):
    groups = a.table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy(bands.review_priority(F.col("n")).alias("priority")).agg(F.count(F.lit(1)).alias("key_count"))


@query(
    "safe_ratios",
    """SELECT l_linenumber::BIGINT AS l_linenumber, round(sum(l_extendedprice / nullif(l_tax, 0)) + 0.00000001, 2) AS ratio_sum,
    count(*) FILTER (l_tax = 0) AS zero_denominators FROM lineitem GROUP BY 1""",
)
def safe_ratios(spark, folder):
    r = numeric.ratio(F.col("l_extendedprice"), F.col("l_tax"))
    df = a.table(spark, folder, "lineitem").groupBy("l_linenumber").agg(F.sum(r).alias("ratio_sum"), F.count_if(r.isNull()).alias("zero_denominators"))
    return settle(df, scale=2)


@query(
    "half_even_rounding",
    "SELECT l_quantity AS quantity, round_even(l_quantity / 2, 0) AS halved, count(*) AS contract_count FROM lineitem GROUP BY 1, 2",
)
def half_even_rounding(spark, folder):
    df = a.table(spark, folder, "lineitem").select(
        F.col("l_quantity").alias("quantity"), numeric.round_half_even(F.col("l_quantity") / 2).alias("halved")
    )
    return df.groupBy("quantity", "halved").agg(F.count(F.lit(1)).alias("contract_count"))


@query(
    "top_rows_newest",
    f"SELECT {wides('l_orderkey', 'l_linenumber')}, CAST(l_shipdate AS DATE) AS deal_date FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey LIMIT 50",
)
def top_rows_newest(spark, folder):
    rows = a.table(spark, folder, "lineitem").withColumn("deal_date", F.col("l_shipdate").cast("date"))
    best = ranking.top_rows(rows, [F.desc("deal_date"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")], 50)
    return settle(best, "l_orderkey", "l_linenumber", "deal_date")


@query(
    "row_numbers",
    """SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_no,
    l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey FROM lineitem""",
)
def row_numbers(spark, folder):
    """All contracts numbered in date order without gathering them in one task."""
    from ..operators.scale import with_row_number

    order = [F.asc(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    rows = a.table(spark, folder, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return settle(with_row_number(rows, order, "row_no"), "row_no", "l_orderkey", "l_linenumber", "l_partkey")
