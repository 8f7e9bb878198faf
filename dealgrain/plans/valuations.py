"""Registered queries: area registers, market values, external prices and rank history."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import months
from ..operators import prices, pricing, traces, valuation
from ..session import materialise
from . import adapters as a
from .registry import query
from .shape import rounds, settle

COVERAGE = 0.5
_MONTHS = "(SELECT DISTINCT year_month AS month FROM live)"
_OPEN = "DATE '0001-01-01'"


def eligible(spark, folder):
    return valuation.eligible_contracts(a.sales(spark, folder))


def approved_rule():
    """Every seventh complex may value open types by their neighbours."""
    return F.col("kapt_code").cast("long") % 7 == 0


def all_months(spark, folder):
    """Every month from the first contract to the last, worked out by the query itself."""
    return prices.every_month(a.live_sales(spark, folder), "deal_date")


@query(
    "active_area_types",
    a.with_views("area_register", "live") + f"""SELECT month, count(*) AS type_count, sum(households) AS households FROM area_register,
    {_MONTHS} WHERE (valid_from IS NULL OR valid_from <= last_day(CAST(month || '-01' AS DATE)))
    AND (valid_to IS NULL OR valid_to >= last_day(CAST(month || '-01' AS DATE))) GROUP BY 1""",
)
def active_area_types(spark, folder):
    rows = valuation.active_months(a.area_register(spark, folder), all_months(spark, folder))
    return rows.groupBy("month").agg(F.count(F.lit(1)).alias("type_count"), F.sum("households").alias("households"))


@query("eligible_contracts", a.with_views("sales") + "SELECT kapt_code, count(*) AS eligible_rows FROM sales WHERE NOT is_cancelled AND area_sqm > 0 AND deal_amount_krw > 0 GROUP BY 1")
def eligible_contracts(spark, folder):
    return eligible(spark, folder).groupBy("kapt_code").agg(F.count(F.lit(1)).alias("eligible_rows"))


_TERMS = ["kapt_code", "area_sqm", "year_month"]


@query(
    "equal_terms",
    a.with_views("live") + """SELECT same_terms_multiple, count(*) AS contract_count FROM (
    SELECT count(*) OVER (PARTITION BY kapt_code, area_sqm, year_month) > 1 AS same_terms_multiple FROM live) GROUP BY 1""",
)
def equal_terms(spark, folder):
    rows = valuation.flag_equal_terms(a.live_sales(spark, folder), _TERMS)
    return rows.groupBy("same_terms_multiple").agg(F.count(F.lit(1)).alias("contract_count"))


@query(
    "load_audit",
    a.with_views("sales") + """SELECT count(*) AS raw_rows, count(*) FILTER (is_cancelled) AS cancelled_rows, 0::BIGINT AS unverified_mapping_rows,
    min(deal_date) AS period_start, max(deal_date) AS period_end, count(DISTINCT year_month) AS month_count,
    count(*) FILTER (NOT is_cancelled) AS eligible_rows,
    (SELECT count(*) FROM (SELECT count(*) OVER (PARTITION BY kapt_code, area_sqm, year_month) AS n FROM sales WHERE NOT is_cancelled) WHERE n > 1) AS same_terms_rows_preserved
    FROM sales""",
)
def load_audit(spark, folder):
    flagged = valuation.flag_equal_terms(eligible(spark, folder), _TERMS)
    out = valuation.load_audit(a.sales(spark, folder), flagged)
    return out.withColumn("month_count", F.size("raw_months").cast("long")).drop("raw_months")


@query(
    "snapped_areas",
    """WITH deals AS (SELECT l_suppkey, l_quantity * 3 + (l_linenumber - 1) * 0.0021 AS area FROM lineitem),
    types AS (SELECT l_suppkey, unnest([l_quantity * 3, l_quantity * 3 + 0.01]) AS marea FROM (SELECT DISTINCT l_suppkey, l_quantity FROM lineitem)),
    pairs AS (SELECT DISTINCT l_suppkey, area FROM deals),
    hits AS (SELECT p.l_suppkey, area, count(DISTINCT marea) AS n, min(marea) AS only_area,
        count(DISTINCT marea) FILTER (abs(marea - floor(area * 100) / 100) <= 1e-9) AS e, min(marea) FILTER (abs(marea - floor(area * 100) / 100) <= 1e-9) AS cut
        FROM pairs p JOIN types t ON p.l_suppkey = t.l_suppkey AND abs(marea - area) <= 0.01 + 1e-12 GROUP BY 1, 2)
    SELECT CAST(d.l_suppkey AS VARCHAR) AS kapt_code, round(coalesce(CASE WHEN n = 1 THEN only_area WHEN e = 1 THEN cut END, d.area) + 0.00000001, 4) AS area_sqm,
        count(*) AS contract_count FROM deals d LEFT JOIN hits h ON d.l_suppkey = h.l_suppkey AND d.area = h.area GROUP BY 1, 2""",
)
def snapped_areas(spark, folder):
    lines = a.table(spark, folder, "lineitem")
    deals = lines.select(
        F.col("l_suppkey").cast("string").alias("kapt_code"),
        (F.col("l_quantity") * 3 + (F.col("l_linenumber") - 1) * F.lit(0.0021)).alias("area_sqm"), "l_orderkey", "l_partkey",
    )
    known = lines.select("l_suppkey", "l_quantity").distinct()
    areas = F.explode(F.array(F.col("l_quantity") * 3, F.col("l_quantity") * 3 + 0.01)).alias("exclusive_area_sqm")
    register = known.select(F.col("l_suppkey").cast("string").alias("kapt_code"), areas)
    out = valuation.snap_areas(deals, register)
    out = out.withColumn("area_sqm", F.round("area_sqm", 4))
    return out.groupBy("kapt_code", "area_sqm").agg(F.count(F.lit(1)).alias("contract_count"))


@query(
    "observed_areas",
    a.with_views("live") + "SELECT kapt_code, area_sqm, count(*) AS transaction_count, min(deal_date) AS first_deal, max(deal_date) AS last_deal FROM live GROUP BY ALL",
)
def observed_areas(spark, folder):
    return valuation.observed_areas(a.live_sales(spark, folder))


def _median(n: int) -> str:
    return f"median(deal_amount_krw) FILTER (age < {n})"


def _trimmed(n: int) -> str:
    """The mean without the lowest and the highest tenth (whole contracts)."""
    cut = f"CAST(floor(0.1 * count(*) FILTER (age < {n})) AS BIGINT)"
    return f"list_avg((list_sort(list(deal_amount_krw) FILTER (age < {n})))[{cut} + 1 : (count(*) FILTER (age < {n})) - {cut}])"


def _prices(minimum: int, price=_median) -> str:
    return f"""targets AS MATERIALIZED (SELECT month, CAST(substr(month, 1, 4) AS INTEGER) * 12 + CAST(substr(month, 6, 2) AS INTEGER) - 1 AS vm
    FROM {_MONTHS}),
aged AS (SELECT t.month, t.vm, l.kapt_code, l.area_sqm, l.deal_amount_krw, l.deal_date, age FROM live l CROSS JOIN range(0, 12) r(age) JOIN targets t ON t.vm = l.midx + age),
stats AS (SELECT month, vm, kapt_code, area_sqm,
    {', '.join(f"count(*) FILTER (age < {n}) AS n{n}, {price(n)} AS p{n}, max(deal_date) FILTER (age < {n}) AS d{n}" for n in (1, 3, 6, 12))}
    FROM aged GROUP BY month, vm, kapt_code, area_sqm),
prices AS MATERIALIZED (SELECT month, kapt_code, area_sqm, p1 AS price_1m_krw, n1 AS count_1m, n1 < {minimum} AS small_sample_1m,
    CASE WHEN n3 >= {minimum} THEN 3 WHEN n6 >= {minimum} THEN 6 ELSE 12 END AS window_months,
    CASE WHEN n3 >= {minimum} THEN p3 WHEN n6 >= {minimum} THEN p6 ELSE p12 END AS price_krw,
    CASE WHEN n3 >= {minimum} THEN n3 WHEN n6 >= {minimum} THEN n6 ELSE n12 END AS transaction_count,
    CASE WHEN n3 >= {minimum} THEN d3 WHEN n6 >= {minimum} THEN d6 ELSE d12 END AS latest_deal_date,
    n12 < {minimum} AS small_sample FROM stats)"""


@query(
    "window_prices",
    a.with_views("live") + f""", {_prices(3)} SELECT month, kapt_code, area_sqm, {rounds('price_krw', 'price_1m_krw')}, window_months::BIGINT AS window_months,
    transaction_count, count_1m, small_sample, small_sample_1m, latest_deal_date, window_months > 3 AS old_transactions,
    CASE WHEN small_sample THEN 'small_sample' ELSE 'median_' || window_months || 'm' END AS method FROM prices""",
)
def window_prices(spark, folder):
    df = valuation.median_prices(eligible(spark, folder), all_months(spark, folder), 3)
    return settle(df, "month", "kapt_code", "area_sqm", "price_krw", "price_1m_krw", "window_months", "transaction_count", "count_1m",
                  "small_sample", "small_sample_1m", "latest_deal_date", "old_transactions", "method")


_SOURCED = "month, kapt_code, area_sqm, price_source, price_krw, price_1m_krw, method"


def _sourced(provider: str, method: str) -> str:
    return f"""SELECT month, kapt_code, area_sqm, '{provider}' AS price_source, {rounds('price_krw', 'price_1m_krw')},
    CASE WHEN small_sample THEN 'small_sample' ELSE '{method}_' || window_months || 'm' END AS method FROM prices"""


@query(
    "prices_of_two_providers",
    f"SELECT * FROM ({a.with_views('live')}, {_prices(3)} {_sourced('transaction_median', 'median')}) UNION ALL "
    f"SELECT * FROM ({a.with_views('live')}, {_prices(3, _trimmed)} {_sourced('transaction_trimmed_mean', 'trimmed_mean')})",
)
def prices_of_two_providers(spark, folder):
    """Median and trimmed mean of every window, from one aggregation."""
    df = prices.window_prices(eligible(spark, folder), all_months(spark, folder), 3, [prices.MEDIAN, prices.trimmed_mean(0.1)])
    return settle(df, *_SOURCED.split(", "))


_ISSUES = """issues AS (
    SELECT row, kapt_code, unnest(list_filter([CASE WHEN verification_status NOT IN ('verified', 'pending') THEN '검증 상태는 verified/pending' END,
        CASE WHEN valid_from > valid_to THEN '적용 시작·종료 역전' END], lambda x: x IS NOT NULL)) AS reason FROM area_register
    UNION ALL
    SELECT DISTINCT b.row, b.kapt_code, '기간 중복 평형/동일 전용면적: A/B타입은 세대수를 합친 한 행 필요' FROM area_register x JOIN area_register b
        ON x.kapt_code = b.kapt_code AND x.row < b.row AND (x.area_group_id = b.area_group_id OR x.exclusive_area_sqm = b.exclusive_area_sqm)
        AND greatest(coalesce(x.valid_from, DATE '0001-01-01'), coalesce(b.valid_from, DATE '0001-01-01'))
            <= least(coalesce(x.valid_to, DATE '9999-12-31'), coalesce(b.valid_to, DATE '9999-12-31')))"""


@query("area_register_issues", a.with_views("area_register") + f", {_ISSUES} SELECT CAST(row AS BIGINT) AS row, kapt_code, reason FROM issues")
def area_register_issues(spark, folder):
    return valuation.master_issues(a.area_register(spark, folder), a.master(spark, folder))


@query(
    "overlapping_validity",
    """WITH spans AS (SELECT l_suppkey AS k, l_quantity AS q, l_linenumber, CAST(l_shipdate AS DATE) AS f, CAST(l_shipdate AS DATE) + CAST(l_linenumber * 2 AS INTEGER) AS t,
        (((l_orderkey * 100000 + l_suppkey) * 100000 + l_partkey) * 10 + l_linenumber) * 10 + row_number() OVER (PARTITION BY l_orderkey, l_suppkey, l_partkey, l_linenumber
        ORDER BY l_shipdate, l_quantity, l_extendedprice) AS row FROM lineitem)
    SELECT DISTINCT b.row, CAST(b.k AS VARCHAR) AS kapt_code FROM spans x JOIN spans b ON x.k = b.k AND x.q = b.q AND x.row < b.row
    AND greatest(x.f, b.f) <= least(x.t, b.t)""",
)
def overlapping_validity(spark, folder):
    """Overlap of short validity spans: contracts of one complex and quantity within a few days.

    A row's number has 64 bits as long as all numbers fit, else 38 digits.
    """
    lines, day = a.table(spark, folder, "lineitem"), F.col("l_shipdate").cast("date")
    names = ("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber")
    copy = F.row_number().over(Window.partitionBy(*names).orderBy("l_shipdate", "l_quantity", "l_extendedprice"))

    def numbered(kind):
        key = [F.col(c).cast(kind) for c in names]
        return (((key[0] * 100_000 + key[1]) * 100_000 + key[2]) * 10 + key[3]) * 10

    largest = F.max(F.abs(numbered("decimal(20,0)"))) + F.count(F.lit(1))
    fits = lines.agg(F.coalesce(largest <= 2**63 - 1, F.lit(True)).alias("fits")).first().fits
    rows = lines.withColumn("row", numbered("bigint" if fits else "decimal(20,0)") + copy).select(
        F.col("l_suppkey").cast("string").alias("kapt_code"), F.col("l_quantity").cast("string").alias("area_group_id"),
        F.lit(None).cast("double").alias("exclusive_area_sqm"), "row",
        day.alias("valid_from"), F.date_add(day, F.col("l_linenumber") * 2).alias("valid_to"),
    )
    return valuation.overlapping_rows(rows).select("row", "kapt_code")


_ESTIMATE = f"""{_prices(3)}, {_ISSUES},
bad AS MATERIALIZED (SELECT DISTINCT kapt_code FROM issues),
active AS MATERIALIZED (SELECT t.month, t.vm, m.*, last_day(CAST(t.month || '-01' AS DATE)) AS month_end FROM area_register m, targets t
    WHERE (valid_from IS NULL OR valid_from <= last_day(CAST(t.month || '-01' AS DATE))) AND (valid_to IS NULL OR valid_to >= last_day(CAST(t.month || '-01' AS DATE)))),
local0 AS (SELECT a.month, a.kapt_code, a.area_group_id, a.exclusive_area_sqm, a.households,
        v.approval_date <= a.month_end AS existing, p.* EXCLUDE (month, kapt_code, area_sqm)
    FROM active a JOIN valued v USING (kapt_code) LEFT JOIN prices p ON p.month = a.month AND p.kapt_code = a.kapt_code AND p.area_sqm = a.exclusive_area_sqm
    WHERE a.verification_status = 'verified' AND a.kapt_code NOT IN (SELECT kapt_code FROM bad)),
local1 AS (SELECT * REPLACE (CASE WHEN existing THEN price_krw END AS price_krw, CASE WHEN existing THEN price_1m_krw END AS price_1m_krw),
        CASE WHEN NOT existing THEN 'not_existing' WHEN price_krw IS NULL THEN 'unavailable' WHEN small_sample THEN 'small_sample'
            ELSE 'median_' || window_months || 'm' END AS method FROM local0),
covered AS MATERIALIZED (SELECT *, sum(CASE WHEN price_krw IS NOT NULL THEN households ELSE 0 END) OVER (PARTITION BY month, kapt_code) AS ph,
    sum(households) OVER (PARTITION BY month, kapt_code) AS ah FROM local1),
donors AS (SELECT month, kapt_code, exclusive_area_sqm AS da, area_group_id AS dg, price_krw / exclusive_area_sqm AS unit FROM covered WHERE price_krw IS NOT NULL),
nearest AS (SELECT c.month, c.kapt_code, c.exclusive_area_sqm, unit FROM covered c JOIN donors d ON c.month = d.month AND c.kapt_code = d.kapt_code
    WHERE c.price_krw IS NULL AND CAST(c.kapt_code AS BIGINT) % 7 = 0 AND ph > 0 AND ph / ah >= {COVERAGE}
    QUALIFY row_number() OVER (PARTITION BY c.month, c.kapt_code, c.exclusive_area_sqm ORDER BY abs(da - c.exclusive_area_sqm), dg) = 1),
detail AS MATERIALIZED (SELECT c.month, c.kapt_code, c.area_group_id, c.exclusive_area_sqm, c.households, price_1m_krw, coalesce(small_sample_1m, true) AS small_sample_1m,
    coalesce(c.price_krw, round_even(n.unit * c.exclusive_area_sqm, 0)) AS price_krw,
    CASE WHEN n.unit IS NOT NULL THEN 'nearest_exclusive_area_unit_price' ELSE method END AS method,
    CASE WHEN n.unit IS NOT NULL THEN 12 ELSE window_months END AS window_months,
    CASE WHEN n.unit IS NOT NULL THEN true ELSE coalesce(small_sample, false) END AS small_sample
    FROM covered c LEFT JOIN nearest n USING (month, kapt_code, exclusive_area_sqm))"""
_TOTALS = f"""{_ESTIMATE},
composition AS (SELECT month, kapt_code, count(*) AS n, sum(households) AS ah, bool_and(verification_status = 'verified') AS verified FROM active GROUP BY 1, 2),
worth AS (SELECT month, kapt_code, sum(households) AS confirmed, sum(CASE WHEN price_krw IS NOT NULL THEN households ELSE 0 END) AS priced,
    sum(households * price_krw) AS partial, max(CASE WHEN price_krw IS NOT NULL THEN window_months END) AS w,
    bool_or(price_krw IS NOT NULL AND small_sample) AS small, bool_and(price_1m_krw IS NOT NULL) AS one, sum(households * price_1m_krw) AS cap1,
    sum(CASE WHEN price_krw IS NOT NULL AND window_months = 3 THEN households ELSE 0 END) AS w3 FROM detail GROUP BY 1, 2),
judged AS (SELECT t.month, v.kapt_code, v.complex_name, v.households, coalesce(w.confirmed, 0) AS confirmed_households, coalesce(w.priced, 0) AS priced_households,
    w.partial AS partial_cap_krw, w.w, w.small, w.one, w.cap1, coalesce(w.w3, 0) / nullif(v.households, 0) AS share_3m,
    concat_ws('; ', CASE WHEN v.approval_date IS NULL THEN '준공·입주 시점 미확인' END,
        CASE WHEN v.approval_date > last_day(CAST(t.month || '-01' AS DATE)) THEN '준공 전' END,
        CASE WHEN coalesce(c.n, 0) = 0 THEN '평형별 세대수 보완 필요' END,
        CASE WHEN c.n > 0 AND v.kapt_code IN (SELECT kapt_code FROM bad) THEN '평형 마스터 검증 오류' END,
        CASE WHEN c.n > 0 AND c.ah IS DISTINCT FROM v.households THEN '평형 세대수 합계 불일치' END,
        CASE WHEN c.n > 0 AND NOT c.verified THEN '평형 세대수 미검증' END,
        CASE WHEN v.sale_type <> '분양' AND NOT (CAST(v.kapt_code AS BIGINT) % 7 = 0) THEN '임대·혼합단지 분양 세대수 미확인' END,
        CASE WHEN v.building_type NOT IN ('아파트', '주상복합') THEN '아파트 주거용 미확인' END,
        CASE WHEN coalesce(w.priced, 0) < coalesce(w.confirmed, 0) THEN '일부 평형 시세 미확보' END) AS reason
    FROM valued v CROSS JOIN targets t LEFT JOIN composition c ON c.month = t.month AND c.kapt_code = v.kapt_code
    LEFT JOIN worth w ON w.month = t.month AND w.kapt_code = v.kapt_code),
totals AS (SELECT *, reason = '' AND priced_households = households AS complete,
    CASE WHEN NOT (reason = '' AND priced_households = households) THEN '산정 불완전' WHEN small THEN 'D' WHEN w = 3 THEN 'A' WHEN w = 6 THEN 'B' ELSE 'C' END AS grade,
    CASE WHEN reason = '' AND priced_households = households THEN partial_cap_krw END AS market_cap_krw FROM judged)"""


def estimated(spark, folder, provider=prices.MEDIAN, stored=None):
    return valuation.estimate(
        materialise(a.valued_complexes(spark, folder), "valued"), materialise(a.area_register(spark, folder), "area-register"),
        eligible(spark, folder), all_months(spark, folder), approved=approved_rule(), extrapolation_coverage=COVERAGE, provider=provider, stored=stored,
    )


@query(
    "valued_types",
    a.with_views("live", "valued") + f""", {_ESTIMATE} SELECT month, kapt_code, area_group_id, {rounds('price_krw', 'price_1m_krw')}, method,
    window_months::BIGINT AS window_months, small_sample, round(households * price_krw + 0.00000001, 4) AS contribution_krw FROM detail""",
)
def valued_types(spark, folder):
    _, detail = estimated(spark, folder)
    detail = settle(detail, "month", "kapt_code", "area_group_id", "price_krw", "price_1m_krw", "method", "window_months", "small_sample", "contribution_krw")
    return detail.withColumn("contribution_krw", F.round("contribution_krw", 4))


_CAP = ["month", "kapt_code", "households", "confirmed_households", "priced_households", "partial_cap_krw", "market_cap_krw", "share_3m", "grade", "reason"]


@query(
    "market_values",
    a.with_views("live", "valued") + f""", {_TOTALS} SELECT month, kapt_code, grade, reason,
    {rounds('households', 'confirmed_households', 'priced_households', 'partial_cap_krw', 'market_cap_krw', 'share_3m', scale=4)} FROM totals""",
)
def market_values(spark, folder):
    return settle(estimated(spark, folder)[0], *_CAP, scale=4)


@query(
    "trimmed_market_values",
    a.with_views("live", "valued") + f""", {_TOTALS.replace(_prices(3), _prices(3, _trimmed))} SELECT month, kapt_code, grade, reason,
    {rounds('priced_households', 'partial_cap_krw', 'market_cap_krw', scale=4)} FROM totals""",
)
def trimmed_market_values(spark, folder):
    """Market values by the second price provider."""
    totals, _ = estimated(spark, folder, prices.trimmed_mean(0.1))
    return settle(totals, "month", "kapt_code", "grade", "reason", "priced_households", "partial_cap_krw", "market_cap_krw", scale=4)


@query(
    "grade_counts",
    a.with_views("live", "valued") + f", {_TOTALS} SELECT month, grade, count(*) AS complex_count FROM totals GROUP BY 1, 2",
)
def grade_counts(spark, folder):
    return estimated(spark, folder)[0].groupBy("month", "grade").agg(F.count(F.lit(1)).alias("complex_count"))


@query(
    "value_coverage",
    a.with_views("live", "valued") + f""", {_TOTALS} SELECT count(*) AS target_complexes, count(market_cap_krw) AS complete_complexes,
    count(*) FILTER (confirmed_households < households) AS missing_households, count(*) FILTER (priced_households < confirmed_households) AS missing_price,
    round(sum(market_cap_krw), 2) AS total_cap_krw FROM totals""",
)
def value_coverage(spark, folder):
    return settle(valuation.coverage_figures(estimated(spark, folder)[0]), scale=2)


@query(
    "supplement_needed",
    a.with_views("live", "valued") + f", {_TOTALS} SELECT kapt_code, reason FROM totals WHERE month = (SELECT max(month) FROM totals) AND grade = '산정 불완전'",
)
def supplement_needed(spark, folder):
    totals = estimated(spark, folder)[0].select("month", "kapt_code", "grade", "reason")
    return valuation.supplement_needed(materialise(totals, "totals")).select("kapt_code", "reason")


@query("area_register_template", "SELECT CAST(s_suppkey AS VARCHAR) AS kapt_code, '' AS area_group_id, 'pending' AS verification_status, 'unknown' AS scope, s_name AS notes FROM supplier")
def area_register_template(spark, folder):
    rows = valuation.area_register_template(a.master(spark, folder))
    return rows.select("kapt_code", "area_group_id", "verification_status", "scope", "notes")


@query(
    "contribution_shares",
    a.with_views("live", "valued") + f""", {_ESTIMATE} SELECT month, kapt_code, area_group_id,
    round(households * price_krw / nullif(sum(households * price_krw) OVER (PARTITION BY month, kapt_code), 0) + 0.00000001, 6) AS contribution_share,
    round((price_1m_krw / nullif(price_krw, 0) - 1) * 100 + 0.00000001, 6) AS price_1m_diff_pct FROM detail""",
)
def contribution_shares(spark, folder):
    _, detail = estimated(spark, folder)
    return settle(valuation.contribution_shares(detail), "month", "kapt_code", "area_group_id", "contribution_share", "price_1m_diff_pct")


def _sensitivity(minimum: int) -> str:
    """Grade counts for one minimum, as a select over renamed views."""
    body = _TOTALS.replace(_prices(3), _prices(minimum)).replace("coalesce(c.price_krw, round_even(n.unit * c.exclusive_area_sqm, 0))", "c.price_krw")
    body = body.replace("CAST(c.kapt_code AS BIGINT) % 7 = 0", "FALSE").replace("NOT (CAST(v.kapt_code AS BIGINT) % 7 = 0)", "TRUE")
    return a.with_views("live", "valued") + f", {body} SELECT * FROM totals WHERE month = '2001-06'"


@query(
    "grade_sensitivity",
    " UNION ALL ".join(
        f"""SELECT {m}::BIGINT AS minimum_transactions, count(*) FILTER (grade = 'A') AS "A", count(*) FILTER (grade = 'B') AS "B",
        count(*) FILTER (grade = 'C') AS "C", count(*) FILTER (grade = 'D') AS "D", count(*) FILTER (grade = '산정 불완전') AS "산정 불완전"
        FROM ({_sensitivity(m)})"""
        for m in (2, 3, 5)
    ),
)
def grade_sensitivity(spark, folder):
    df = valuation.sensitivity(
        materialise(a.valued_complexes(spark, folder), "valued"), materialise(a.area_register(spark, folder), "area-register"), eligible(spark, folder), "2001-06"
    )
    return settle(df)


@query(
    "used_contracts",
    a.with_views("live", "valued") + f""", {_ESTIMATE}, used AS (SELECT d.month, l.kapt_code, l.area_sqm, l.deal_amount_krw, l.source_row_id,
        median(l.deal_amount_krw) OVER (PARTITION BY d.month, l.kapt_code, l.area_sqm) AS med
        FROM (SELECT DISTINCT month, kapt_code, exclusive_area_sqm FROM detail WHERE method LIKE 'median%' OR method = 'small_sample'
            OR (method LIKE 'nearest%' AND FALSE)) d
        JOIN prices p ON p.month = d.month AND p.kapt_code = d.kapt_code AND p.area_sqm = d.exclusive_area_sqm
        JOIN targets t ON t.month = d.month JOIN live l ON l.kapt_code = d.kapt_code AND l.area_sqm = d.exclusive_area_sqm AND t.vm - l.midx BETWEEN 0 AND p.window_months - 1)
    SELECT month, kapt_code, count(*) AS contract_count, count(*) FILTER (deal_amount_krw < med * 0.5 OR deal_amount_krw > med * 2) AS unusual_count
    FROM used GROUP BY 1, 2""",
)
def used_contracts(spark, folder):
    _, detail = estimated(spark, folder)
    used = valuation.used_contracts(detail, eligible(spark, folder))
    return used.groupBy("month", "kapt_code").agg(F.count(F.lit(1)).alias("contract_count"), F.count_if("unusual_price").alias("unusual_count"))


@query(
    "unusual_prices",
    a.with_views("live") + """SELECT kapt_code, area_sqm, source_row_id, deal_amount_krw FROM live
    QUALIFY deal_amount_krw < 0.5 * median(deal_amount_krw) OVER (PARTITION BY kapt_code, area_sqm)
        OR deal_amount_krw > 2 * median(deal_amount_krw) OVER (PARTITION BY kapt_code, area_sqm)""",
)
def unusual_prices(spark, folder):
    rows = valuation.flag_unusual_prices(a.live_sales(spark, folder))
    return rows.where("unusual_price").select("kapt_code", "area_sqm", "source_row_id", "deal_amount_krw")


# What stands behind a value ----------------------------------------------------------------

_ENTRY = "concat_ws('|', area_group_id, CAST(exclusive_area_sqm AS VARCHAR), CAST(households AS VARCHAR), verification_status, 'sale_apartment', coalesce(CAST(valid_from AS VARCHAR), ''), coalesce(CAST(valid_to AS VARCHAR), ''))"


@query(
    "composition_traces",
    a.with_views("area_register", "live") + f""", rows AS (SELECT month, CAST(substr(month, 1, 4) AS INTEGER) * 12 + CAST(substr(month, 6, 2) AS INTEGER) AS m, kapt_code, {_ENTRY} AS entry FROM area_register, {_MONTHS}
        WHERE (valid_from IS NULL OR valid_from <= last_day(CAST(month || '-01' AS DATE))) AND (valid_to IS NULL OR valid_to >= last_day(CAST(month || '-01' AS DATE)))),
    lists AS (SELECT month, m, kapt_code, list(entry ORDER BY entry) AS entries FROM rows GROUP BY 1, 2, 3)
    SELECT x.month, x.kapt_code, len(x.entries) AS entry_count, CAST(to_json(x.entries) AS VARCHAR) AS entries,
        CASE WHEN y.entries IS NULL THEN 'new' WHEN y.entries = x.entries THEN 'equal' ELSE 'changed' END AS compared_with_month_before
    FROM lists x LEFT JOIN lists y ON y.kapt_code = x.kapt_code AND y.m = x.m - 1""",
)
def composition_traces(spark, folder):
    """The types of every complex and month, compared with the month before by digest alone.

    Entries are listed once per span of months with the same types; months unfold last.
    """
    rows = valuation.active_spans(a.area_register(spark, folder), all_months(spark, folder))
    found = materialise(traces.traces(rows, ["_months", "kapt_code"], traces.composition_entry()), "compositions")
    traces.require_sound_digests(found)
    found = found.withColumn("_first", F.array_min("_months"))
    before = found.select((F.array_max("_months") + 1).alias("_first"), "kapt_code", F.col("digest").alias("_before")).distinct()
    listed = F.col("kapt_code").isNotNull() & F.array_contains("_months", F.col("_vm") - 1)
    told = F.when(listed, "equal").when((F.col("_vm") > F.col("_first")) | F.col("_before").isNull(), "new")
    told = told.when(F.col("_before") == F.col("digest"), "equal").otherwise("changed")
    out = found.join(before, ["_first", "kapt_code"], "left").withColumn("_vm", F.explode("_months"))
    out = out.withColumns({"month": months.index_to_label(F.col("_vm")), "compared_with_month_before": told})
    return out.select("month", "kapt_code", "entry_count", "entries", "compared_with_month_before")


@query(
    "method_signatures",
    a.with_views("live", "valued") + f""", {_ESTIMATE} SELECT month, kapt_code, CAST(to_json(list(area_group_id || '|' || method ORDER BY area_group_id || '|' || method)) AS VARCHAR) AS entries
    FROM detail GROUP BY 1, 2""",
)
def method_signatures(spark, folder):
    """How every type was priced, as the list behind ``method_signature``."""
    found = materialise(traces.traces(estimated(spark, folder, stored=())[1], ["month", "kapt_code"], traces.method_entry()), "methods")
    traces.require_sound_digests(found)
    return found.select("month", "kapt_code", "entries")


@query(
    "used_contract_ids",
    a.with_views("live", "valued") + f""", {_ESTIMATE} SELECT d.month, l.kapt_code, l.area_sqm, count(*) AS entry_count, CAST(to_json(list(CAST(l.source_row_id AS VARCHAR) ORDER BY CAST(l.source_row_id AS VARCHAR))) AS VARCHAR) AS entries
    FROM (SELECT DISTINCT month, kapt_code, exclusive_area_sqm FROM detail WHERE method LIKE 'median%' OR method = 'small_sample') d
    JOIN prices p ON p.month = d.month AND p.kapt_code = d.kapt_code AND p.area_sqm = d.exclusive_area_sqm
    JOIN targets t ON t.month = d.month JOIN live l ON l.kapt_code = d.kapt_code AND l.area_sqm = d.exclusive_area_sqm AND t.vm - l.midx BETWEEN 0 AND p.window_months - 1 GROUP BY 1, 2, 3""",
)
def used_contract_ids(spark, folder):
    """The ids of the contracts behind every priced area and month, as lists."""
    used = valuation.used_contracts(estimated(spark, folder)[1], eligible(spark, folder))
    return traces.traces(used, ["month", "kapt_code", "area_sqm"], F.col("source_row_id")).select("month", "kapt_code", "area_sqm", "entry_count", "entries")


# Rank history ---------------------------------------------------------------------------

_RANKED = a.with_views("history") + """, chosen AS (SELECT * FROM history WHERE grade IN ('A', 'B') AND households >= 500 AND market_cap_krw IS NOT NULL),
ranked AS (SELECT *, rank() OVER (PARTITION BY month ORDER BY market_cap_krw DESC) AS rank,
    rank() OVER (PARTITION BY month, sigungu ORDER BY market_cap_krw DESC) AS district_rank,
    rank() OVER (PARTITION BY month ORDER BY per_household_krw DESC) AS household_value_rank FROM chosen),
paired AS (SELECT c.*, p.market_cap_krw AS pcap, p.rank AS prank, p.rules_hash AS prules, p.composition_hash AS pcomp, p.method_signature AS pmeth,
    y.market_cap_krw AS ycap, y.rules_hash AS yrules, coalesce(p.rules_hash = c.rules_hash, false) AS same,
    c.midx - 1 IN (SELECT midx FROM history) AS has_any
    FROM ranked c LEFT JOIN ranked p ON p.kapt_code = c.kapt_code AND p.midx = c.midx - 1 LEFT JOIN ranked y ON y.kapt_code = c.kapt_code AND y.midx = c.midx - 12),
common AS (SELECT month, kapt_code, rank() OVER (PARTITION BY month ORDER BY market_cap_krw DESC) AS common_rank,
    rank() OVER (PARTITION BY month ORDER BY pcap DESC) AS before FROM paired WHERE same),
history_ranks AS (SELECT paired.*, common_rank, before - common_rank AS common_rank_change,
    CASE WHEN same THEN market_cap_krw - pcap END AS mom_krw, CASE WHEN same THEN (market_cap_krw / pcap - 1) * 100 END AS mom_pct,
    CASE WHEN yrules = rules_hash THEN (market_cap_krw / ycap - 1) * 100 END AS yoy_pct, CASE WHEN same THEN prank - rank END AS rank_change,
    CASE WHEN same THEN '비교 가능' WHEN prank IS NOT NULL THEN '규칙 변경: 비교 불가' WHEN has_any THEN '신규' ELSE '비교 불가' END AS comparison_status,
    CASE WHEN same THEN concat_ws('; ', CASE WHEN composition_hash <> pcomp THEN '평형 구성/세대수 자료 변경' END,
        CASE WHEN method_signature <> pmeth THEN '가격 산정 기간 전환' END) ELSE '' END AS change_flags
    FROM paired LEFT JOIN common USING (month, kapt_code))
"""
_RANKS = ["rank", "district_rank", "household_value_rank"]


def ranked_history(spark, folder):
    return valuation.rank_history(materialise(a.monthly_history(spark, folder), "history"))


@query("monthly_ranks", _RANKED + "SELECT month, kapt_code, sigungu, market_cap_krw, rank, district_rank, household_value_rank FROM history_ranks")
def monthly_ranks(spark, folder):
    return settle(ranked_history(spark, folder), "month", "kapt_code", "sigungu", "market_cap_krw", *_RANKS)


@query(
    "month_comparison",
    _RANKED + f"SELECT month, kapt_code, {rounds('mom_krw', 'mom_pct', 'yoy_pct')}, CAST(rank_change AS BIGINT) AS rank_change FROM history_ranks",
)
def month_comparison(spark, folder):
    return settle(ranked_history(spark, folder), "month", "kapt_code", "mom_krw", "mom_pct", "yoy_pct", "rank_change")


@query("common_ranks", _RANKED + "SELECT month, kapt_code, common_rank, CAST(common_rank_change AS BIGINT) AS common_rank_change FROM history_ranks")
def common_ranks(spark, folder):
    return settle(ranked_history(spark, folder), "month", "kapt_code", "common_rank", "common_rank_change")


@query("comparison_status", _RANKED + "SELECT month, kapt_code, comparison_status, change_flags FROM history_ranks")
def comparison_status(spark, folder):
    return settle(ranked_history(spark, folder), "month", "kapt_code", "comparison_status", "change_flags")


@query(
    "top_values",
    _RANKED + "SELECT month, kapt_code, rank, market_cap_krw FROM history_ranks WHERE month = (SELECT max(month) FROM history_ranks) ORDER BY rank, kapt_code LIMIT 10",
)
def top_values(spark, folder):
    return settle(valuation.top_of_month(ranked_history(spark, folder), 10), "month", "kapt_code", "rank", "market_cap_krw")


@query(
    "common_base_index",
    a.with_views("history") + f""", rows AS (SELECT month, kapt_code, market_cap_krw FROM history WHERE kapt_code IN ('1', '2', '3') AND market_cap_krw IS NOT NULL),
    base AS (SELECT min(month) AS m FROM (SELECT month FROM rows GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT kapt_code) FROM rows)))
    SELECT r.month, r.kapt_code, b.month AS base_month, round(r.market_cap_krw / b.market_cap_krw * 100 + 0.00000001, 6) AS index_value
    FROM rows r JOIN rows b ON r.kapt_code = b.kapt_code AND b.month = (SELECT m FROM base) WHERE r.month >= b.month""",
)
def common_base_index(spark, folder):
    return settle(valuation.common_base_index(a.monthly_history(spark, folder), ["1", "2", "3"]), "month", "kapt_code", "base_month", "index_value")


@query(
    "tie_out",
    a.with_views("live", "valued") + f""", {_TOTALS} SELECT t.month, t.kapt_code FROM totals t LEFT JOIN (SELECT month, kapt_code, sum(households * price_krw) AS s FROM detail GROUP BY 1, 2) d
    USING (month, kapt_code) WHERE market_cap_krw IS NOT NULL AND (s IS NULL OR abs(market_cap_krw + CASE WHEN CAST(t.kapt_code AS BIGINT) % 2 = 0 THEN 5 ELSE 0 END - s) > 1)""",
)
def tie_out(spark, folder):
    """Complexes and months whose stored value was shifted and no longer equals the sum of its types."""
    totals, detail = estimated(spark, folder, stored=())
    shift = F.when(F.col("kapt_code").cast("long") % 2 == 0, 5).otherwise(0)
    totals = totals.withColumn("adjusted_market_cap_krw", F.col("market_cap_krw") + shift)
    detail = detail.withColumn("adjusted_contribution_krw", F.col("contribution_krw"))
    return valuation.tie_out(totals, detail, keys=("month", "kapt_code")).select("month", "kapt_code")


_VALUED_HISTORY = a.with_views("live", "valued") + f""", {_TOTALS},
compositions AS (SELECT month, kapt_code, CAST(list({_ENTRY} ORDER BY {_ENTRY}) AS VARCHAR) AS composition_hash FROM active GROUP BY 1, 2),
signatures AS (SELECT month, kapt_code, CAST(list(area_group_id || '|' || method ORDER BY area_group_id || '|' || method) AS VARCHAR) AS method_signature FROM detail GROUP BY 1, 2),
history AS (SELECT t.month, CAST(substr(t.month, 1, 4) AS INTEGER) * 12 + CAST(substr(t.month, 6, 2) AS INTEGER) - 1 AS midx, t.kapt_code, v.sigungu, t.households, t.market_cap_krw,
    t.market_cap_krw / nullif(t.priced_households, 0) AS per_household_krw, t.grade, 'rules' AS rules_hash, composition_hash, method_signature
    FROM totals t JOIN valued v USING (kapt_code) LEFT JOIN compositions USING (month, kapt_code) LEFT JOIN signatures USING (month, kapt_code))
""" + _RANKED[len(a.with_views("history")):].replace("grade IN ('A', 'B') AND households >= 500", "grade IN ('A', 'B', 'C', 'D')")


@query(
    "valued_rank_history",
    _VALUED_HISTORY + f"""SELECT month, kapt_code, rank, district_rank, household_value_rank, {rounds('mom_krw', 'mom_pct', 'yoy_pct', scale=4)}, CAST(rank_change AS BIGINT) AS rank_change,
    common_rank, CAST(common_rank_change AS BIGINT) AS common_rank_change, comparison_status, change_flags FROM history_ranks""",
)
def valued_rank_history(spark, folder):
    """Rank history over the market values themselves, with changed compositions and price windows told."""
    totals = materialise(estimated(spark, folder)[0].withColumn("rules_hash", F.lit("rules")), "history")
    out = valuation.rank_history(totals, ("A", "B", "C", "D"), 0)
    return settle(out, "month", "kapt_code", *_RANKS, "mom_krw", "mom_pct", "yoy_pct", "rank_change", "common_rank", "common_rank_change", "comparison_status", "change_flags", scale=4)


# External prices ------------------------------------------------------------------------


def external_prices(spark, folder):
    """Collected prices of area types: some missing, reversed or undated."""
    t = a.area_register(spark, folder)
    k, q = F.col("kapt_code").cast("long"), (F.col("row") % 100)
    price = F.when((k + q) % 6 != 0, 1000 + (k * 13 + q * 17) % 9000)
    return t.select(
        "kapt_code", "exclusive_area_sqm", "supply_area_sqm", "type_name", F.when((k + q) % 17 == 0, F.col("households") + 1).otherwise(F.col("households")).alias("households"),
        F.concat(F.lit("c"), "kapt_code").alias("kb_complex_id"), F.col("area_group_id").alias("kb_type_id"), F.lit("").alias("kb_url"),
        F.when((k + q) % 13 != 0, F.lit("2001-06-15")).otherwise("").alias("collected_at"), F.lit("2001-06-15").alias("kb_price_date"),
        price.cast("double").alias("kb_sale_general"), F.when((k + q) % 11 == 0, price + 1).otherwise(price).cast("double").alias("kb_sale_lower"), price.cast("double").alias("kb_sale_upper"),
    )


_KB = """kb AS (SELECT kapt_code, area_group_id, exclusive_area_sqm, supply_area_sqm, type_name, valid_from, valid_to, verification_status, row, households,
    CAST(kapt_code AS BIGINT) AS k, row % 100 AS q FROM area_register),
offers AS (SELECT *, CASE WHEN (k + q) % 17 = 0 THEN households + 1 ELSE households END AS offered, 'c' || kapt_code AS kb_complex_id,
    replace(area_group_id, '-copy', '') AS kb_type_id, CASE WHEN (k + q) % 6 <> 0 THEN 1000 + (k * 13 + q * 17) % 9000 END AS price FROM kb),
linked AS (SELECT o.* EXCLUDE (kb_complex_id, kb_type_id), offered = households AS hit,
    CASE WHEN offered = households THEN kb_complex_id ELSE '' END AS kb_complex_id, CASE WHEN offered = households THEN kb_type_id ELSE '' END AS kb_type_id FROM offers o),
reasoned AS (SELECT *, CASE WHEN kb_type_id <> '' AND count(*) OVER (PARTITION BY kb_complex_id, kb_type_id) > 1 THEN 'KB 타입 중복 연결'
    WHEN NOT hit THEN 'KB 타입 연결 미확인' WHEN price IS NULL THEN 'KB 일반매매가 미확보' WHEN (k + q) % 11 = 0 THEN 'KB 하위·일반·상위 가격 역전'
    WHEN (k + q) % 13 = 0 THEN 'KB 수집일 미확인' WHEN DATE '2001-06-15' < valid_from OR DATE '2001-06-15' > valid_to THEN '평형 구성 적용 기간 밖 시세' ELSE '' END AS price_reason FROM linked),
priced AS (SELECT *, CASE WHEN price_reason = '' THEN price * 10000.0 END AS price_krw FROM reasoned)"""


_KB_COPIES = _KB.replace("FROM area_register)", "FROM (SELECT * FROM area_register UNION ALL SELECT * REPLACE (area_group_id || '-copy' AS area_group_id) FROM area_register WHERE row % 12 = 0))")


def linked_prices(spark, folder):
    return pricing.link_prices(a.area_register(spark, folder), external_prices(spark, folder))


def linked_with_copies(spark, folder):
    """Some types are registered twice and would use the same external type."""
    types = a.area_register(spark, folder)
    copies = types.where(F.col("row") % 12 == 0).withColumn("area_group_id", F.concat("area_group_id", F.lit("-copy")))
    return pricing.link_prices(types.unionByName(copies), external_prices(spark, folder))


@query("linked_prices", a.with_views("area_register") + f", {_KB_COPIES} SELECT kapt_code, area_group_id, kb_type_id, price_reason, {rounds('price_krw')} FROM priced")
def linked_prices_query(spark, folder):
    return settle(linked_with_copies(spark, folder), "kapt_code", "area_group_id", "kb_type_id", "price_reason", "price_krw")


@query(
    "reused_external_types",
    a.with_views("area_register") + f", {_KB_COPIES} SELECT kapt_code, kb_type_id, count(*) AS uses FROM priced WHERE kb_type_id <> '' GROUP BY 1, 2 HAVING count(*) > 1",
)
def reused_external_types(spark, folder):
    rows = pricing.reused_types(linked_with_copies(spark, folder))
    return rows.groupBy("kapt_code", "kb_type_id").agg(F.max("uses").alias("uses"))


def _facts(spark, folder):
    """Status and sale splits of complexes derived from the register."""
    m = a.valued_complexes(spark, folder)
    k = F.col("kapt_code").cast("long")
    status = m.select("kapt_code", F.when(k % 37 == 0, "EXCLUDED_RENTAL_ONLY").otherwise("APPROVED").alias("final_status"))
    splits = m.where(k % 19 == 0).select(
        "kapt_code", F.lit("OFFICIALLY_SUPPORTED").alias("split_validity"), F.col("households").alias("sale_households"),
        F.col("households").alias("kapt_households"), F.lit(0.0).alias("rental_households_excluded"),
    )
    return m, status, splits


_KB_TOTALS = f"""{_KB},
sums AS (SELECT kapt_code, count(*) AS n, sum(households) AS confirmed, sum(CASE WHEN price_krw IS NOT NULL THEN households END) AS priced_h,
    sum(households * price_krw) AS partial, count(*) FILTER (price_krw IS NULL) AS unpriced, bool_and(verification_status = 'verified') AS sound,
    bool_or(hit AND (k + q) % 13 <> 0) AS dated FROM priced GROUP BY 1),
kb_totals AS (SELECT v.kapt_code, v.sigungu, v.households, coalesce(priced_h, 0) AS priced_households, partial AS partial_cap_krw,
    concat_ws('; ', CASE WHEN n IS NULL THEN CASE WHEN CAST(v.kapt_code AS BIGINT) % 37 = 0 THEN '임대 전용 제외' ELSE '평형별 세대수 보완 필요' END END,
        CASE WHEN n > 0 AND confirmed IS DISTINCT FROM v.households THEN '평형 세대수 합계 불일치' END,
        CASE WHEN v.sale_type <> '분양' AND NOT (CAST(v.kapt_code AS BIGINT) % 19 = 0 AND coalesce(confirmed = v.households, v.households = 0)) THEN '임대·혼합 분양 범위 확인 필요' END,
        CASE WHEN v.building_type NOT IN ('아파트', '주상복합') THEN '아파트 주거 범위 미확인' END,
        CASE WHEN n > 0 AND NOT sound THEN '평형 마스터 미검증' END,
        CASE WHEN v.approval_date > DATE '2001-06-15' AND dated THEN '준공·입주 시점 확인 필요' END,
        CASE WHEN unpriced > 0 THEN 'KB 시세 또는 타입 연결 부족' END) AS reason, n
    FROM valued v LEFT JOIN sums USING (kapt_code)),
kb_done AS (SELECT *, reason = '' AND households > 0 AND coalesce(n, 0) > 0 AS complete FROM kb_totals)"""


@query(
    "external_values",
    a.with_views("valued") + f""", {_KB_TOTALS} SELECT kapt_code, reason, CASE WHEN complete THEN '산정 완료' ELSE '산정 불완전' END AS status,
    round(priced_households + 0.00000001, 4) AS priced_households, round(partial_cap_krw + 0.00000001, 4) AS partial_cap_krw FROM kb_done""",
)
def external_values(spark, folder):
    m, status, splits = _facts(spark, folder)
    df = pricing.estimate_external(materialise(m, "valued"), materialise(linked_prices(spark, folder), "linked"), status, splits)
    return settle(df, "kapt_code", "reason", "status", "priced_households", "partial_cap_krw", scale=4)


@query(
    "external_ranks",
    a.with_views("valued") + f""", {_KB_TOTALS} SELECT kapt_code, CASE WHEN partial_cap_krw IS NOT NULL THEN rank() OVER (ORDER BY partial_cap_krw DESC NULLS LAST) END AS rank,
    CASE WHEN partial_cap_krw IS NOT NULL THEN rank() OVER (PARTITION BY sigungu ORDER BY partial_cap_krw DESC NULLS LAST) END AS district_rank FROM kb_done""",
)
def external_ranks(spark, folder):
    m, status, splits = _facts(spark, folder)
    totals = pricing.estimate_external(materialise(m, "valued"), materialise(linked_prices(spark, folder), "linked"), status, splits)
    return settle(pricing.rank_external(materialise(totals, "totals"), "partial_cap_krw"), "kapt_code", "rank", "district_rank")


def adjusted(spark, folder):
    """Adjust complexes divisible by four with a policy that agrees on their households."""
    m, status, splits = _facts(spark, folder)
    detail = materialise(linked_prices(spark, folder), "linked")
    totals = materialise(pricing.estimate_external(materialise(m, "valued"), detail, status, splits), "totals")
    k = F.col("kapt_code").cast("long")
    policy = m.where(k % 4 == 0).select(
        "kapt_code", "households", F.lit("whole").alias("scope"), F.lit("policy").alias("source"), F.lit(None).cast("string").alias("price_method"),
        F.create_map(F.lit("g6"), F.lit(7_000_000.0)).alias("overrides"),
    )
    return pricing.adjust(totals, detail, policy)


_ADJUST = f"""{_KB_TOTALS},
fit AS (SELECT t.kapt_code FROM kb_totals t JOIN sums s USING (kapt_code) WHERE CAST(t.kapt_code AS BIGINT) % 4 = 0 AND s.sound AND s.confirmed = t.households
    AND len(list_filter(string_split(reason, '; '), lambda r: r NOT IN ('', '임대·혼합 분양 범위 확인 필요', 'KB 시세 또는 타입 연결 부족'))) = 0),
wanting AS (SELECT p.*, CASE WHEN area_group_id = 'g6' THEN 7000000.0 END AS override FROM priced p JOIN fit USING (kapt_code) WHERE price_reason = 'KB 일반매매가 미확보'),
donor AS (SELECT kapt_code, kb_complex_id, exclusive_area_sqm AS da, sum(price_krw / exclusive_area_sqm * households) / nullif(sum(households), 0) AS unit
    FROM priced JOIN fit USING (kapt_code) WHERE price_krw IS NOT NULL GROUP BY 1, 2, 3),
picked AS (SELECT w.kapt_code, w.area_group_id, unit FROM wanting w JOIN donor d ON w.kapt_code = d.kapt_code AND w.kb_complex_id = d.kb_complex_id
    WHERE w.override IS NULL AND (k + q) % 13 <> 0 AND (w.valid_from IS NULL OR DATE '2001-06-15' >= w.valid_from) AND (w.valid_to IS NULL OR DATE '2001-06-15' <= w.valid_to)
    QUALIFY row_number() OVER (PARTITION BY w.kapt_code, w.area_group_id ORDER BY da > w.exclusive_area_sqm, CASE WHEN da <= w.exclusive_area_sqm THEN -da ELSE da END) = 1),
adjusted AS (SELECT p.kapt_code, p.area_group_id, p.households, coalesce(p.price_krw, w.override, round_even(k.unit * p.exclusive_area_sqm, 0)) AS adjusted_price_krw,
    CASE WHEN p.price_krw IS NOT NULL THEN 'KB 일반매매가' WHEN w.override IS NOT NULL THEN '승인된 외부 가격 보정' WHEN k.unit IS NOT NULL THEN '하위 평형단가 기준 보정' ELSE '미산정' END AS price_method
    FROM priced p LEFT JOIN wanting w USING (kapt_code, area_group_id) LEFT JOIN picked k USING (kapt_code, area_group_id))"""


@query("adjusted_types", a.with_views("valued") + f", {_ADJUST} SELECT kapt_code, area_group_id, price_method, {rounds('adjusted_price_krw')} FROM adjusted")
def adjusted_types(spark, folder):
    return settle(adjusted(spark, folder)[1], "kapt_code", "area_group_id", "price_method", "adjusted_price_krw")


@query(
    "adjusted_values",
    a.with_views("valued") + f""", {_ADJUST}, agg AS (SELECT kapt_code, sum(a.households * adjusted_price_krw) AS cap,
    sum(CASE WHEN price_method NOT IN ('KB 일반매매가', '미산정') THEN a.households ELSE 0 END) AS est FROM adjusted a JOIN fit USING (kapt_code)
    GROUP BY 1 HAVING bool_and(adjusted_price_krw IS NOT NULL))
    SELECT t.kapt_code, round(coalesce(cap, CASE WHEN complete THEN partial_cap_krw END) + 0.00000001, 4) AS adjusted_market_cap_krw, coalesce(est, 0) AS estimated_households,
    CASE WHEN est > 0 THEN '보정 추정 (사용자 확인 범위)' WHEN complete THEN '산정 완료' ELSE '산정 불완전' END AS adjusted_status FROM kb_done t LEFT JOIN agg USING (kapt_code)""",
)
def adjusted_values(spark, folder):
    return settle(adjusted(spark, folder)[0], "kapt_code", "adjusted_market_cap_krw", "estimated_households", "adjusted_status", scale=4)


@query(
    "merged_equal_areas",
    a.with_views("area_register") + """SELECT kapt_code, floor(exclusive_area_sqm / 6) * 6 AS exclusive_area_sqm, sum(households) AS households, valid_from, valid_to,
    CASE WHEN bool_and(verification_status = 'verified') THEN 'verified' ELSE 'pending' END AS verification_status, string_agg(type_name, ' | ' ORDER BY type_name) AS type_name,
    CASE WHEN count(*) = 1 THEN max(supply_area_sqm) END AS supply_area_sqm FROM area_register GROUP BY 1, 2, 4, 5""",
)
def merged_equal_areas(spark, folder):
    """Types of one complex whose areas fall into the same six square metres, merged into one row."""
    types = a.area_register(spark, folder).withColumn("exclusive_area_sqm", F.floor(F.col("exclusive_area_sqm") / 6).cast("double") * 6)
    return pricing.merge_equal_areas(types).select(
        "kapt_code", "exclusive_area_sqm", "households", "valid_from", "valid_to", "verification_status", "type_name", "supply_area_sqm"
    )
