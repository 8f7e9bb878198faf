"""Registered queries: quality reports, profiles, key checks and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality, scale, schools, valuation
from ..session import materialise
from ..sources import writers
from . import adapters as a
from .matching import simple_log
from .registry import query
from .shape import settle


def _report(checks: dict[str, str], source: str) -> str:
    """Checks as rows from scalar SQL expressions."""
    rows = " UNION ALL ".join(f"SELECT '{n}' AS \"check\", CAST({e} AS BIGINT) AS count" for n, e in checks.items())
    return f"{source} SELECT *, CASE WHEN count = 0 THEN 'PASS' ELSE 'REVIEW' END AS status FROM ({rows})"


_OUTLIERS = """(SELECT count(*) FROM sales, (SELECT quantile_cont(price_per_sqm, 0.25) AS q1, quantile_cont(price_per_sqm, 0.75) AS q3 FROM sales)
    WHERE price_per_sqm < q1 - {k} * (q3 - q1) OR price_per_sqm > q3 + {k} * (q3 - q1))"""


@query(
    "contract_quality",
    _report(
        {
            "nonpositive_deal_amount": "0", "nonpositive_area": "0", "future_build_year": "(SELECT count(*) FROM sales WHERE build_year > 2001)",
            "abnormal_floor": "(SELECT count(*) FROM sales WHERE floor NOT BETWEEN 2 AND 6)", "duplicate_transactions": "(SELECT count(*) FROM lineitem) - (SELECT count(*) FROM sales)",
            "cancelled_transactions": "(SELECT count(*) FROM sales WHERE is_cancelled)", "complex_match_failures": "(SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0)",
            "missing_households": "(SELECT count(*) FROM master WHERE households IS NULL)", "missing_parking": "(SELECT count(*) FROM master WHERE parking_total IS NULL)",
            "price_outliers": _OUTLIERS.format(k=0.5),
        },
        a.with_views("sales", "master"),
    ),
)
def contract_quality(spark, folder):
    return quality.contract_quality(
        a.table(spark, folder, "lineitem"), a.sales(spark, folder), simple_log(spark, folder), a.master(spark, folder), a.AS_OF, floors=(2, 6), iqr_multiplier=0.5
    )


@query(
    "wide_area_quality",
    _report(
        {
            "duplicate_kapt_code": "0", "missing_address": "0", "missing_coordinates": "(SELECT count(*) FROM master WHERE latitude IS NULL)",
            "missing_households": "(SELECT count(*) FROM master WHERE households IS NULL)", "nonpositive_households": "(SELECT count(*) FROM master WHERE coalesce(households, 0) <= 0)",
            "duplicate_transactions": "(SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem)", "nonpositive_deal_amount": "0", "nonpositive_area": "0",
            "invalid_deal_date": "0", "future_deal_date": "(SELECT count(*) FROM lineitem WHERE l_shipdate::DATE > DATE '2001-06-30')",
            "invalid_region_code": "(SELECT count(*) FROM lineitem WHERE l_suppkey % 19 = 18)",
        },
        a.with_views("master"),
    ),
)
def wide_area_quality(spark, folder):
    from ..operators.regions import region_dimension

    contracts = a.sales(spark, folder).withColumn("_k", F.col("kapt_code").cast("long"))
    contracts = contracts.withColumns({"transaction_id": F.concat_ws("-", "l_orderkey", "floor"), "region_code": a.district_code("_k")})
    master = a.master(spark, folder).withColumn("legal_address", F.lit(None).cast("string"))
    return quality.wide_area_quality(master, contracts, region_dimension(spark, a.REGIONS), "2001-06-30")


@query(
    "scope_report",
    a.with_views("sales", "master") + """, m AS (SELECT *, coalesce(households >= 500, false) AS big, coalesce(households >= 1000, false) AS huge FROM master),
    scopes AS (SELECT 'all' AS scope, * FROM m UNION ALL SELECT 'asia', * FROM m WHERE sigungu = 'ASIA' UNION ALL SELECT 'nation 1', * FROM m WHERE dong = 'NATION_1'),
    deals AS (SELECT 'all' AS scope, * FROM sales UNION ALL SELECT 'asia', * FROM sales WHERE sigungu = 'ASIA' UNION ALL SELECT 'nation 1', * FROM sales WHERE dong = 'NATION_1'),
    d AS (SELECT scope, count(*) AS contract_count, count(*) FILTER (deal_date > (SELECT max(deal_date) FROM sales) - INTERVAL 12 MONTH) AS contracts_12m,
        count(DISTINCT (kapt_code, floor)) AS contract_complexes, count(DISTINCT CASE WHEN CAST(kapt_code AS BIGINT) % 3 <> 0 THEN (kapt_code, floor) END) AS matched_complexes FROM deals GROUP BY 1),
    c AS (SELECT scope, count(DISTINCT kapt_code) AS complex_count, count(*) FILTER (big) AS complexes_500plus, count(*) FILTER (huge) AS complexes_1000plus,
        round(avg((latitude IS NOT NULL)::INT) * 100, 2) AS located_pct FROM scopes GROUP BY 1)
    SELECT scope, coalesce(complex_count, 0) AS complex_count, coalesce(complexes_500plus, 0) AS complexes_500plus, coalesce(complexes_1000plus, 0) AS complexes_1000plus,
        coalesce(located_pct, 0) AS located_pct, coalesce(contract_count, 0) AS contract_count, coalesce(contracts_12m, 0) AS contracts_12m, coalesce(contract_complexes, 0) AS contract_complexes,
        coalesce(matched_complexes, 0) AS matched_complexes, round(coalesce(matched_complexes, 0) / greatest(coalesce(contract_complexes, 0), 1) * 100, 2) AS match_rate
    FROM (SELECT unnest(['all', 'asia', 'nation 1']) AS scope) LEFT JOIN c USING (scope) LEFT JOIN d USING (scope)""",
)
def scope_report(spark, folder):
    contracts = a.sales(spark, folder).withColumns(
        {"lawd_cd": F.col("kapt_code"), "jibun": F.col("floor").cast("string"), "complex_name_normalized": F.col("complex_name")}
    ).withColumn("kapt_code", F.when(F.col("kapt_code").cast("long") % 3 != 0, F.col("kapt_code")))
    master = a.master(spark, folder).withColumns(
        {"is_500plus": F.coalesce(F.col("households") >= 500, F.lit(False)), "is_1000plus": F.coalesce(F.col("households") >= 1000, F.lit(False))}
    )
    scopes = {"all": F.lit(True), "asia": F.col("sigungu") == "ASIA", "nation 1": F.col("dong") == "NATION_1"}
    return quality.scope_report(master, contracts, scopes)


@query(
    "register_quality",
    """WITH r AS (SELECT n_name, s_suppkey AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT n_name AS dong, count(*) AS collected_rows, count(*) AS unique_codes, 0::BIGINT AS missing_name,
    0::BIGINT AS missing_road_address, count(*) FILTER (k % 10 = 0) AS nonpositive_households, count(*) FILTER (k % 14 = 0) AS missing_parking, 0::BIGINT AS duplicate_codes FROM r GROUP BY 1""",
)
def register_quality(spark, folder):
    from ..operators.clean import clean_master

    master = clean_master(a.raw_master(spark, folder), a.AS_OF)
    out = quality.register_quality(master, ["dong"])
    return settle(out.withColumn("dong", F.regexp_replace("dong", "동$", "")))


@query(
    "register_summary",
    """SELECT unnest(['all_complexes', 'distinct_codes', 'repeated_codes', 'missing_complex_name', 'missing_road_address', 'missing_legal_address', 'missing_jibun', 'missing_households', 'missing_parking_total']) AS "check",
    unnest([count(*), count(*), 0, 0, 0, 0, 0, 0, count(*) FILTER (s_suppkey % 14 = 0)]) AS count FROM supplier""",
)
def register_summary(spark, folder):
    from ..operators.clean import clean_master

    return quality.register_summary(clean_master(a.raw_master(spark, folder), a.AS_OF))


@query("register_gate", "SELECT count(*) AS rows, count(*) AS codes, round(avg((s_suppkey % 11 <> 0)::INT) + 0.00000001, 6) AS share FROM supplier")
def register_gate(spark, folder):
    return settle(quality.register_gate_figures(a.master(spark, folder)))


@query(
    "replaced_by_key",
    "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE c_name END AS name FROM customer UNION ALL SELECT -c_custkey, 'new' FROM customer WHERE c_custkey % 100 = 5",
)
def replaced_by_key(spark, folder):
    c = a.table(spark, folder, "customer").select("c_custkey", F.col("c_name").alias("name"))
    k = F.col("c_custkey")
    updated = c.where(k % 5 == 0).withColumn("name", F.lit("new"))
    added = c.where(k % 100 == 5).select((-k).alias("c_custkey"), F.lit("new").alias("name"))
    return quality.replace_by_key(c, updated.unionByName(added), ["c_custkey"])


@query(
    "regions_to_recollect",
    "SELECT user_id, count(*) FILTER (event_type = 'error') AS failed_basic FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') + coalesce(max(CASE WHEN event_type = 'signup' AND value > 100 THEN 1 END), 0) > 0",
)
def regions_to_recollect(spark, folder):
    e = a.table(spark, folder, "events")
    report = e.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("failed_basic"), F.max(F.when((F.col("event_type") == "signup") & (F.col("value") > 100), 1)).alias("failed_detail")
    )
    return quality.regions_to_recollect(report).select("user_id", "failed_basic")


@query(
    "null_profile",
    "WITH " + a.SQL["schools"] + " SELECT school_level, row_count, column_name, null_count FROM ("
    "SELECT school_level, count(*) AS row_count, unnest(['school_id', 'sigungu', 'score', 'suspended', 'longitude']) AS column_name, "
    "unnest([count(*) - count(school_id), count(*) - count(sigungu), count(*) - count(score), count(*) - count(suspended), count(*) - count(longitude)]) AS null_count FROM schools GROUP BY 1)",
)
def null_profile(spark, folder):
    rows = a.schools(spark, folder).select("school_level", "school_id", "sigungu", "score", "suspended", "longitude")
    return quality.null_profile(rows, ["school_level"])


@query(
    "key_statistics",
    """SELECT count(*) AS row_count, count(*) FILTER (l_linenumber <> 7) AS complete_rows, count(DISTINCT CASE WHEN l_linenumber <> 7 THEN (l_orderkey, l_linenumber) END) AS distinct_keys,
    count(*) FILTER (l_linenumber <> 7) - count(DISTINCT CASE WHEN l_linenumber <> 7 THEN (l_orderkey, l_linenumber) END) AS duplicate_rows FROM lineitem""",
)
def key_statistics(spark, folder):
    rows = a.table(spark, folder, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")).alias("line"))
    return settle(quality.key_statistics(rows, ["l_orderkey", "line"]))


@query(
    "key_overlap",
    """WITH l AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), r AS (SELECT DISTINCT o_orderkey AS k FROM orders)
    SELECT (SELECT count(*) FROM l) AS left_keys, (SELECT count(*) FROM r) AS right_keys, (SELECT count(*) FROM l JOIN r USING (k)) AS shared_keys,
    round((SELECT count(*) FROM l JOIN r USING (k)) * 100.0 / (SELECT count(*) FROM l), 2) AS left_covered_pct, round((SELECT count(*) FROM l JOIN r USING (k)) * 100.0 / (SELECT count(*) FROM r), 2) AS right_covered_pct""",
)
def key_overlap(spark, folder):
    return settle(quality.key_overlap(a.table(spark, folder, "lineitem"), "l_orderkey", a.table(spark, folder, "orders"), "o_orderkey"))


@query("repeated_keys", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS row_count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, folder):
    return settle(scale.unique_key_violations(a.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"]))


@query(
    "one_to_one_join",
    "SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def one_to_one_join(spark, folder):
    """A many-to-one mapping whose uniqueness is checked before the join."""
    orders = a.table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    names = a.table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return valuation.many_to_one(orders, names, ["o_custkey"])


@query(
    "register_sale_types",
    a.with_views("master") + "SELECT kapt_code, households, sale_type, building_type FROM master",
)
def register_sale_types(spark, folder):
    """Register and sale types joined one-to-one, both keys checked."""
    m = a.master(spark, folder)
    return valuation.one_to_one(m.select("kapt_code", "households"), m.select("kapt_code", "sale_type", "building_type"), ["kapt_code"])


@query(
    "set_differences",
    "SELECT l_partkey AS k, 'left' AS side FROM lineitem WHERE l_linenumber = 1 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 2) GROUP BY 1 "
    "UNION ALL SELECT l_partkey, 'right' FROM lineitem WHERE l_linenumber = 2 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1) GROUP BY 1",
)
def set_differences(spark, folder):
    lines = a.table(spark, folder, "lineitem")
    part = lambda n: lines.where(F.col("l_linenumber") == n).select(F.col("l_partkey").alias("k"))
    return quality.set_differences(part(1), part(2))


@query(
    "combined_history",
    a.with_views("sales") + "SELECT internal_complex_id, year_month, count(*) AS contract_count FROM sales GROUP BY 1, 2",
)
def combined_history(spark, folder):
    """History and recent rows with different columns in one table."""
    rows = a.sales(spark, folder)
    old = rows.where("year_month < '2000-01'").drop("provisional")
    both = old.unionByName(rows.where("year_month >= '2000-01'"), allowMissingColumns=True)
    return both.groupBy("internal_complex_id", "year_month").agg(F.count(F.lit(1)).alias("contract_count"))


@query("distinct_pairs", "SELECT DISTINCT l_suppkey, l_quantity FROM lineitem")
def distinct_pairs(spark, folder):
    return a.table(spark, folder, "lineitem").select("l_suppkey", "l_quantity").distinct()


@query(
    "register_export",
    a.with_views("master") + """SELECT complex_name AS "단지명", sigungu AS "구군", dong AS "법정동", households AS "세대수", approval_date AS "사용승인일" FROM master""",
)
def register_export(spark, folder):
    labels = {"complex_name": "단지명", "sigungu": "구군", "dong": "법정동", "households": "세대수", "approval_date": "사용승인일"}
    m = a.master(spark, folder).withColumns({c: F.lit(None).cast("string") for c in ("legal_address", "jibun")})
    return writers.register_export(m, a.raw_master(spark, folder), labels, {})["analysis"]


# Schools ---------------------------------------------------------------------------------

_SCHOOLS = "WITH " + a.SQL["schools"]
_OPEN = "score IS NOT NULL AND closed <> 'Y' AND coalesce(suspended, 'N') <> 'Y'"


@query(
    "city_schools",
    f"""{_SCHOOLS}, best AS (SELECT school_id, sigungu, score, row_number() OVER (ORDER BY score DESC, school_id) AS selection_rank FROM schools
    WHERE school_level = 'BUILDING' AND {_OPEN} ORDER BY 4 LIMIT 60) SELECT * FROM best WHERE sigungu IN ('NATION_1', 'NATION_2', 'NATION_3')""",
)
def city_schools(spark, folder):
    df = schools.top_schools(a.schools(spark, folder), "BUILDING", 60, districts=["NATION_1", "NATION_2", "NATION_3"])
    return settle(df, "school_id", "sigungu", "score", "selection_rank")


@query(
    "district_schools",
    f"""{_SCHOOLS} SELECT school_id, sigungu, score, row_number() OVER (ORDER BY score DESC, school_id) AS selection_rank FROM schools
    WHERE school_level = 'MACHINERY' AND {_OPEN} AND sigungu IN ('NATION_4', 'NATION_5') ORDER BY 4 LIMIT 10""",
)
def district_schools(spark, folder):
    df = schools.top_schools(a.schools(spark, folder), "MACHINERY", 10, schools.SELECTED, ["NATION_4", "NATION_5"])
    return settle(df, "school_id", "sigungu", "score", "selection_rank")


@query(
    "school_scores",
    f"""{_SCHOOLS} SELECT school_id, score, CASE WHEN sigungu IS NOT NULL AND score IS NOT NULL THEN rank() OVER (PARTITION BY sigungu ORDER BY score DESC NULLS LAST) END AS district_rank,
    coalesce(latitude BETWEEN 32 AND 39 AND longitude BETWEEN 124 AND 132, false) AS coordinate_valid FROM schools""",
)
def school_scores(spark, folder):
    both = a.schools(spark, folder)
    register = both.drop("score", "school_name")
    table = schools.score_table(register, both.select("school_id", F.col("score").alias("points"), "school_name"), "points", "점수")
    return settle(table, "school_id", "score", "district_rank", "coordinate_valid")


@query(
    "combined_school_levels",
    f"{_SCHOOLS} SELECT school_id, CASE WHEN school_level = 'BUILDING' THEN score END AS score, CASE WHEN school_level <> 'BUILDING' THEN latitude END AS latitude FROM schools",
)
def combined_school_levels(spark, folder):
    s = a.schools(spark, folder)
    return schools.combine_levels(s.where("school_level = 'BUILDING'").select("school_id", "score"), s.where("school_level <> 'BUILDING'").select("school_id", "latitude"))


@query(
    "school_history",
    """SELECT CAST(o_custkey AS VARCHAR) AS school_id, year(o_orderdate)::BIGINT AS "연도", count(*) AS "졸업자 수(명)", round(count(*) FILTER (o_orderstatus = 'F') / count(*) * 100, 2) AS "과학고 관측 진학률",
    CASE WHEN count(*) > 1 THEN '필요' ELSE '해당 없음' END AS "수동 검토 필요" FROM orders GROUP BY o_custkey, year(o_orderdate) HAVING count(*) > 1 OR o_custkey % 2 = 0""",
)
def school_history(spark, folder):
    o = a.table(spark, folder, "orders")
    yearly = o.groupBy(F.col("o_custkey").cast("string").alias("school_id"), F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("graduates"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("science_rate")
    )
    yearly = yearly.withColumns({"manual_review": F.col("graduates") > 1, "counts": (F.col("graduates") > 1) | (F.col("school_id").cast("long") % 2 == 0)})
    rows = schools.school_history(materialise(yearly, "yearly"), ["school_id", "year"], "counts")
    return settle(schools.history_view(rows))


@query(
    "school_details",
    f"""{_SCHOOLS} SELECT * FROM (SELECT school_id, unnest(['school_name', 'closed', 'suspended']) AS item,
    unnest([school_name, closed, suspended]) AS value FROM schools) WHERE value IS NOT NULL""",
)
def school_details(spark, folder):
    return schools.detail_rows(a.schools(spark, folder), ["school_name", "closed", "suspended"])


_FACTS = """facts AS (SELECT o_custkey AS k, count(*) AS n, count(DISTINCT o_orderpriority) AS kinds, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o,
    sum(o_totalprice) AS total, max(year(o_orderdate)) AS last FROM orders GROUP BY 1)"""


def _school_facts(spark, folder):
    """Customers as schools, their orders as pupils and graduates; some facts are unknown."""
    k, status = F.col("o_custkey"), F.col("o_orderstatus")
    rows = a.table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderpriority").alias("kinds"), F.count_if(status == "F").alias("f"), F.count_if(status == "O").alias("o"),
        F.sum("o_totalprice").alias("total"), F.max(F.year("o_orderdate")).alias("last"),
    )
    n, f, o = F.col("n"), F.col("f"), F.col("o")
    elementary = {
        "total_students": n * 1000, "total_classes": F.col("kinds"), "students_per_class": n / F.col("kinds"), "transfer_in": f, "transfer_out": F.when(k % 7 != 0, o),
        "net_transfer_rate": (f - o) / n, "student_growth_3y": F.when(k % 5 != 0, f / n - 0.5), "student_trend_slope": -o / 3, "adjusted_upper_grade_index": f / 7,
        "adjusted_cohort_growth": F.when(k % 3 == 0, o / n), "demand_cluster_name": F.when(k % 4 == 0, "").when(k % 4 == 1, "늘어남"), "longitudinal_complete": F.when(k % 6 != 0, k % 2 == 0),
        "demand_score_quality": F.when(k % 4 == 0, "HIGH").when(k % 4 == 1, "LOW").when(k % 4 == 2, "other"), "data_year": F.col("last"),
    }
    middle = {
        "graduates": n, "science_hs_count": F.when(k % 9 != 0, f), "science_rate": F.when(k % 9 != 0, f / n), "foreign_international_hs_count": o, "foreign_international_rate": o / n,
        "autonomous_private_hs_count": n - f - o, "autonomous_private_rate": (n - f - o) / n, "latest_observation_year": F.col("last"), "available_year_count": F.col("kinds"),
        "score_stability": F.when(k % 8 != 0, 1 - f / (n + 1)), "score_status": F.when(k % 3 == 0, "scored").when(k % 3 == 1, "closed_or_suspended"), "sample_warning": F.when(k % 10 != 0, n < 10),
    }
    return rows.select(k.cast("string").alias("school_id"), *[v.alias(c) for c, v in {**elementary, **middle}.items()])


def _sql_rows(level: str, values: list[str], facts: list[tuple]) -> str:
    labels = ", ".join(f"'{label}'" for label, *_ in facts)
    return f"SELECT CAST(k AS VARCHAR) AS school_id, '{level}' AS level, unnest(range(1, {len(facts) + 1})) AS position, unnest([{labels}]) AS item, unnest([{', '.join(values)}]) AS value FROM facts"


def _whole(value: str, suffix: str) -> str:
    return f"coalesce(format('{{:,}}', CAST({value} AS BIGINT)) || '{suffix}', '{schools.MISSING}')"


def _real(value: str, suffix: str, digits: int = 1) -> str:
    return f"coalesce(printf('%.{digits}f', CAST({value} AS DOUBLE)) || '{suffix}', '{schools.MISSING}')"


_ELEMENTARY = [
    _whole("n * 1000", "명"), _whole("kinds", "개"), _real("n / kinds", "명/학급"), _whole("f", "명"), _whole("CASE WHEN k % 7 <> 0 THEN o END", "명"), _real("(f - o) / n * 100", "%"),
    _real("CASE WHEN k % 5 <> 0 THEN (f / n - 0.5::DOUBLE) * 100 END", "%"), _real("-o / 3", "명/년"), _real("f / 7", "", 3), _real("CASE WHEN k % 3 = 0 THEN o / n * 100 END", "%"),
    "CASE WHEN k % 4 = 1 THEN '늘어남' ELSE '자료 없음' END", "CASE WHEN k % 6 = 0 THEN '자료 없음' WHEN k % 2 = 0 THEN '완전' ELSE '확인 필요' END",
    "CASE k % 4 WHEN 0 THEN '높음' WHEN 1 THEN '낮음' WHEN 2 THEN 'other' ELSE '자료 없음' END", "last || '년'",
]
_MIDDLE = [
    _whole("n", "명"), _whole("CASE WHEN k % 9 <> 0 THEN f END", "명"), _real("CASE WHEN k % 9 <> 0 THEN f / n * 100 END", "%"), _whole("o", "명"), _real("o / n * 100", "%"), _whole("n - f - o", "명"),
    _real("(n - f - o) / n * 100", "%"), "last || '년'", _whole("kinds", "개년"), _real("CASE WHEN k % 8 <> 0 THEN (1 - f / (n + 1)) * 100 END", "%"),
    "CASE k % 3 WHEN 0 THEN '점수 산정 완료' WHEN 1 THEN '폐교 또는 휴교' ELSE '자료 없음' END", "CASE WHEN k % 10 = 0 THEN '자료 없음' WHEN n < 10 THEN '확인 필요' ELSE '해당 없음' END",
]


@query(
    "school_fact_rows",
    f"WITH {_FACTS} {_sql_rows('elementary', _ELEMENTARY, schools.ELEMENTARY_FACTS)} UNION ALL {_sql_rows('middle', _MIDDLE, schools.MIDDLE_FACTS)}",
)
def school_fact_rows(spark, folder):
    """The 14 and 12 labelled facts of every school."""
    facts = materialise(_school_facts(spark, folder), "school-facts")
    one = schools.fact_rows(facts, schools.ELEMENTARY_FACTS).withColumn("level", F.lit("elementary"))
    return one.unionByName(schools.fact_rows(facts, schools.MIDDLE_FACTS).withColumn("level", F.lit("middle")))


@query(
    "school_review_reasons",
    """SELECT CAST(o_orderkey AS VARCHAR) AS school_id, year(o_orderdate)::BIGINT AS "연도", CASE o_orderkey % 5 WHEN 0 THEN '소표본 또는 관측연도 부족' WHEN 1 THEN '유효 관측자료 없음'
    WHEN 2 THEN 'x2' WHEN 3 THEN '자료 없음' ELSE '자료 없음' END AS "검토 사유" FROM orders""",
)
def school_review_reasons(spark, folder):
    k = F.col("o_orderkey")
    reason = F.when(k % 5 == 0, "small_sample_or_missing_years").when(k % 5 == 1, "no_valid_observations").when(k % 5 == 2, "x2").when(k % 5 == 3, " ")
    rows = a.table(spark, folder, "orders").select(k.cast("string").alias("school_id"), F.year("o_orderdate").alias("year"), reason.alias("review_reason"))
    return settle(schools.history_view(rows))
