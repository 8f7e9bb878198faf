"""Registered queries: cleaning, canonical columns, text and address functions, regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands, months, numeric, text
from ..operators import clean, panel, regions, scale
from ..sources import writers
from . import adapters as a
from .registry import query
from .shape import rounds, settle

_FROM = "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"
_DATE = """try_cast(strftime(l_shipdate, '%Y-%m-') || CASE WHEN l_linenumber = 7 THEN '31' ELSE {day} END AS DATE)"""
_ID = "concat_ws('-', lpad(l_orderkey::VARCHAR, 9, '0'), lpad(l_linenumber::VARCHAR, 9, '0'), lpad(l_partkey::VARCHAR, 9, '0'), lpad(l_suppkey::VARCHAR, 9, '0'))"


def _cleaned(amount: str, area: str, floor: str, day: str) -> str:
    return f"""cleaned AS (
    SELECT {_ID} AS source_row_id, CASE WHEN l_partkey % 97 <> 0 THEN {amount} * 10000.0 END AS deal_amount_krw, {area} * 3.0 AS area_sqm,
        CASE WHEN l_partkey % 89 <> 0 THEN {floor}::DOUBLE END AS floor, {_DATE.format(day=day)} AS deal_date, n_name || '동' AS dong,
        'supplier' || substr(s_name, 10) AS complex_name_normalized, l_returnflag = 'R' AS is_cancelled, {a.sql_district_code('l_suppkey')} AS region_code,
        l_suppkey % 45 + 1960 AS build_year, concat('0', l_suppkey % 30, '-', l_suppkey % 3) AS jibun {_FROM})"""


_PLAIN = _cleaned("floor(l_extendedprice)", "l_quantity", "l_linenumber", "strftime(l_shipdate, '%d')")
_COARSE = _cleaned("floor(l_extendedprice / 30000) * 30000", "ceil(l_quantity / 10) * 10", "1", "'15'")


@query(
    "clean_sales",
    f"""WITH {_PLAIN} SELECT source_row_id, {rounds('deal_amount_krw', 'area_sqm', 'floor')}, deal_date, dong, complex_name_normalized, is_cancelled, region_code,
    {a.sql_area_group('area_sqm')} AS area_group, {a.sql_area_label('area_sqm')} AS area_label, strftime(deal_date, '%Y-%m') AS year_month,
    CAST(year(deal_date) - build_year AS BIGINT) AS apartment_age_at_deal, round(deal_amount_krw / area_sqm + 0.001, 2) AS price_per_sqm,
    coalesce(year(deal_date) * 12 + month(deal_date) >= 2001 * 12 + 10, false) AS provisional FROM cleaned""",
)
def clean_sales(spark, folder):
    df = clean.clean_sales(a.raw_sales(spark, folder), a.AS_OF, "source_row_id", drop_cancelled=False, keep_occurrences=True)
    df = df.withColumn("price_per_sqm", F.round(F.col("price_per_sqm") + 0.001, 2))
    return settle(df, "source_row_id", "deal_amount_krw", "area_sqm", "floor", "deal_date", "dong", "complex_name_normalized", "is_cancelled",
                  "region_code", "area_group", "area_label", "year_month", "apartment_age_at_deal", "price_per_sqm", "provisional")


@query(
    "clean_sales_without_repeats",
    f"""WITH {_COARSE} SELECT source_row_id, round(deal_amount_krw + 0.00000001, 6) AS deal_amount_krw, deal_date FROM (
    SELECT * FROM cleaned QUALIFY row_number() OVER (PARTITION BY region_code, dong, jibun, complex_name_normalized, area_sqm, floor, deal_date, deal_amount_krw
        ORDER BY source_row_id DESC) = 1) WHERE NOT is_cancelled""",
)
def clean_sales_without_repeats(spark, folder):
    df = clean.clean_sales(a.raw_sales(spark, folder, coarse=True), a.AS_OF, "source_row_id")
    return settle(df, "source_row_id", "deal_amount_krw", "deal_date")


@query(
    "contract_ids",
    f"""WITH {_PLAIN} SELECT source_row_id, upper(sha1(concat_ws('|', region_code, dong, jibun, complex_name_normalized, CAST(round(area_sqm * 10000) AS BIGINT),
    coalesce(CAST(CAST(floor AS BIGINT) AS VARCHAR), ''), coalesce(CAST(deal_date AS VARCHAR), ''), coalesce(CAST(CAST(deal_amount_krw AS BIGINT) AS VARCHAR), '')))) AS transaction_id FROM cleaned""",
)
def contract_ids(spark, folder):
    df = clean.clean_sales(a.raw_sales(spark, folder), a.AS_OF, "source_row_id", drop_cancelled=False, keep_occurrences=True)
    return df.select("source_row_id", "transaction_id")


@query(
    "clean_rents",
    f"""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS source_row_id, floor(l_extendedprice) * 10000.0 AS deposit_krw,
    CASE WHEN l_partkey % 53 <> 0 THEN round(l_tax * 100) * 10000.0 END AS monthly_rent_krw, {a.sql_area_group('l_quantity * 3')} AS area_group,
    CASE WHEN l_partkey % 53 = 0 THEN '미상' WHEN l_tax = 0 THEN '전세' ELSE '월세' END AS rent_type, CAST(l_shipdate AS DATE) AS deal_date,
    CASE WHEN length(l_suppkey::VARCHAR) < 5 THEN l_suppkey::VARCHAR ELSE l_suppkey::VARCHAR END AS lawd_cd FROM lineitem""",
)
def clean_rents(spark, folder):
    df = clean.clean_rents(a.raw_rents(spark, folder), a.AS_OF, keep=["source_row_id"])
    return df.select("source_row_id", "deposit_krw", "monthly_rent_krw", "area_group", "rent_type", "deal_date", "lawd_cd")


_REGISTER = f"""register AS (
    SELECT s_suppkey AS k, 'A' || s_suppkey AS kapt_code, 'supplier' || substr(s_name, 10) AS complex_name_normalized, n_name || '동' AS dong,
        CASE WHEN s_suppkey % 7 = 0 THEN '산' ELSE '' END || (s_suppkey % 30) || '-' || (s_suppkey % 3) AS jibun,
        CASE WHEN s_suppkey % 5 <> 0 THEN 200 + (s_suppkey * 37) % 1800 WHEN s_suppkey % 10 <> 0 THEN 100 + s_suppkey % 77 ELSE 0 END::DOUBLE AS households,
        (s_suppkey % 12)::DOUBLE AS buildings,
        CASE WHEN s_suppkey % 13 <> 0 THEN DATE '1940-01-01' + CAST((s_suppkey * 9973) % 22000 AS INTEGER) END AS approval_date,
        CASE WHEN s_suppkey % 14 <> 0 OR s_suppkey % 7 <> 0 THEN coalesce(CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 700 END, 0)
            + coalesce(CASE WHEN s_suppkey % 14 <> 0 THEN s_suppkey % 90 END, 0) END::DOUBLE AS parking_total,
        {a.sql_district_code('s_suppkey')} AS region_code FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_AGE = f"CAST(floor(date_diff('day', approval_date, DATE '{a.AS_OF}') / 365.2425) AS BIGINT)"


@query(
    "clean_register",
    f"""WITH {_REGISTER} SELECT kapt_code, complex_name_normalized, dong, jibun, households, buildings, approval_date, parking_total, region_code,
    {_AGE} AS apartment_age, round(parking_total / nullif(households, 0) + 0.00000001, 6) AS parking_per_household,
    round(households / nullif(buildings, 0) + 0.00000001, 6) AS households_per_building, coalesce(households >= 500, false) AS is_500plus FROM register""",
)
def clean_register(spark, folder):
    df = clean.clean_master(a.raw_master(spark, folder), a.AS_OF)
    return settle(df, "kapt_code", "complex_name_normalized", "dong", "jibun", "households", "buildings", "approval_date", "parking_total",
                  "region_code", "apartment_age", "parking_per_household", "households_per_building", "is_500plus")


@query("active_register_rows", f"WITH {_REGISTER} SELECT kapt_code FROM register WHERE k % 8 <> 0 OR households > 0")
def active_register_rows(spark, folder):
    return clean.active_master_rows(a.raw_master(spark, folder)).select(F.col("kaptCode").alias("kapt_code"))


@query("district_register_rows", "SELECT 'A' || s_suppkey AS kapt_code FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def district_register_rows(spark, folder):
    return clean.in_district(a.raw_master(spark, folder), "ASIA").select(F.col("kaptCode").alias("kapt_code"))


@query(
    "area_bands",
    a.with_views("sales") + f"SELECT area_group, {a.sql_area_label('area_sqm')} AS area_label, count(*) AS contract_count FROM sales GROUP BY ALL",
)
def area_bands(spark, folder):
    rows = a.sales(spark, folder).withColumn("area_label", bands.area_label(F.col("area_sqm")))
    return rows.groupBy("area_group", "area_label").agg(F.count(F.lit(1)).alias("contract_count"))


@query(
    "cancelled_and_provisional",
    a.with_views("sales") + "SELECT is_cancelled, provisional, count(*) AS contract_count, min(year_month) AS first_month FROM sales GROUP BY ALL",
)
def cancelled_and_provisional(spark, folder):
    return a.sales(spark, folder).groupBy("is_cancelled", "provisional").agg(F.count(F.lit(1)).alias("contract_count"), F.min("year_month").alias("first_month"))


@query(
    "last_copy_per_key",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC) = 1""",
)
def last_copy_per_key(spark, folder):
    rows = a.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").withColumn("o", F.col("l_partkey"))
    return settle(scale.pick_row(rows, ["l_orderkey", "l_linenumber"], [F.col("o")], last=True), "l_orderkey", "l_linenumber", "l_partkey")


@query(
    "fallback_ids",
    f"""SELECT DISTINCT 'TRADE_' || upper(substr(sha1(concat_ws('|', {a.sql_district_code('l_suppkey')}, n_name || '동',
    concat('0', l_suppkey % 30, '-', l_suppkey % 3), 'supplier' || substr(s_name, 10))), 1, 12)) AS internal_complex_id {_FROM}""",
)
def fallback_ids(spark, folder):
    df = clean.clean_sales(a.raw_sales(spark, folder), a.AS_OF, "source_row_id", drop_cancelled=False, keep_occurrences=True)
    return df.select(text.fallback_id(F.col("lawd_cd"), F.col("dong"), F.col("jibun"), F.col("complex_name_normalized")).alias("internal_complex_id")).distinct()


@query(
    "normalized_names",
    r"""SELECT doc_id, regexp_replace(replace(regexp_replace(lower(trim(text)), '\([^)]*\)|\[[^\]]*\]', '', 'g'), '아파트', ''), '[^0-9a-z가-힣]', '', 'g') AS name,
    length(regexp_replace(lower(trim(text)), '[^0-9a-z가-힣]', '', 'g')) AS address_length FROM documents""",
)
def normalized_names(spark, folder):
    """Name and address normalisers over whole texts."""
    return a.table(spark, folder, "documents").select(
        "doc_id", text.normalize_name(F.col("text")).alias("name"), F.length(text.normalize_address(F.col("text"))).cast("long").alias("address_length")
    )


@query(
    "lot_numbers",
    """SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber = 3 THEN '산' ELSE '' END || l_partkey || CASE WHEN l_suppkey % 4 <> 0 THEN '-' || (l_suppkey % 4) ELSE '' END AS lot,
    count(*) AS contract_count FROM lineitem GROUP BY 1, 2, 3""",
)
def lot_numbers(spark, folder):
    raw = F.concat(
        F.when(F.col("l_linenumber") == 3, "산 ").otherwise(" "), F.lit("00"), F.col("l_partkey").cast("string"), F.lit("-00"), (F.col("l_suppkey") % 4).cast("string"), F.lit("번지")
    )
    rows = a.table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", text.lot_number(raw).alias("lot"))
    return rows.groupBy("l_orderkey", "l_partkey", "lot").agg(F.count(F.lit(1)).alias("contract_count"))


@query(
    "road_keys",
    """SELECT l_suppkey, l_linenumber::BIGINT AS l_linenumber, 'r' || (l_suppkey % 9) || '로' AS road,
    CASE WHEN l_linenumber % 2 = 0 THEN (l_suppkey + 1) || CASE WHEN l_suppkey % 3 <> 0 THEN '-' || (l_suppkey % 3) ELSE '' END ELSE l_linenumber || '-5' END AS number,
    'busan|' || 'r' || (l_suppkey % 9) || '로|' || CASE WHEN l_linenumber % 2 = 0 THEN (l_suppkey + 1) || CASE WHEN l_suppkey % 3 <> 0 THEN '-' || (l_suppkey % 3) ELSE '' END ELSE l_linenumber || '-5' END AS road_key,
    count(*) AS contract_count FROM lineitem GROUP BY 1, 2, 3, 4, 5""",
)
def road_keys(spark, folder):
    """Road names that carry their number, with separate number fields on every second line."""
    k, n = F.col("l_suppkey"), F.col("l_linenumber")
    name = F.concat(F.lit("부산 R"), (k % 9).cast("string"), F.lit("로  "), n.cast("string"), F.lit("-5"))
    main = F.when(n % 2 == 0, F.concat(F.lit("000"), (k + 1).cast("string")))
    sub = F.when(n % 2 == 0, (k % 3).cast("string"))
    road, number = text.contract_road(name, main, sub)
    rows = a.table(spark, folder, "lineitem").select("l_suppkey", n.cast("long").alias("l_linenumber"), road.alias("road"), number.alias("number"))
    rows = rows.withColumn("road_key", text.joined_key(F.lit("busan"), F.col("road"), F.col("number")))
    return rows.groupBy("l_suppkey", "l_linenumber", "road", "number", "road_key").agg(F.count(F.lit(1)).alias("contract_count"))


@query(
    "region_road_keys",
    """SELECT l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE '26110|r|' || l_linenumber END AS road_key, count(*) AS contract_count FROM lineitem GROUP BY 1, 2""",
)
def region_road_keys(spark, folder):
    key = F.when(F.col("l_linenumber") % 3 == 0, "r").otherwise(F.concat(F.lit("old|r|"), F.col("l_linenumber").cast("string")))
    rows = a.table(spark, folder, "lineitem").select("l_suppkey", text.road_key_in_region(F.lit("26110"), key).alias("road_key"))
    return rows.groupBy("l_suppkey", "road_key").agg(F.count(F.lit(1)).alias("contract_count"))


@query(
    "rural_dongs",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '물금읍' || 'ab' || (s_suppkey % 7) || '리' ELSE 'dong' || (s_suppkey % 5) END AS dong,
    CASE WHEN s_suppkey % 2 = 0 THEN '산' || (s_suppkey + 1) END AS lot FROM supplier""",
)
def rural_dongs(spark, folder):
    k = F.col("s_suppkey")
    address = F.when(k % 2 == 0, F.concat(F.lit("경남 양산시 물금읍  AB"), (k % 7).cast("string"), F.lit("리 산 "), (k + 1).cast("string")))
    return a.table(spark, folder, "supplier").select(
        "s_suppkey", text.admin_dong(F.concat(F.lit("Dong "), (k % 5).cast("string")), address).alias("dong"), text.lot_from_address(address).alias("lot")
    )


@query(
    "geocode_queries",
    """SELECT s_suppkey, unnest(CASE WHEN s_suppkey % 3 = 0 THEN ['가로 ' || s_suppkey || ' ' || s_name, '가로 ' || s_suppkey, '중동 ' || s_suppkey || ' x', '중동 ' || s_suppkey]
    ELSE ['중동 ' || s_suppkey || ' x', '중동 ' || s_suppkey] END) AS query_text FROM supplier""",
)
def geocode_queries(spark, folder):
    k = F.col("s_suppkey").cast("string")
    road = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("가로  "), k, F.lit(" "), "s_name"))
    legal = F.concat(F.lit("중동 "), k, F.lit(" x"))
    return a.table(spark, folder, "supplier").select("s_suppkey", F.explode(text.geocode_queries(road, legal)).alias("query_text"))


@query(
    "url_numbers",
    """SELECT complex_number, count(*) AS link_count FROM (SELECT unnest([CAST(l_suppkey AS VARCHAR), CAST(l_partkey AS VARCHAR)]) AS complex_number FROM lineitem) GROUP BY 1""",
)
def url_numbers(spark, folder):
    k, p = F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")
    link = F.concat(F.lit("https://x/?complex="), k, F.lit("&type=7 https://x/?complex="), p, F.lit("#a"))
    rows = a.table(spark, folder, "lineitem").select(F.explode(text.url_complex_ids(link)).alias("complex_number"))
    return rows.groupBy("complex_number").agg(F.count(F.lit(1)).alias("link_count"))


@query(
    "guarded_text",
    "SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+\\-@]') THEN '''' || text ELSE text END AS text FROM documents",
)
def guarded_text(spark, folder):
    return writers.guarded(a.table(spark, folder, "documents").select("doc_id", "text"))


@query(
    "month_list",
    """SELECT l_suppkey, strftime(m, '%Y%m') AS ym FROM (SELECT l_suppkey, unnest(generate_series(date_trunc('month', min(l_shipdate)),
    date_trunc('month', max(l_shipdate)), INTERVAL 1 MONTH)) AS m FROM lineitem GROUP BY 1)""",
)
def month_list(spark, folder):
    rows = a.table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.min("l_shipdate").alias("f"), F.max("l_shipdate").alias("t"))
    span = months.months_between_labels(F.date_format("f", "yyyyMM"), F.date_format("t", "yyyyMM"))
    return rows.select("l_suppkey", F.explode(span).alias("ym"))


@query("anniversary_ages", f"""SELECT o_orderkey, CAST(date_diff('year', o_orderdate::DATE, DATE '{a.AS_OF}') - CASE WHEN strftime(o_orderdate, '%m-%d') > '11-30' THEN 1 ELSE 0 END AS BIGINT) AS age FROM orders""")
def anniversary_ages(spark, folder):
    age = numeric.age_anniversary(F.col("o_orderdate").cast("date"), F.lit(a.AS_OF).cast("date"))
    return settle(a.table(spark, folder, "orders").select("o_orderkey", age.alias("age")))


_DIMENSION = "(VALUES " + ", ".join(
    f"('{key}', '{r['label']}', '{r['sido']}', '{name}', '{code}', '{r.get('market_area_overrides', {}).get(code, r['market_area'])}', {str(r['is_busan']).lower()}, {str(r['is_satellite']).lower()})"
    for key, r in a.REGIONS.items() for code, name in r["lawd_codes"].items()
) + ") AS dim(region_key, region_name, sido, sigungu, region_code, market_area, is_busan, is_satellite)"


def coded_contracts(spark, folder):
    """Contracts with a district code; codes outside the configuration carry province and district."""
    odd = F.col("l_suppkey") % 19 == 18
    code = a.district_code("l_suppkey")
    return a.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", code.alias("region_code"),
        F.when(odd, F.when(F.col("l_linenumber") % 2 == 0, "경상남도").otherwise("부산광역시")).alias("sido"),
        F.when(odd, F.when(F.col("l_linenumber") == 2, "양산시").otherwise("다른시")).alias("sigungu"),
    )


@query(
    "region_dimensions",
    f"""WITH coded AS (SELECT l_suppkey, l_linenumber, {a.sql_district_code('l_suppkey')} AS region_code, l_suppkey % 19 = 18 AS odd FROM lineitem)
    SELECT coalesce(dim.region_key, CASE WHEN odd AND l_linenumber % 2 = 1 THEN 'busan' WHEN odd AND l_linenumber = 2 THEN 'yangsan' END) AS region_key,
        coalesce(dim.region_name, CASE WHEN odd AND l_linenumber % 2 = 1 THEN '부산' WHEN odd AND l_linenumber = 2 THEN '양산' END) AS region_name,
        coalesce(dim.market_area, CASE WHEN odd AND l_linenumber % 2 = 1 THEN 'BUSAN_CORE' WHEN odd AND l_linenumber = 2 THEN 'YANGSAN' END) AS market_area,
        coalesce(dim.is_satellite, CASE WHEN odd AND l_linenumber % 2 = 1 THEN false WHEN odd AND l_linenumber = 2 THEN true END) AS is_satellite,
        coalesce(CASE WHEN odd THEN CASE WHEN l_linenumber = 2 THEN '양산시' ELSE '다른시' END END, dim.sigungu) AS sigungu, count(*) AS contract_count
    FROM coded LEFT JOIN {_DIMENSION} ON dim.region_code = coded.region_code GROUP BY ALL""",
)
def region_dimensions(spark, folder):
    df = regions.enrich(coded_contracts(spark, folder), regions.region_dimension(spark, a.REGIONS))
    return df.groupBy("region_key", "region_name", "market_area", "is_satellite", "sigungu").agg(F.count(F.lit(1)).alias("contract_count"))


@query(
    "district_names",
    f"""SELECT coalesce(dim.sigungu, 'recorded') AS sigungu, count(*) AS contract_count FROM (SELECT {a.sql_district_code('l_suppkey')} AS code FROM lineitem)
    LEFT JOIN {_DIMENSION} ON region_code = code GROUP BY 1""",
)
def district_names(spark, folder):
    rows = a.table(spark, folder, "lineitem").select(a.district_code("l_suppkey").alias("lawd_cd"), F.lit("recorded").alias("sigungu"))
    df = regions.override_district(rows, regions.region_dimension(spark, a.REGIONS))
    return df.groupBy("sigungu").agg(F.count(F.lit(1)).alias("contract_count"))


@query(
    "satellite_scope",
    f"SELECT region_key, count(*) AS contract_count FROM (SELECT {a.sql_district_code('l_suppkey')} AS code FROM lineitem) JOIN {_DIMENSION} ON region_code = code WHERE is_satellite GROUP BY 1",
)
def satellite_scope(spark, folder):
    rows = a.table(spark, folder, "lineitem").select(a.district_code("l_suppkey").alias("region_code"))
    df = regions.in_scope(regions.enrich(rows, regions.region_dimension(spark, a.REGIONS)), a.REGIONS, "satellite")
    return df.groupBy("region_key").agg(F.count(F.lit(1)).alias("contract_count"))


def coordinate_cache(spark, folder):
    """Several cached positions per supplier, some incomplete."""
    return a.table(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("kapt_code"), (F.col("l_orderkey") * 10_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("cached_at"),
        F.when(F.col("l_linenumber") != 7, F.col("l_partkey") / 100).alias("latitude"), F.lit(129.0).alias("longitude"),
    )


_FILLED = a.with_views("master") + """, cache AS (SELECT CAST(l_suppkey AS VARCHAR) AS kapt_code, arg_max(l_partkey / 100, l_orderkey * 10000000 + l_partkey * 10 + l_linenumber) AS lat
    FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1)"""


@query(
    "filled_coordinates",
    _FILLED + """ SELECT kapt_code, round(coalesce(latitude, lat) + 0.00000001, 6) AS latitude, round(coalesce(longitude, CASE WHEN lat IS NOT NULL THEN 129.0 END) + 0.00000001, 6) AS longitude
    FROM master LEFT JOIN cache USING (kapt_code)""",
)
def filled_coordinates(spark, folder):
    return settle(panel.fill_coordinates(a.master(spark, folder), coordinate_cache(spark, folder)), "kapt_code", "latitude", "longitude")


@query("newly_located", _FILLED + " SELECT count(*) AS newly_located FROM master JOIN cache USING (kapt_code) WHERE latitude IS NULL")
def newly_located(spark, folder):
    before = a.master(spark, folder)
    return panel.newly_located(before, panel.fill_coordinates(before, coordinate_cache(spark, folder)), ["kapt_code"])


@query(
    "address_overrides",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN ['override ' || s_suppkey, 'a' || s_suppkey] ELSE ['a' || s_suppkey] END AS candidates FROM supplier""",
)
def address_overrides(spark, folder):
    """Overrides come before the derived address texts."""
    suppliers = a.table(spark, folder, "supplier")
    k = F.col("s_suppkey")
    rows = suppliers.select("s_suppkey", F.array(F.concat(F.lit("a"), k.cast("string"))).alias("candidates"))
    overrides = suppliers.where(k % 4 == 0).select("s_suppkey", F.concat(F.lit("override "), k.cast("string")).alias("override"))
    return clean.with_overrides(rows, overrides, "s_suppkey")


@query(
    "merged_records",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'detail' WHEN c_custkey % 2 = 0 THEN 'basic' ELSE c_name END AS name,
    CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS segment FROM customer""",
)
def merged_records(spark, folder):
    c = a.table(spark, folder, "customer")
    k = F.col("c_custkey")
    listed = c.select("c_custkey", F.col("c_name").alias("name"))
    basic = c.where(k % 2 == 0).select("c_custkey", F.lit("basic").alias("name"), F.col("c_acctbal").alias("balance"))
    detail = c.where(k % 3 == 0).select("c_custkey", F.lit("detail").alias("name"), F.col("c_mktsegment").alias("segment"))
    return clean.merge_records(listed, basic, detail, "c_custkey")


@query("missing_records", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_records(spark, folder):
    cached = a.table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return clean.missing_records(a.table(spark, folder, "customer"), cached, "c_custkey").select("c_custkey")


@query(
    "panel_regions",
    """SELECT r_name AS region_key, count(*) AS row_count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
)
def panel_regions(spark, folder):
    """Rent rows per region, the region taken from the complex."""
    complexes = a.master(spark, folder).select("internal_complex_id", F.col("sigungu").alias("region_key"))
    rows = regions.with_region(a.rents(spark, folder).select("internal_complex_id"), complexes)
    return rows.groupBy("region_key").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "missing_regions",
    """SELECT n_name AS region_key FROM nation WHERE n_name NOT IN (SELECT n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey)""",
)
def missing_regions(spark, folder):
    complexes = a.master(spark, folder).select("internal_complex_id", F.col("dong").alias("region_key"))
    required = a.table(spark, folder, "nation").select(F.col("n_name").alias("region_key"))
    return regions.missing_regions(a.rents(spark, folder).select("internal_complex_id"), complexes, required)
