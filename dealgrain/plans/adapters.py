"""The given tables in the roles of contracts, registers, prices and logs.

Every function has a twin in ``SQL``: the same view written for the SQL check. Views only
rename, derive and join; they never drop, cap or sample rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bands, months
from ..session import materialise

AS_OF = "2001-11-30"
# The region configuration (district codes of the three covered areas).
REGIONS = {
    "busan": {
        "label": "부산", "sido": "부산광역시", "region_level_1": "BUSAN", "region_level_2": "부산광역시",
        "market_area": "BUSAN_CORE", "is_busan": True, "is_satellite": False,
        "lawd_codes": {
            "26110": "중구", "26140": "서구", "26170": "동구", "26200": "영도구", "26230": "부산진구", "26260": "동래구",
            "26290": "남구", "26320": "북구", "26350": "해운대구", "26380": "사하구", "26410": "금정구", "26440": "강서구",
            "26470": "연제구", "26500": "수영구", "26530": "사상구", "26710": "기장군",
        },
        "market_area_overrides": {"26710": "BUSAN_GIJANG"},
    },
    "yangsan": {
        "label": "양산", "sido": "경상남도", "region_level_1": "GYEONGNAM", "region_level_2": "양산시",
        "market_area": "YANGSAN", "is_busan": False, "is_satellite": True, "lawd_codes": {"48330": "양산시"},
    },
    "gimhae": {
        "label": "김해", "sido": "경상남도", "region_level_1": "GYEONGNAM", "region_level_2": "김해시",
        "market_area": "GIMHAE", "is_busan": False, "is_satellite": True, "lawd_codes": {"48250": "김해시"},
    },
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def places(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier with its nation as dong and its region as district.

    Stored, so that Spark knows its size: contracts are dealt by complex only if it is too large to be sent to every task.
    """
    s, n, r = (table(spark, folder, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    found = joined.select(
        F.col("s_suppkey"), F.col("s_nationkey"), F.col("s_name").alias("complex_name"), F.col("n_name").alias("dong"),
        F.col("r_name").alias("sigungu"),
    )
    return materialise(found, "places")


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as sale contracts of supplier complexes."""
    rows = table(spark, folder, "lineitem").join(places(spark, folder), F.col("l_suppkey") == F.col("s_suppkey"))
    area = F.col("l_quantity") * 3.0
    day = F.col("l_shipdate").cast("date")
    unit = F.col("l_extendedprice") / area
    return rows.select(
        F.col("l_suppkey").cast("string").alias("internal_complex_id"),
        F.col("l_suppkey").cast("string").alias("kapt_code"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("source_row_id"),
        F.col("l_orderkey"), F.col("l_partkey"),
        area.alias("area_sqm"), bands.area_group(area).alias("area_group"),
        F.col("l_extendedprice").alias("deal_amount_krw"), F.col("l_linenumber").alias("floor"),
        day.alias("deal_date"), months.month_label(day).alias("year_month"),
        (F.col("l_returnflag") == "R").alias("is_cancelled"),
        unit.alias("price_per_sqm"), (unit * 3.3).alias("price_per_3_3sqm"),
        (F.col("l_suppkey") % 45 + 1960).cast("int").alias("build_year"),
        months.is_provisional(months.month_index(day), AS_OF).alias("provisional"),
        "complex_name", "dong", "sigungu",
    )


def live_sales(spark: SparkSession, folder: str) -> DataFrame:
    return sales(spark, folder).where(~F.col("is_cancelled"))


def rents(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as rent contracts; a zero tax means deposit only."""
    rows = table(spark, folder, "lineitem").join(places(spark, folder), F.col("l_suppkey") == F.col("s_suppkey"))
    area, day = F.col("l_quantity") * 3.0, F.col("l_shipdate").cast("date")
    return rows.select(
        F.col("l_suppkey").cast("string").alias("internal_complex_id"), F.col("l_suppkey").cast("string").alias("kapt_code"),
        area.alias("area_sqm"), bands.area_group(area).alias("area_group"), months.month_label(day).alias("year_month"),
        day.alias("deal_date"), F.col("l_extendedprice").alias("deposit_krw"), F.col("l_tax").alias("monthly_rent_krw"),
        bands.rent_type(F.col("l_tax")).alias("rent_type"),
        months.is_provisional(months.month_index(day), AS_OF).alias("provisional"),
        "complex_name", "dong", "sigungu",
    )


def market_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as the sale side of the rent panel."""
    rows = table(spark, folder, "lineitem")
    area, day = F.col("l_quantity") * 3.0, F.col("l_shipdate").cast("date")
    return rows.select(
        F.col("l_suppkey").cast("string").alias("internal_complex_id"), F.col("l_suppkey").cast("string").alias("kapt_code"),
        bands.area_group(area).alias("area_group"), months.month_label(day).alias("year_month"),
        F.col("l_extendedprice").alias("deal_amount_krw"),
    )


def master(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as the complex register, with gaps in households, parking and coordinates."""
    k = F.col("s_suppkey")
    approval = F.date_add(F.lit("1940-01-01").cast("date"), ((k * 9973) % 22000).cast("int"))
    age = F.floor(F.datediff(F.lit(AS_OF).cast("date"), approval) / 365.2425).cast("int")
    households = F.when(k % 11 != 0, (200 + (k * 37) % 1800).cast("double"))
    parking = F.when(k % 7 != 0, (100 + (k * 53) % 2000).cast("double"))
    located = k % 13 != 0
    return places(spark, folder).select(
        k.cast("string").alias("kapt_code"), k.cast("string").alias("internal_complex_id"), "complex_name", "sigungu", "dong",
        households.alias("households"), approval.alias("approval_date"),
        F.when(k % 17 != 0, age).alias("apartment_age"), parking.alias("parking_total"),
        (parking / households).alias("parking_per_household"),
        F.when(located, 35 + (k % 100) / 100.0).alias("latitude"), F.when(located, 129 + (k % 50) / 100.0).alias("longitude"),
        F.concat(F.lit("길"), k.cast("string")).alias("road_address"), F.col("s_nationkey"),
        F.when(k % 19 != 0, F.lit("분양")).otherwise("임대").alias("sale_type"),
        F.when(k % 23 != 0, F.lit("아파트")).otherwise("연립").alias("building_type"),
    )


def area_register(spark: SparkSession, folder: str) -> DataFrame:
    """One area type per supplier and traded quantity, with validity bounds and a few faults."""
    pairs = table(spark, folder, "lineitem").select("l_suppkey", "l_quantity").distinct()
    k, q = F.col("l_suppkey"), F.col("l_quantity").cast("long")
    return pairs.select(
        k.cast("string").alias("kapt_code"), F.concat(F.lit("g"), q.cast("string")).alias("area_group_id"),
        (F.col("l_quantity") * 3.0).alias("exclusive_area_sqm"), (F.col("l_quantity") * 4.0).alias("supply_area_sqm"),
        F.concat(F.lit("T"), (q % 5).cast("string")).alias("type_name"),
        (10 + (k * 7 + q * 3) % 40).cast("double").alias("households"), F.lit("register").alias("source"),
        F.lit("2001-01-01").cast("date").alias("verified_at"),
        F.when(q % 4 == 0, F.date_add(F.lit("1996-01-01").cast("date"), (k % 1500).cast("int"))).alias("valid_from"),
        F.when((k % 27 == 9) & (q % 20 == 0), F.lit("1995-12-31").cast("date"))
        .when((k % 9 == 0) & (q % 10 == 0), F.lit("1999-12-31").cast("date")).alias("valid_to"),
        F.when((k % 31 == 5) & (q == 9), F.lit("draft")).when((k % 29 == 0) & (q == 7), F.lit("pending"))
        .otherwise("verified").alias("verification_status"),
        F.lit("sale_apartment").alias("scope"), F.lit("").alias("notes"),
        (k * 100 + q).alias("row"),
    )


def valued_complexes(spark: SparkSession, folder: str) -> DataFrame:
    """The register with households equal to the sum of its types for most complexes."""
    sums = area_register(spark, folder).groupBy("kapt_code").agg(F.sum("households").alias("_sum"))
    k = F.col("kapt_code").cast("long")
    return (
        master(spark, folder).join(sums, "kapt_code", "left")
        .withColumn("households", F.when(k % 6 != 0, F.coalesce("_sum", F.lit(0.0))).otherwise(F.lit(500.0))).drop("_sum")
    )


def district_code(key: str):
    """One of the configured district codes for a key, and one unknown code."""
    codes = [c for r in REGIONS.values() for c in r["lawd_codes"]] + ["99999"]
    return F.element_at(F.array(*[F.lit(c) for c in codes]), (F.pmod(F.col(key), F.lit(len(codes))) + 1).cast("int"))


# The twin of ``district_code`` in SQL.
def sql_district_code(column: str) -> str:
    codes = [c for r in REGIONS.values() for c in r["lawd_codes"]] + ["99999"]
    return f"([{', '.join(repr(c) for c in codes)}])[CAST({column} % {len(codes)} + 1 AS INTEGER)]"


def monthly_history(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly sums per supplier as a history of market values with rule versions."""
    day = F.col("l_shipdate").cast("date")
    rows = table(spark, folder, "lineitem").join(places(spark, folder), F.col("l_suppkey") == F.col("s_suppkey"))
    sums = rows.groupBy(months.month_label(day).alias("month"), F.col("l_suppkey"), "sigungu").agg(
        F.sum(F.floor("l_extendedprice").cast("long")).alias("cap"), F.count(F.lit(1)).alias("n")
    )
    k = F.col("l_suppkey")
    return sums.select(
        "month", k.cast("string").alias("kapt_code"), "sigungu", (400 + (k * 37) % 1800).cast("double").alias("households"),
        F.when(F.col("n") > 1, F.col("cap").cast("double")).alias("market_cap_krw"),
        (F.col("cap") / (400 + (k * 37) % 1800)).alias("per_household_krw"),
        F.when(F.col("n") % 5 == 0, "D").when(F.col("n") % 2 == 0, "B").otherwise("A").alias("grade"),
        F.when((k % 10 == 3) & (F.col("month") >= "1999-01"), "r2").otherwise("r1").alias("rules_hash"),
        (F.col("n") % 3).cast("string").alias("composition_hash"), (F.col("n") % 2).cast("string").alias("method_signature"),
        F.lit("i1").alias("input_hash"),
    )


def raw_sales(spark: SparkSession, folder: str, coarse: bool = False) -> DataFrame:
    """Line items as text records of the sale service, with unreadable parts.

    ``coarse`` rounds terms so that many records repeat.
    """
    rows = table(spark, folder, "lineitem").join(places(spark, folder), F.col("l_suppkey") == F.col("s_suppkey"))
    k, p, day = F.col("l_suppkey"), F.col("l_partkey"), F.col("l_shipdate").cast("date")
    amount = F.floor(F.col("l_extendedprice") / 30000) * 30000 if coarse else F.floor("l_extendedprice")
    text = lambda c: c.cast("string")
    return rows.select(
        F.concat_ws("-", *[F.lpad(text(F.col(c)), 9, "0") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("source_row_id"),
        F.when(p % 97 == 0, "n/a").otherwise(F.format_number(amount, 0)).alias("dealAmount"),
        text((F.col("l_quantity") if not coarse else F.ceil(F.col("l_quantity") / 10) * 10).cast("long") * 3).alias("excluUseAr"),
        F.when(p % 89 == 0, "지하").otherwise(text(F.lit(1) if coarse else F.col("l_linenumber"))).alias("floor"),
        text(F.year(day)).alias("dealYear"), text(F.month(day)).alias("dealMonth"),
        F.when(F.col("l_linenumber") == 7, "31").otherwise("15" if coarse else text(F.dayofmonth(day))).alias("dealDay"),
        text(k % 45 + 1960).alias("buildYear"), F.concat(F.lit(" "), "dong", F.lit(" 동")).alias("umdNm"),
        F.concat("complex_name", F.lit("("), text(k), F.lit("차) 아파트")).alias("aptNm"),
        F.concat(F.lit("0"), text(k % 30), F.lit("-"), text(k % 3)).alias("jibun"),
        F.when(F.col("l_returnflag") == "R", "01.05.02").otherwise("").alias("cdealDay"),
        F.when((F.col("l_returnflag") == "R") & (p % 2 == 0), "O").alias("cdealType"), district_code("l_suppkey").alias("lawd_cd"),
    )


def raw_rents(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as text records of the rent service."""
    rows = table(spark, folder, "lineitem")
    p, day = F.col("l_partkey"), F.col("l_shipdate").cast("date")
    text = lambda c: c.cast("string")
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("source_row_id"),
        F.format_number(F.floor("l_extendedprice"), 0).alias("deposit"),
        F.when(p % 53 == 0, F.lit(None)).otherwise(text(F.bround(F.col("l_tax") * 100).cast("int"))).alias("monthlyRent"),
        text(F.col("l_quantity") * 3).alias("excluUseAr"), F.year(day).alias("dealYear"), F.month(day).alias("dealMonth"),
        F.dayofmonth(day).alias("dealDay"), F.lit("[임대]").alias("aptNm"), F.col("l_suppkey").cast("string").alias("sggCd"),
    )


def raw_master(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as text records of the register service."""
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    used = F.date_add(F.lit("1940-01-01").cast("date"), ((k * 9973) % 22000).cast("int"))
    return places(spark, folder).select(
        F.concat(F.lit("A"), text(k)).alias("kaptCode"), F.concat(F.lit("[신]"), "complex_name", F.lit(" 아파트")).alias("kaptName"),
        F.concat(F.lit("부산광역시 중구  "), "dong", F.lit("동 "), F.when(k % 7 == 0, "산 ").otherwise(""), text(k % 30), F.lit("-"), text(k % 3), F.lit(" "), "complex_name").alias("kaptAddr"),
        F.concat(F.lit("부산광역시 중구 구"), text(F.col("s_nationkey")), F.lit("로 "), text(k + 1), F.lit("-"), text(k % 4)).alias("doroJuso"),
        F.when(k % 5 == 0, "0").otherwise(text(200 + (k * 37) % 1800)).alias("kaptdaCnt"), F.when(k % 10 != 0, text(100 + k % 77)).alias("hoCnt"),
        text(k % 12).alias("kaptDongCnt"), F.when(k % 13 == 0, "unknown").otherwise(F.date_format(used, "yyyyMMdd")).alias("kaptUsedate"),
        F.when(k % 7 != 0, text(k % 700)).alias("kaptdPcnt"), F.when(k % 14 != 0, text(k % 90)).alias("kaptdPcntu"),
        F.concat(district_code("s_suppkey"), F.lit("00000")).alias("bjdCode"), F.when(k % 8 == 0, "N").otherwise("Y").alias("useYn"),
        F.col("sigungu").alias("as2"), text(k).alias("supplier"),
    )


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Events as collection attempts; an error event is a failed attempt."""
    ts = F.col("ts").cast("timestamp")
    ok = F.col("event_type") != "error"
    return table(spark, folder, "events").select(
        F.when(F.col("user_id") % 2 == 0, "trade").otherwise("rent").alias("transaction_type"),
        F.date_format("ts", "yyyyMM").alias("year_month"),
        F.lpad((F.col("user_id") % 40).cast("string"), 5, "0").alias("lawd_cd"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("attempted_at"),
        F.when(ok, "success").otherwise("failed").alias("status"),
        F.when(ok, F.floor("value").cast("long")).alias("raw_count"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("batch_id"),
        F.when(~ok, F.lit("error")).alias("error"),
    )


def schools(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as schools: balance is the score, segment the level, nation the district."""
    c, n = table(spark, folder, "customer"), table(spark, folder, "nation")
    k = F.col("c_custkey")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        k.cast("string").alias("school_id"), F.col("c_name").alias("school_name"), F.col("c_mktsegment").alias("school_level"),
        F.when(k % 50 != 0, F.col("n_name")).alias("sigungu"), F.when(k % 31 != 0, F.col("c_acctbal")).alias("score"),
        F.when(k % 17 == 0, "Y").otherwise("N").alias("closed"), F.when(k % 23 == 0, "Y").alias("suspended"),
        (31.5 + (k % 80) / 10.0).alias("latitude"), F.when(k % 9 != 0, 123.5 + (k % 90) / 10.0).alias("longitude"),
    )


def _case(column: str, rows: list, pick: int) -> str:
    parts = [f"WHEN {column} < {b[0]} THEN '{b[pick]}'" for b in rows if b[0] is not None]
    return f"CASE WHEN {column} IS NULL THEN NULL {' '.join(parts)} ELSE '{rows[-1][pick]}' END"


def sql_area_group(column: str) -> str:
    return _case(column, bands.AREA_BANDS, 1)


def sql_area_label(column: str) -> str:
    return _case(column, bands.AREA_BANDS, 2)


_PLACES = "supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
SQL_MONTH = "strftime(l_shipdate, '%Y-%m')"
SQL_INDEX = "(year(l_shipdate) * 12 + month(l_shipdate) - 1)"

SQL = {
    "sales": f"""sales AS (
        SELECT CAST(l_suppkey AS VARCHAR) AS internal_complex_id, CAST(l_suppkey AS VARCHAR) AS kapt_code,
            concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS source_row_id, l_orderkey, l_partkey,
            l_quantity * 3.0 AS area_sqm, {sql_area_group('l_quantity * 3.0')} AS area_group,
            l_extendedprice AS deal_amount_krw, l_linenumber AS floor, CAST(l_shipdate AS DATE) AS deal_date,
            {SQL_MONTH} AS year_month, {SQL_INDEX} AS midx, l_returnflag = 'R' AS is_cancelled,
            l_extendedprice / (l_quantity * 3.0) AS price_per_sqm, l_extendedprice / (l_quantity * 3.0) * 3.3 AS price_per_3_3sqm,
            CAST(l_suppkey % 45 + 1960 AS INTEGER) AS build_year,
            {SQL_INDEX} >= 2001 * 12 + 10 - 1 AS provisional, s_name AS complex_name, n_name AS dong, r_name AS sigungu
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "live": "live AS (SELECT * FROM sales WHERE NOT is_cancelled)",
    "rents": f"""rents AS (
        SELECT CAST(l_suppkey AS VARCHAR) AS internal_complex_id, {sql_area_group('l_quantity * 3.0')} AS area_group,
            {SQL_MONTH} AS year_month, {SQL_INDEX} AS midx, l_extendedprice AS deposit_krw, l_tax AS monthly_rent_krw,
            CASE WHEN l_tax = 0 THEN '전세' WHEN l_tax > 0 THEN '월세' ELSE '미상' END AS rent_type,
            {SQL_INDEX} >= 2001 * 12 + 10 - 1 AS provisional, s_name AS complex_name, n_name AS dong, r_name AS sigungu
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "market": f"""market AS (
        SELECT CAST(l_suppkey AS VARCHAR) AS internal_complex_id, {sql_area_group('l_quantity * 3.0')} AS area_group,
            {SQL_MONTH} AS year_month, {SQL_INDEX} AS midx, l_extendedprice AS deal_amount_krw
        FROM lineitem)""",
    "master": f"""base AS (
        SELECT s_suppkey AS k, s_nationkey, s_name AS complex_name, r_name AS sigungu, n_name AS dong,
            CASE WHEN s_suppkey % 11 <> 0 THEN CAST(200 + (s_suppkey * 37) % 1800 AS DOUBLE) END AS households,
            DATE '1940-01-01' + CAST((s_suppkey * 9973) % 22000 AS INTEGER) AS approval_date,
            CASE WHEN s_suppkey % 7 <> 0 THEN CAST(100 + (s_suppkey * 53) % 2000 AS DOUBLE) END AS parking_total
        FROM {_PLACES}),
    master AS (
        SELECT CAST(k AS VARCHAR) AS kapt_code, CAST(k AS VARCHAR) AS internal_complex_id, complex_name, sigungu, dong, households,
            approval_date, parking_total, parking_total / households AS parking_per_household, s_nationkey,
            CASE WHEN k % 17 <> 0 THEN CAST(floor(date_diff('day', approval_date, DATE '{AS_OF}') / 365.2425) AS INTEGER) END AS apartment_age,
            CASE WHEN k % 13 <> 0 THEN 35 + (k % 100) / 100.0 END AS latitude,
            CASE WHEN k % 13 <> 0 THEN 129 + (k % 50) / 100.0 END AS longitude, concat('길', k) AS road_address,
            CASE WHEN k % 19 <> 0 THEN '분양' ELSE '임대' END AS sale_type,
            CASE WHEN k % 23 <> 0 THEN '아파트' ELSE '연립' END AS building_type
        FROM base)""",
    "area_register": """area_register AS (
        SELECT CAST(l_suppkey AS VARCHAR) AS kapt_code, 'g' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS area_group_id,
            l_quantity * 3.0 AS exclusive_area_sqm, l_quantity * 4.0 AS supply_area_sqm,
            'T' || CAST(CAST(l_quantity AS BIGINT) % 5 AS VARCHAR) AS type_name,
            CAST(10 + (l_suppkey * 7 + CAST(l_quantity AS BIGINT) * 3) % 40 AS DOUBLE) AS households,
            CASE WHEN CAST(l_quantity AS BIGINT) % 4 = 0 THEN DATE '1996-01-01' + CAST(l_suppkey % 1500 AS INTEGER) END AS valid_from,
            CASE WHEN l_suppkey % 27 = 9 AND CAST(l_quantity AS BIGINT) % 20 = 0 THEN DATE '1995-12-31' WHEN l_suppkey % 9 = 0 AND CAST(l_quantity AS BIGINT) % 10 = 0 THEN DATE '1999-12-31' END AS valid_to,
            CASE WHEN l_suppkey % 31 = 5 AND l_quantity = 9 THEN 'draft' WHEN l_suppkey % 29 = 0 AND l_quantity = 7 THEN 'pending' ELSE 'verified' END AS verification_status,
            l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS row
        FROM (SELECT DISTINCT l_suppkey, l_quantity FROM lineitem))""",
    "valued": """valued AS (
        SELECT m.* EXCLUDE (households), CASE WHEN CAST(m.kapt_code AS BIGINT) % 6 <> 0 THEN coalesce(s.total, 0) ELSE 500.0 END AS households
        FROM master m LEFT JOIN (SELECT kapt_code, sum(households) AS total FROM area_register GROUP BY 1) s USING (kapt_code))""",
    "history": f"""history AS (
        SELECT month, CAST(k AS VARCHAR) AS kapt_code, sigungu, CAST(400 + (k * 37) % 1800 AS DOUBLE) AS households,
            CASE WHEN n > 1 THEN CAST(cap AS DOUBLE) END AS market_cap_krw, cap / (400 + (k * 37) % 1800) AS per_household_krw,
            CASE WHEN n % 5 = 0 THEN 'D' WHEN n % 2 = 0 THEN 'B' ELSE 'A' END AS grade,
            CASE WHEN k % 10 = 3 AND month >= '1999-01' THEN 'r2' ELSE 'r1' END AS rules_hash,
            CAST(n % 3 AS VARCHAR) AS composition_hash, CAST(n % 2 AS VARCHAR) AS method_signature,
            CAST(substr(month, 1, 4) AS INTEGER) * 12 + CAST(substr(month, 6, 2) AS INTEGER) - 1 AS midx
        FROM (SELECT {SQL_MONTH} AS month, l_suppkey AS k, r_name AS sigungu, sum(CAST(floor(l_extendedprice) AS BIGINT)) AS cap, count(*) AS n
              FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
              JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3))""",
    "attempts": """attempts AS (
        SELECT CASE WHEN user_id % 2 = 0 THEN 'trade' ELSE 'rent' END AS transaction_type, strftime(ts, '%Y%m') AS year_month,
            lpad(CAST(user_id % 40 AS VARCHAR), 5, '0') AS lawd_cd, strftime(ts, '%Y-%m-%d %H:%M:%S') AS attempted_at,
            CASE WHEN event_type <> 'error' THEN 'success' ELSE 'failed' END AS status,
            CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) END AS raw_count,
            lpad(CAST(event_id AS VARCHAR), 12, '0') AS batch_id, CASE WHEN event_type = 'error' THEN 'error' END AS error
        FROM events)""",
    "schools": """schools AS (
        SELECT CAST(c_custkey AS VARCHAR) AS school_id, c_name AS school_name, c_mktsegment AS school_level,
            CASE WHEN c_custkey % 50 <> 0 THEN n_name END AS sigungu, CASE WHEN c_custkey % 31 <> 0 THEN c_acctbal END AS score,
            CASE WHEN c_custkey % 17 = 0 THEN 'Y' ELSE 'N' END AS closed, CASE WHEN c_custkey % 23 = 0 THEN 'Y' END AS suspended,
            31.5 + (c_custkey % 80) / 10.0 AS latitude, CASE WHEN c_custkey % 9 <> 0 THEN 123.5 + (c_custkey % 90) / 10.0 END AS longitude
        FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
}
SQL["monthly"] = """monthly AS (
    SELECT internal_complex_id, area_group, year_month, midx, count(*) AS transaction_count, median(deal_amount_krw) AS median_price,
        avg(deal_amount_krw) AS mean_price, median(price_per_sqm) AS median_price_per_sqm,
        median(price_per_3_3sqm) AS median_price_per_3_3sqm, min(sigungu) AS sigungu, min(dong) AS dong,
        min(complex_name) AS complex_name, max(provisional) AS provisional
    FROM live GROUP BY ALL)"""
SQL["filled"] = """spine AS (
    SELECT internal_complex_id, area_group, unnest(generate_series(first_m, (SELECT max(midx) FROM monthly))) AS midx
    FROM (SELECT internal_complex_id, area_group, min(midx) AS first_m FROM monthly GROUP BY ALL)),
filled AS (
    SELECT s.internal_complex_id, s.area_group, s.midx,
        CAST(s.midx // 12 AS VARCHAR) || '-' || lpad(CAST(s.midx % 12 + 1 AS VARCHAR), 2, '0') AS year_month,
        coalesce(m.transaction_count, 0)::DOUBLE AS transaction_count, m.median_price, m.mean_price, m.median_price_per_sqm,
        m.median_price_per_3_3sqm, p.sigungu, p.dong, p.complex_name, r.households, r.apartment_age, r.approval_date, r.parking_total,
        r.parking_per_household, s.midx IN (SELECT midx FROM monthly WHERE provisional) AS provisional
    FROM spine s LEFT JOIN monthly m USING (internal_complex_id, area_group, midx)
    JOIN (SELECT internal_complex_id, min(sigungu) AS sigungu, min(dong) AS dong, min(complex_name) AS complex_name FROM monthly GROUP BY 1) p
        USING (internal_complex_id)
    LEFT JOIN master r USING (internal_complex_id))"""


def _roll(n: int, fn: str, c: str) -> str:
    return f"{fn}({c}) OVER (PARTITION BY internal_complex_id, area_group ORDER BY midx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_SERIES = "(PARTITION BY internal_complex_id, area_group ORDER BY midx)"
_SOFAR = "(PARTITION BY internal_complex_id, area_group ORDER BY midx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
SQL["panel"] = f"""rolled AS (
    SELECT *, {', '.join(f"{_roll(n, 'sum', 'transaction_count')} AS transactions_{n}m, {_roll(n, 'median', 'median_price')} AS price_{n}m" for n in (3, 6, 12))},
        {_roll(3, 'median', 'median_price_per_sqm')} AS price_per_sqm_3m, {_roll(3, 'median', 'median_price_per_3_3sqm')} AS price_per_3_3sqm_3m,
        last_value(median_price IGNORE NULLS) OVER {_SOFAR} AS path
    FROM filled),
panel AS (
    SELECT *, {', '.join(f"price_{n}m / nullif(lag(price_{n}m, {n}) OVER {_SERIES}, 0) - 1 AS return_{n}m" for n in (3, 6, 12))},
        transactions_12m / nullif(lag(transactions_12m, 12) OVER {_SERIES}, 0) - 1 AS transaction_yoy,
        transactions_12m / nullif(households, 0) AS turnover_12m,
        max(path) OVER {_SOFAR} AS rolling_peak, min(path) OVER {_SOFAR} AS rolling_trough,
        path / nullif(max(path) OVER {_SOFAR}, 0) - 1 AS drawdown_from_peak,
        path / nullif(min(path) OVER {_SOFAR}, 0) - 1 AS recovery_from_trough,
        transactions_6m AS sample_count, transactions_6m < 3 AS low_sample_flag
    FROM rolled)"""
SQL["summary"] = """latest AS (
    SELECT * FROM panel QUALIFY midx = max(midx) OVER (PARTITION BY internal_complex_id, area_group)),
summary AS (
    SELECT internal_complex_id, min(complex_name) AS complex_name, min(sigungu) AS sigungu, min(dong) AS dong, min(households) AS households,
        min(approval_date) AS approval_date, min(apartment_age) AS apartment_age, min(parking_total) AS parking_total,
        min(parking_per_household) AS parking_per_household, sum(transactions_3m) AS transactions_3m, sum(transactions_6m) AS transactions_6m,
        sum(transactions_12m) AS transactions_12m, count(DISTINCT area_group) AS area_variety, max(provisional) AS provisional,
        sum(transactions_12m) / nullif(min(households), 0) AS turnover_12m,
        max(CASE WHEN area_group = '80_90' THEN price_3m END) AS price_84,
        max(CASE WHEN area_group = '80_90' THEN price_per_3_3sqm_3m END) AS price_84_per_3_3sqm,
        max(CASE WHEN area_group = '80_90' THEN return_3m END) AS price_change_3m,
        max(CASE WHEN area_group = '80_90' THEN return_6m END) AS price_change_6m,
        max(CASE WHEN area_group = '80_90' THEN return_12m END) AS price_change_12m,
        max(CASE WHEN area_group = '80_90' THEN rolling_peak END) AS rolling_peak,
        max(CASE WHEN area_group = '80_90' THEN drawdown_from_peak END) AS drawdown_from_peak,
        max(CASE WHEN area_group = '80_90' THEN rolling_trough END) AS rolling_trough,
        max(CASE WHEN area_group = '80_90' THEN recovery_from_trough END) AS recovery_from_trough,
        max(CASE WHEN area_group = '80_90' THEN sample_count END) AS sample_count,
        bool_or(low_sample_flag) FILTER (area_group = '80_90') AS low_sample_flag
    FROM latest GROUP BY 1)"""
_NEEDS = {
    "live": ["sales"], "monthly": ["live"], "filled": ["monthly", "master"], "panel": ["filled"], "summary": ["panel"],
    "valued": ["master", "area_register"],
}


def with_views(*names: str) -> str:
    """A WITH clause that defines the named views and everything they need."""
    ordered: dict[str, None] = {}

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        ordered[name] = None

    for name in names:
        add(name)
    return "WITH " + ",\n".join(SQL[n] for n in ordered) + "\n"
