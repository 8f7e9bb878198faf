"""Registered queries: collection plans, status, payloads, snapshots and incremental builds."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import builds
from ..operators import panel
from ..operators.regions import region_dimension
from ..session import materialise
from ..sources import payloads, readers, snapshots, status, writers
from . import adapters as a
from .contracts import _PLAIN
from .registry import query
from .shape import settle

_ATTEMPTS = "WITH " + a.SQL["attempts"]
_KEYS = "transaction_type, year_month, lawd_cd"
_ORDER = "attempted_at || batch_id"
_STATUS = f"""status_rows AS (SELECT {_KEYS}, max(attempted_at) AS attempted_at, arg_max(status, {_ORDER}) AS last_attempt_status, arg_max(batch_id, {_ORDER}) AS last_attempt_batch_id,
    max(attempted_at) FILTER (status = 'success') AS successful_at, arg_max(raw_count, {_ORDER}) FILTER (status = 'success') AS raw_count,
    arg_max(batch_id, {_ORDER}) FILTER (status = 'success') AS batch_id, CASE WHEN bool_or(status = 'success') THEN 'success' ELSE 'failed' END AS status FROM attempts GROUP BY ALL)"""
_FIELDS = ["transaction_type", "year_month", "lawd_cd", "attempted_at", "last_attempt_status", "last_attempt_batch_id", "successful_at", "raw_count", "batch_id", "status"]


@query("latest_status", f"{_ATTEMPTS}, {_STATUS} SELECT * FROM status_rows")
def latest_status(spark, folder):
    return status.latest_status(a.attempts(spark, folder)).select(*_FIELDS)


@query("upserted_status", f"{_ATTEMPTS}, {_STATUS} SELECT * FROM status_rows")
def upserted_status(spark, folder):
    """Status after two batches of attempts equals the status over all of them."""
    rows = a.attempts(spark, folder)
    early = status.latest_status(rows.where("attempted_at < '2024-01-16'"))
    return status.upsert_status(early, rows.where("attempted_at >= '2024-01-16'")).select(*_FIELDS)


def _landed(spark, folder):
    """Landed partitions as orders tell them, apart from the log of attempts: rows unless unreadable."""
    k = F.col("o_orderkey")
    rows = a.table(spark, folder, "orders").select(
        F.when(k % 2 == 0, "trade").otherwise("rent").alias("transaction_type"), F.concat(F.lit("2024"), F.lpad((k % 3 + 1).cast("string"), 2, "0")).alias("year_month"),
        F.lpad((F.col("o_custkey") % 45).cast("string"), 5, "0").alias("lawd_cd"), k.alias("k"),
    )
    out = rows.groupBy("transaction_type", "year_month", "lawd_cd").agg(F.sum("k").alias("s"), F.count(F.lit(1)).alias("n"))
    return out.select("transaction_type", "year_month", "lawd_cd", F.when(F.col("s") % 7 != 0, F.col("n")).alias("row_count"))


def _districts(spark, folder):
    """Districts of suppliers; some codes of attempts and landings are none of them."""
    u = a.table(spark, folder, "supplier").select(F.lpad((F.col("s_suppkey") % 43).cast("string"), 5, "0").alias("lawd_cd")).distinct()
    return u.withColumn("sigungu", F.concat(F.lit("d"), "lawd_cd"))


def _records(spark, folder):
    return status.backfill_status(status.latest_status(a.attempts(spark, folder)), _landed(spark, folder), _districts(spark, folder))


_RECORDS = f"""{_STATUS},
landed AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'trade' ELSE 'rent' END AS transaction_type, '2024' || lpad(CAST(o_orderkey % 3 + 1 AS VARCHAR), 2, '0') AS year_month,
    lpad(CAST(o_custkey % 45 AS VARCHAR), 5, '0') AS lawd_cd, CASE WHEN sum(o_orderkey) % 7 <> 0 THEN count(*) END AS n FROM orders GROUP BY 1, 2, 3),
records AS (SELECT {_KEYS}, CASE WHEN s.attempted_at IS NOT NULL THEN s.status WHEN n IS NOT NULL THEN 'success' ELSE 'unreadable' END AS status,
    CAST(CASE WHEN s.attempted_at IS NOT NULL THEN s.raw_count ELSE n END AS BIGINT) AS raw_count, 'd' || lawd_cd AS region_name,
    CASE WHEN s.attempted_at IS NOT NULL THEN l.f IS NOT NULL ELSE n IS NOT NULL END AS data_available, successful_at
    FROM status_rows s FULL JOIN (SELECT *, 1 AS f FROM landed) l USING ({_KEYS}) WHERE lawd_cd IN (SELECT lpad(CAST(s_suppkey % 43 AS VARCHAR), 5, '0') FROM supplier))"""


@query("backfilled_status", f"{_ATTEMPTS}, {_RECORDS} SELECT {_KEYS}, status, raw_count, region_name, data_available FROM records")
def backfilled_status(spark, folder):
    return _records(spark, folder).select("transaction_type", "year_month", "lawd_cd", "status", "raw_count", "region_name", "data_available")


@query(
    "status_summary",
    f"""{_ATTEMPTS}, {_RECORDS}, {a.with_views('live')[5:]}, good AS (SELECT * FROM records WHERE status = 'success' AND coalesce(data_available, true))
    SELECT (SELECT min(year_month) FROM live) AS period_start, (SELECT max(substr(year_month, 1, 4) || '-' || substr(year_month, 5)) FROM good) AS period_end, 0::BIGINT AS transaction_count,
    (SELECT count(DISTINCT lawd_cd) FROM good WHERE year_month = (SELECT max(year_month) FROM good)) AS successful_regions, 0::BIGINT AS reflected_count, 43::BIGINT AS target_regions,
    CASE WHEN (SELECT count(DISTINCT lawd_cd) FROM good WHERE year_month = (SELECT max(year_month) FROM good)) = 43 THEN 'complete' ELSE 'partial' END AS collection_status,
    (SELECT min(successful_at) FROM good WHERE year_month = (SELECT max(year_month) FROM good)) AS success_time_start, (SELECT max(successful_at) FROM good WHERE year_month = (SELECT max(year_month) FROM good)) AS success_time_end""",
)
def status_summary(spark, folder):
    """The latest landing lies after the panel: it counts as the latest month with zero contracts."""
    rows = a.live_sales(spark, folder).groupBy("year_month").agg(F.count(F.lit(1)).alias("transaction_count"))
    out = status.status_summary(materialise(_records(spark, folder), "records"), rows, 43, ["transaction_count"])
    return settle(out)


@query(
    "region_counts",
    f"""{_ATTEMPTS}, {_RECORDS}, done AS (SELECT lpad(CAST(l_suppkey % 40 AS VARCHAR), 5, '0') AS lawd_cd, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT transaction_type, lawd_cd, coalesce(n, 0) AS processed_count FROM records LEFT JOIN done USING (lawd_cd) WHERE year_month = '202401'""",
)
def region_counts(spark, folder):
    matched = a.table(spark, folder, "lineitem").select(F.lit("2024-01").alias("year_month"), (F.col("l_suppkey") % 40).cast("string").alias("lawd_cd"))
    return status.region_counts(_records(spark, folder), matched, "2024-01").select("transaction_type", "lawd_cd", "processed_count")


def _landed_partitions(spark, folder):
    """Month and district of every contract as landed partitions."""
    rows = a.table(spark, folder, "lineitem")
    return rows.select(F.date_format("l_shipdate", "yyyyMM").alias("ym"), a.district_code("l_suppkey").alias("lawd_cd")).distinct()


_DIM = "(SELECT DISTINCT region_code AS lawd_cd FROM (VALUES " + ", ".join(f"('{c}')" for r in a.REGIONS.values() for c in r["lawd_codes"]) + ") AS d(region_code))"
_TARGETS = f"""targets AS (SELECT strftime(m, '%Y%m') AS ym, lawd_cd FROM {_DIM}, (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2002-06-01', INTERVAL 1 MONTH)) AS m)),
landed AS (SELECT DISTINCT strftime(l_shipdate, '%Y%m') AS ym, {a.sql_district_code('l_suppkey')} AS lawd_cd FROM lineitem)"""


@query("collection_plan", f"WITH {_TARGETS} SELECT * FROM targets WHERE (ym, lawd_cd) NOT IN (SELECT (ym, lawd_cd) FROM landed)")
def collection_plan(spark, folder):
    targets = writers.collection_targets(region_dimension(spark, a.REGIONS), "199501", "200206")
    return writers.collection_plan(targets, _landed_partitions(spark, folder))


@query(
    "collection_plan_counts",
    f"WITH {_TARGETS} SELECT count(*) AS targets, count(*) FILTER ((ym, lawd_cd) IN (SELECT (ym, lawd_cd) FROM landed)) AS existing, count(*) FILTER ((ym, lawd_cd) NOT IN (SELECT (ym, lawd_cd) FROM landed)) AS to_collect FROM targets",
)
def collection_plan_counts(spark, folder):
    targets = writers.collection_targets(region_dimension(spark, a.REGIONS), "199501", "200206")
    return writers.collection_plan_counts(targets, _landed_partitions(spark, folder))


@query(
    "xml_payloads",
    "SELECT l_orderkey, 2::BIGINT AS total_count, unnest([CAST(l_linenumber AS VARCHAR), CAST(l_linenumber + 1 AS VARCHAR)]) AS floor, unnest([CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)]) AS part FROM lineitem",
)
def xml_payloads(spark, folder):
    """Every contract written as an XML answer with two items and parsed back."""
    text = lambda c: c.cast("string")
    item = lambda n, p: F.concat(F.lit("<item><floor>"), text(n), F.lit("</floor><part>"), text(p), F.lit("</part></item>"))
    n = F.col("l_linenumber")
    answer = F.concat(
        F.lit("<response><header><resultCode>000</resultCode><resultMsg>OK</resultMsg></header><body><items>"), item(n, F.col("l_partkey")),
        item(n + 1, F.col("l_suppkey")), F.lit("</items><totalCount>2</totalCount></body></response>"),
    )
    rows = a.table(spark, folder, "lineitem").select("l_orderkey", answer.alias("payload"))
    return settle(payloads.parse_xml(rows, "floor:string,part:string"))


@query(
    "json_payloads",
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN 1 ELSE 2 END::BIGINT AS total_count, unnest(CASE o_orderkey % 4 WHEN 2 THEN ['a' || o_orderkey] ELSE ['a' || o_orderkey, 'b' || o_orderkey] END) AS kaptCode FROM orders",
)
def json_payloads(spark, folder):
    """The four wrappings of JSON answers."""
    k = F.col("o_orderkey").cast("string")
    one = lambda p: F.concat(F.lit('{"kaptCode":"' + p), k, F.lit('"}'))
    both = F.concat(F.lit("["), one("a"), F.lit(","), one("b"), F.lit("]"))
    kind = F.col("o_orderkey") % 4
    total = F.when(kind == 2, "1").otherwise("2")
    body = (
        F.when(kind == 0, F.concat(F.lit('"items":'), both)).when(kind == 1, F.concat(F.lit('"items":{"item":'), both, F.lit("}")))
        .when(kind == 2, F.concat(F.lit('"items":'), one("a"))).otherwise(F.concat(F.lit('"item":'), both))
    )
    text = F.concat(F.lit('{"response":{"body":{'), body, F.lit(',"totalCount":'), total, F.lit("}}}"))
    rows = a.table(spark, folder, "orders").select("o_orderkey", text.alias("payload"))
    return settle(payloads.parse_json(rows, "kaptCode string"))


@query("run_ids", "SELECT o_orderkey, substr(sha256(concat_ws(':', strftime(o_orderdate, '%Y-%m'), o_orderpriority, 'r1', 'm1')), 1, 24) AS run_id FROM orders")
def run_ids(spark, folder):
    rid = snapshots.run_id(F.date_format("o_orderdate", "yyyy-MM"), F.col("o_orderpriority"), F.lit("r1"), F.lit("m1"))
    return a.table(spark, folder, "orders").select("o_orderkey", rid.alias("run_id"))


def _manifest(spark, folder):
    """Orders as snapshot runs: every order is one revision of its month."""
    o = a.table(spark, folder, "orders")
    return o.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderkey").alias("revision"))


@query("latest_revisions", "SELECT strftime(o_orderdate, '%Y-%m') AS month, max(o_orderkey) AS revision FROM orders GROUP BY 1")
def latest_revisions(spark, folder):
    return snapshots.select_revisions(_manifest(spark, folder), "latest").select("month", "revision")


@query("first_revisions", "SELECT strftime(o_orderdate, '%Y-%m') AS month, min(o_orderkey) AS revision FROM orders GROUP BY 1")
def first_revisions(spark, folder):
    return snapshots.select_revisions(_manifest(spark, folder), "first").select("month", "revision")


@query("new_runs", "SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(o_orderkey AS VARCHAR) AS run_id FROM orders WHERE o_orderkey % 3 = 1")
def new_runs(spark, folder):
    runs = _manifest(spark, folder).select("month", "run_id")
    return snapshots.new_runs(runs, runs.where(F.col("run_id").cast("long") % 3 != 1))


@query(
    "incremental_panel",
    a.with_views("monthly") + "SELECT internal_complex_id, area_group, year_month, transaction_count, round(median_price + 0.00000001, 6) AS median_price, CASE WHEN year_month >= '2001-10' THEN true ELSE false END AS provisional FROM monthly",
)
def incremental_panel(spark, folder):
    """The panel rebuilt from a month on equals the panel built in one go."""
    rows = a.live_sales(spark, folder)
    history = panel.monthly_sales(rows.where("year_month < '2001-05'"))
    recent = panel.monthly_sales(rows.where("year_month >= '2001-03'"))
    out = status.merge_incremental(history, recent, "2001-03", a.AS_OF)
    return settle(out, "internal_complex_id", "area_group", "year_month", "transaction_count", "median_price", "provisional")


@query("latest_month", "SELECT max(strftime(l_shipdate, '%Y-%m')) AS year_month FROM lineitem")
def latest_month(spark, folder):
    return readers.latest_month(a.sales(spark, folder).select("year_month"))


@query("first_rows_per_file", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10")
def first_rows_per_file(spark, folder):
    df = readers.read_landed(spark, f"{folder}/lineitem.parquet")
    return settle(readers.first_rows_per_file(df, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]), "l_orderkey", "l_linenumber")


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_NULLS = " UNION ALL ".join(
    f"""SELECT '{t}' AS family, column_name, (SELECT count(*) FROM {t}) AS row_count, CAST(null_count AS BIGINT) AS null_count
    FROM (UNPIVOT (SELECT count_if(COLUMNS('(.*)') IS NULL) AS "\\1" FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE null_count)"""
    for t in TABLES
)


@query("file_profile", _NULLS)
def file_profile(spark, folder):
    """Rows and nulls of every column of every given table."""
    return readers.profile_tables(spark, {t: f"{folder}/{t}.parquet" for t in TABLES}).select("family", "column_name", "row_count", "null_count")


@query("rows_per_source_file", "SELECT 'lineitem' AS family, count(*) AS row_count, 0::BIGINT AS null_dates FROM lineitem")
def rows_per_source_file(spark, folder):
    """Rows and nulls per source file."""
    df = readers.read_landed(spark, f"{folder}/lineitem.parquet").withColumn("family", readers.path_stem(F.col("source_file")))
    return df.groupBy("family").agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("l_shipdate").isNull()).alias("null_dates"))


@query("data_version")
def data_version(spark, folder):
    """A fingerprint over name, size and time of the files behind a table; file times are not visible to SQL."""
    return status.data_version(status.file_facts(a.table(spark, folder, "lineitem")))


@query("rebuild_window", "SELECT strftime(max(l_shipdate) - INTERVAL 1 MONTH, '%Y-%m') AS rebuild_from, '' AS full_rebuild_reason, 0::BIGINT AS changed_files FROM lineitem")
def rebuild_window(spark, folder):
    files = readers.read_landed(spark, f"{folder}/lineitem.parquet").select("source_file", "source_time")
    built = F.current_timestamp()
    return settle(status.rebuild_window(a.sales(spark, folder), built, files, files))


_BUILT = f"""{_PLAIN}, sold AS (SELECT * FROM cleaned QUALIFY row_number() OVER (PARTITION BY region_code, dong, jibun, complex_name_normalized, area_sqm, floor, deal_date, deal_amount_krw ORDER BY source_row_id DESC) = 1),
sales AS (SELECT strftime(deal_date, '%Y-%m') AS year_month, deal_amount_krw FROM sold WHERE NOT is_cancelled AND deal_date IS NOT NULL),
rents AS (SELECT strftime(l_shipdate, '%Y-%m') AS year_month, l_tax FROM lineitem WHERE l_partkey % 53 <> 0)"""


@query(
    "incremental_build",
    f"""WITH {_BUILT} SELECT 'sales' AS market, year_month, count(*) AS contract_count, year_month >= '2001-10' AS provisional, year_month >= '2001-03' AS aggregated_anew FROM sales GROUP BY 2
    UNION ALL SELECT 'rents', year_month, count(*), year_month >= '2001-10', year_month >= '2001-03' FROM rents GROUP BY 2
    UNION ALL SELECT 'sales beside rents', year_month, count(*), false, year_month >= '2001-03' FROM sales GROUP BY 2""",
)
def incremental_build(spark, folder):
    """Both markets built up to a month and continued from an earlier month on: contracts of every month, and which months were aggregated anew."""
    sales, register = a.raw_sales(spark, folder), a.raw_master(spark, folder)
    rents = a.raw_rents(spark, folder).withColumn("dealMonth", F.lpad(F.col("dealMonth").cast("string"), 2, "0"))
    label = F.concat_ws("-", "dealYear", F.lpad("dealMonth", 2, "0"))
    before, after = label < "2001-05", label >= "2001-03"
    early = builds.full_build(sales.where(before), register, "2001-04-30", "source_row_id", raw_rents=rents.where(before))
    late = builds.incremental_build(early, sales.where(after), register, "2001-03", a.AS_OF, "source_row_id", raw_recent_rents=rents.where(after))
    flag = F.coalesce(F.max("provisional"), F.lit(False)).alias("provisional")
    rented = F.coalesce("jeonse_count", F.lit(0)) + F.coalesce("monthly_rent_count", F.lit(0))
    parts = [("sales", late.monthly, F.col("transaction_count"), flag), ("rents", late.rents.monthly, rented, flag), ("sales beside rents", late.rents.monthly, F.coalesce("sale_count", F.lit(0)), F.lit(False).alias("provisional"))]
    anew = late.written.distinct().withColumn("_anew", F.lit(True)).withColumnRenamed("market", "_market")
    out = None
    for name, monthly, count, provisional in parts:
        rows = monthly.groupBy("year_month").agg(F.sum(count).alias("contract_count"), provisional).where("contract_count > 0 AND year_month IS NOT NULL")
        own = anew.where(F.col("_market") == ("sales" if name == "sales" else "rents")).drop("_market")
        rows = rows.join(own, "year_month", "left").select(F.lit(name).alias("market"), "year_month", "contract_count", "provisional", F.coalesce("_anew", F.lit(False)).alias("aggregated_anew"))
        out = rows if out is None else out.unionByName(rows)
    return out
