"""Registered queries: similarity, tiered matching, review lists and the rent crosswalk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands, similarity
from ..functions.text import normalize_name
from ..operators import clean, match, names, rent
from ..session import materialise
from . import adapters as a
from .registry import query
from .shape import settle


def lcs_sql(left: str, right: str) -> str:
    """Longest common subsequence of two short texts in SQL: one row of lengths per character."""
    start = f"list_transform(range(0, length({right}) + 1), lambda j: 0)"
    chars = f"list_transform(string_split({left}, ''), lambda c: list_transform(range(0, length({right}) + 1), lambda j: CASE WHEN j > 0 AND substr({right}, CAST(j AS INTEGER), 1) = c THEN 1 ELSE 0 END))"
    body = """list_transform(range(0, len(prev)), lambda j: list_max(list_transform(range(0, j + 1), lambda i:
        CASE WHEN i > 0 AND hit[i + 1] = 1 THEN prev[i] + 1 ELSE prev[i + 1] END)))"""
    return f"list_max(list_reduce(list_prepend({start}, {chars}), lambda prev, hit: {body}))"


@query(
    "name_similarity",
    f"""WITH pairs AS (SELECT DISTINCT p.p_name AS left_name, q.p_name || ' ' || lower(q.p_type) AS right_name FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1)
    SELECT left_name, right_name, round(200.0 * {lcs_sql('left_name', 'right_name')} / (length(left_name) + length(right_name)) + 0.00000001, 6) AS score FROM pairs""",
)
def name_similarity(spark, folder):
    part = a.table(spark, folder, "part")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("right_name"))
    pairs = part.select("p_partkey", F.col("p_name").alias("left_name")).join(after, "p_partkey").select("left_name", "right_name").distinct()
    return settle(pairs.withColumn("score", similarity.name_similarity("left_name", "right_name")))


@query(
    "best_names",
    f"""WITH lefts AS (SELECT DISTINCT p_brand AS block, upper(p_name) || p_size AS name FROM part WHERE p_partkey % 2 = 0),
    rights AS (SELECT p_brand AS block, upper(p_name) || (p_size % 7) AS name, min(lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS master_order FROM part WHERE p_partkey % 2 = 1 GROUP BY 1, 2),
    scored AS (SELECT l.block, l.name, master_order, 200.0 * {lcs_sql('l.name', 'r.name')} / (length(l.name) + length(r.name)) AS score
        FROM lefts l JOIN rights r ON l.block = r.block)
    SELECT block, name, round(score + 0.00000001, 6) AS score, master_order FROM scored QUALIFY row_number() OVER (PARTITION BY block, name ORDER BY score DESC, master_order) = 1""",
)
def best_names(spark, folder):
    """The best odd part for every even part of a brand, compared in bounded chunks."""
    part = a.table(spark, folder, "part")
    even = F.col("p_partkey") % 2 == 0
    lefts = part.where(even).select(F.col("p_brand").alias("block"), F.concat(F.upper("p_name"), F.col("p_size").cast("string")).alias("name"))
    rights = part.where(~even).select(
        F.col("p_brand").alias("block"), F.concat(F.upper("p_name"), (F.col("p_size") % 7).cast("string")).alias("name"),
        F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("master_order"),
    )
    return settle(names.best_names(lefts, rights))


def register(spark, folder):
    return clean.clean_master(a.raw_master(spark, folder), a.AS_OF).withColumn("sigungu", F.lit("중구"))


def contracts(spark, folder):
    """Contracts whose addresses agree with the register to a degree set by the part number.

    0 road and lot, 1 road only, 2 lot only, 3 main numbers, 4 name in the same dong, 5 nothing.
    """
    rows = a.table(spark, folder, "lineitem").join(a.places(spark, folder), F.col("l_suppkey") == F.col("s_suppkey"))
    k, kind = F.col("l_suppkey"), F.col("l_partkey") % 6
    text = lambda c: c.cast("string")
    hill = F.when(k % 7 == 0, "산").otherwise("")
    lot = F.concat(hill, text(k % 30), F.lit("-"), text(k % 3))
    has_road = kind.isin(0, 1, 3)
    return rows.select(
        a.district_code("l_suppkey").alias("lawd_cd"), F.lit("중구").alias("sigungu"),
        F.when(kind == 5, "먼동").otherwise(F.concat("dong", F.lit("동"))).alias("dong"),
        F.when(kind.isin(0, 2), lot).when(kind == 3, F.concat(text(k % 30), F.lit("-99"))).otherwise(F.concat(F.lit("9"), text(k % 30))).alias("jibun"),
        F.when(kind == 4, F.concat("complex_name", F.lit("차"))).when(kind == 2, F.concat("complex_name", F.lit("동"))).when(kind == 5, "모름").otherwise(F.col("complex_name")).alias("complex_name"),
        F.when(has_road, F.concat(F.lit("구"), text(F.col("s_nationkey")), F.lit("로"))).alias("road_name"),
        F.when(has_road, text(k + 1)).alias("road_main"), F.when(kind == 3, "77").when(has_road, text(k % 4)).alias("road_sub"),
        F.col("l_extendedprice").alias("deal_amount_krw"), F.col("l_shipdate").cast("date").alias("deal_date"), (F.col("l_returnflag") == "R").alias("is_cancelled"),
        "l_orderkey", "l_partkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("transaction_id"), kind.alias("kind"),
    )


def match_log(spark, folder):
    return match.resolve(contracts(spark, folder), register(spark, folder), strict_regions=["48250", "48330"])


_MATCHED = f"""keyed AS (SELECT l_suppkey AS k, l_partkey % 6 AS kind, {a.sql_district_code('l_suppkey')} AS lawd_cd, n_name || '동' AS dong, 'supplier' || substr(s_name, 10) AS name,
        CASE WHEN l_suppkey % 7 = 0 THEN '산' ELSE '' END || (l_suppkey % 30) || '-' || (l_suppkey % 3) AS lot FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
register AS (SELECT s_suppkey AS k, {a.sql_district_code('s_suppkey')} AS code, n_name || '동' AS mdong, 'supplier' || substr(s_name, 10) AS mname FROM supplier JOIN nation ON s_nationkey = n_nationkey),
distinct_keys AS (SELECT k, kind, lawd_cd, CASE WHEN kind = 5 THEN '먼동' ELSE dong END AS dong,
        CASE WHEN kind IN (0, 2) THEN lot WHEN kind = 3 THEN (k % 30) || '-99' ELSE '9' || (k % 30) END AS jibun,
        CASE WHEN kind = 4 THEN name || '차' WHEN kind = 2 THEN name || '동' WHEN kind = 5 THEN '모름' ELSE name END AS name, lawd_cd IN ('48250', '48330') AS strict, count(*) AS contract_count
        FROM keyed GROUP BY ALL),
near AS (SELECT d.k, count(*) AS n, max(200.0 * {lcs_sql('d.name', 'r.mname')} / (length(d.name) + length(r.mname))) AS score
        FROM distinct_keys d JOIN register r ON d.lawd_cd = r.code AND d.dong = r.mdong WHERE d.kind = 4 GROUP BY 1),
resolved AS (SELECT d.*, CASE WHEN kind = 0 THEN 'road_legal_address_exact' WHEN kind = 2 THEN 'legal_address_exact' WHEN strict OR kind = 5 THEN 'unmatched'
        WHEN kind = 1 THEN 'road_address_exact' WHEN kind = 3 THEN 'road_address_main' ELSE 'dong_fuzzy' END AS match_method,
        CASE WHEN kind IN (0, 2) THEN 100.0 WHEN strict OR kind = 5 THEN 0.0 WHEN kind = 4 THEN score ELSE 100.0 END AS match_score,
        CASE WHEN kind IN (0, 2) THEN 1 WHEN strict OR kind = 5 THEN 0 WHEN kind = 4 THEN n ELSE 1 END AS candidate_count FROM distinct_keys d LEFT JOIN near USING (k)),
log AS (SELECT *, CASE WHEN match_method <> 'unmatched' THEN 'A' || k END AS kapt_code FROM resolved)"""


@query(
    "match_log",
    f"""WITH {_MATCHED} SELECT DISTINCT lawd_cd, dong, jibun, name AS complex_name_normalized, kapt_code, match_method, round(match_score + 0.00000001, 6) AS match_score,
    CAST(candidate_count AS BIGINT) AS candidate_count, match_method = 'unmatched' AS manual_review,
    coalesce(kapt_code, 'TRADE_' || upper(substr(sha1(concat_ws('|', lawd_cd, dong, jibun, name)), 1, 12))) AS internal_complex_id,
    CASE WHEN strict THEN 'strict_full_lot' ELSE 'standard' END AS legal_address_policy FROM log""",
)
def match_log_query(spark, folder):
    """The tiers over all contract keys; the check works because every key has a known answer."""
    return settle(match_log(spark, folder), *match.KEYS, "kapt_code", "match_method", "match_score", "candidate_count", "manual_review", "internal_complex_id", "legal_address_policy")


@query("match_methods", f"WITH {_MATCHED} SELECT match_method, count(*) AS complex_count FROM (SELECT DISTINCT lawd_cd, dong, jibun, name, match_method FROM log) GROUP BY 1")
def match_methods(spark, folder):
    return settle(match.method_summary(materialise(match_log(spark, folder), "log")), "match_method", "complex_count")


@query(
    "match_rates",
    f"""WITH {_MATCHED}, one AS (SELECT DISTINCT lawd_cd, dong, jibun, name, match_method, kapt_code FROM log)
    SELECT round(count(*) FILTER (match_method LIKE '%address_exact%') / count(*) * 100, 2) AS exact_pct, round(count(kapt_code) / count(*) * 100, 2) AS matched_pct,
    round(count(DISTINCT kapt_code) / (SELECT count(*) FROM supplier) * 100, 2) AS kapt_coverage_pct FROM one""",
)
def match_rates(spark, folder):
    df = match.match_rates(materialise(match_log(spark, folder), "log"), register(spark, folder))
    return df.select("exact_pct", "matched_pct", "kapt_coverage_pct")


@query(
    "matched_contracts",
    f"WITH {_MATCHED} SELECT match_method, kind, CAST(sum(contract_count) AS BIGINT) AS contract_count, CAST(coalesce(sum(contract_count) FILTER (kapt_code IS NOT NULL), 0) AS BIGINT) AS matched_count FROM log GROUP BY 1, 2",
)
def matched_contracts(spark, folder):
    """Contracts per match method after the results were written back."""
    log = materialise(match_log(spark, folder), "log")
    rows = contracts(spark, folder).withColumn("complex_name_normalized", normalize_name(F.col("complex_name")))
    out = match.attach_matches(rows, log)
    return out.groupBy("match_method", "kind").agg(F.count(F.lit(1)).alias("contract_count"), F.count("kapt_code").alias("matched_count"))


_REVIEW = ["lawd_cd", "dong", "jibun", "complex_name_normalized", "transaction_count", "first_deal_date", "last_deal_date", "median_deal_amount_krw", "candidate_kapt_code",
           "candidate_evidence", "existing_candidate_count", "candidate_name_similarity", "priority", "review_class", "review_decision"]


@query(
    "unmatched_review",
    f"""WITH {_MATCHED}, open AS (SELECT DISTINCT lawd_cd, dong, jibun, name, kind, CASE WHEN kind <> 5 THEN k END AS k FROM log WHERE kapt_code IS NULL),
    sold AS (SELECT d.lawd_cd, d.dong, d.jibun, d.name, l.l_extendedprice AS price, CAST(l.l_shipdate AS DATE) AS deal_date FROM distinct_keys d
        JOIN lineitem l ON l.l_suppkey = d.k AND l.l_partkey % 6 = d.kind WHERE l.l_returnflag <> 'R'),
    stats AS (SELECT lawd_cd, dong, jibun, name, count(*) AS n, min(deal_date) AS first_deal_date, max(deal_date) AS last_deal_date, median(price) AS price FROM sold GROUP BY 1, 2, 3, 4),
    places AS (SELECT code, mdong, count(*) AS n FROM register GROUP BY 1, 2),
    districts AS (SELECT code, count(*) AS n, min('A' || k) AS lowest FROM register GROUP BY 1),
    judged AS (SELECT o.*, CASE kind WHEN 1 THEN '도로명주소 일치·법정동/지번 불일치' WHEN 5 THEN '정확 주소 후보 없음' ELSE '법정동 일치·지번 불일치' END AS candidate_evidence,
        CASE kind WHEN 1 THEN 1 WHEN 5 THEN t.n ELSE p.n END AS candidates, CASE kind WHEN 5 THEN t.lowest ELSE 'A' || k END AS code,
        CASE kind WHEN 5 THEN 0 WHEN 4 THEN 200.0 * (length(o.name) - 1) / (2 * length(o.name) - 1) ELSE 100 END AS score
        FROM open o LEFT JOIN places p ON p.code = o.lawd_cd AND p.mdong = o.dong LEFT JOIN districts t ON t.code = o.lawd_cd)
    SELECT j.lawd_cd, j.dong, j.jibun, j.name AS complex_name_normalized, coalesce(s.n, 0) AS transaction_count, first_deal_date, last_deal_date,
        round(s.price + 0.00000001, 6) AS median_deal_amount_krw, code AS candidate_kapt_code, candidate_evidence, candidates AS existing_candidate_count,
        round(round_even(CAST(score AS DOUBLE), 2) + 0.00000001, 6) AS candidate_name_similarity,
        CASE {" ".join(f"WHEN coalesce(s.n, 0) >= {low} THEN '{label}'" for low, label in bands.PRIORITY_LEVELS)} ELSE 'P3' END AS priority, '별도 단지' AS review_class, '별도 단지 유지' AS review_decision
    FROM judged j LEFT JOIN stats s USING (lawd_cd, dong, jibun, name)""",
)
def unmatched_review(spark, folder):
    rows = contracts(spark, folder).withColumn("complex_name_normalized", normalize_name(F.col("complex_name")))
    log = materialise(match.resolve(rows, register(spark, folder), strict_regions=["48250", "48330"]), "log")
    return settle(match.review_unmatched(log, rows, register(spark, folder)), *_REVIEW)


@query(
    "unmatched_statistics",
    """SELECT l_suppkey, l_partkey % 6 AS kind, count(*) AS transaction_count, min(CAST(l_shipdate AS DATE)) AS first_deal_date, max(CAST(l_shipdate AS DATE)) AS last_deal_date,
    round(median(l_extendedprice) + 0.00000001, 6) AS median_deal_amount_krw FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2""",
)
def unmatched_statistics(spark, folder):
    """Trade statistics per complex key, with supplier and part class as the key."""
    rows = a.table(spark, folder, "lineitem").select(
        F.lit("0").alias("lawd_cd"), F.col("l_suppkey").cast("string").alias("dong"), (F.col("l_partkey") % 6).cast("string").alias("jibun"),
        F.lit("").alias("complex_name_normalized"), F.col("l_extendedprice").alias("deal_amount_krw"), F.col("l_shipdate").cast("date").alias("deal_date"),
        (F.col("l_returnflag") == "R").alias("is_cancelled"),
    )
    out = match.unmatched_statistics(rows).withColumns({"l_suppkey": F.col("dong").cast("long"), "kind": F.col("jibun").cast("long")})
    return settle(out, "l_suppkey", "kind", "transaction_count", "first_deal_date", "last_deal_date", "median_deal_amount_krw")


def simple_log(spark, folder):
    """Orders as match log rows: the id is the customer, the method the priority."""
    return a.table(spark, folder, "orders").select(
        F.lpad((F.col("o_orderkey") % 50).cast("string"), 5, "0").alias("lawd_cd"), F.col("o_orderkey").cast("string").alias("dong"),
        F.lit("1").alias("jibun"), F.lit("n").alias("complex_name_normalized"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey").cast("string")).alias("kapt_code"), F.col("o_custkey").cast("string").alias("internal_complex_id"),
        F.when(F.col("o_orderkey") % 5 == 0, "unmatched").when(F.col("o_orderkey") % 7 == 0, "address_conflict").when(F.col("o_orderkey") % 2 == 0, "road_address_exact")
        .otherwise("dong_fuzzy").alias("match_method"),
        (F.col("o_orderkey") % 101).cast("double").alias("match_score"), (F.col("o_orderkey") % 4 == 0).alias("manual_review"),
        F.lit(1).alias("candidate_count"), F.col("o_orderkey"),
    )


_LOG = """log AS (SELECT o_orderkey, lpad(CAST(o_orderkey % 50 AS VARCHAR), 5, '0') AS lawd_cd, CAST(o_orderkey AS VARCHAR) AS dong,
    CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS kapt_code, CAST(o_custkey AS VARCHAR) AS internal_complex_id,
    CASE WHEN o_orderkey % 5 = 0 THEN 'unmatched' WHEN o_orderkey % 7 = 0 THEN 'address_conflict' WHEN o_orderkey % 2 = 0 THEN 'road_address_exact' ELSE 'dong_fuzzy' END AS match_method,
    (o_orderkey % 101)::DOUBLE AS match_score, o_orderkey % 4 = 0 AS manual_review FROM orders)"""


@query(
    "log_rates",
    f"""WITH {_LOG} SELECT round(count(*) FILTER (match_method LIKE '%address_exact%') / count(*) * 100, 2) AS exact_pct,
    round(count(*) FILTER (match_method = 'dong_fuzzy') / count(*) * 100, 2) AS fuzzy_pct, round(count(kapt_code) / count(*) * 100, 2) AS matched_pct,
    round(count(*) FILTER (match_method IN ('unmatched', 'address_conflict')) / count(*) * 100, 2) AS unmatched_pct,
    round(count(*) FILTER (match_method = 'address_conflict') / count(*) * 100, 2) AS address_conflict_pct,
    round(count(DISTINCT kapt_code) / (SELECT count(*) FROM customer) * 100, 2) AS kapt_coverage_pct FROM log""",
)
def log_rates(spark, folder):
    master = a.table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("kapt_code"))
    return match.match_rates(simple_log(spark, folder), master)


@query(
    "log_methods",
    f"WITH {_LOG} SELECT match_method, count(*) AS complex_count, count(*) FILTER (manual_review) AS manual_review_count, round(count(*) / (SELECT count(*) FROM log) * 100, 2) AS pct FROM log GROUP BY 1",
)
def log_methods(spark, folder):
    return match.method_summary(simple_log(spark, folder))


@query("safe_matches", f"WITH {_LOG} SELECT o_orderkey FROM log WHERE NOT manual_review AND match_method = 'road_address_exact'")
def safe_matches(spark, folder):
    return match.safe_matches(simple_log(spark, folder)).select("o_orderkey")


@query("new_complex_keys", f"WITH {_LOG} SELECT lawd_cd, dong FROM log WHERE o_orderkey % 9 = 0")
def new_complex_keys(spark, folder):
    log = materialise(simple_log(spark, folder), "log")
    return match.new_keys(log, log.where(F.col("o_orderkey") % 9 != 0)).select("lawd_cd", "dong")


@query(
    "merged_logs",
    f"WITH {_LOG} SELECT lawd_cd, dong, CASE WHEN o_orderkey % 4 = 0 THEN 'recent' ELSE match_method END AS match_method FROM log WHERE o_orderkey % 6 <> 1",
)
def merged_logs(spark, folder):
    log = materialise(simple_log(spark, folder), "log")
    recent = log.where(F.col("o_orderkey") % 4 == 0).withColumn("match_method", F.lit("recent"))
    return match.merge_logs(log, recent, log.where(F.col("o_orderkey") % 6 != 1)).select("lawd_cd", "dong", "match_method")


@query(
    "contract_log_join",
    f"WITH {_LOG} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, internal_complex_id, match_method, match_score FROM lineitem LEFT JOIN log ON l_orderkey = o_orderkey",
)
def contract_log_join(spark, folder):
    """Match results written back to contracts, with crowded keys split over tasks."""
    rows = a.table(spark, folder, "lineitem").select(
        F.lpad((F.col("l_orderkey") % 50).cast("string"), 5, "0").alias("lawd_cd"), F.col("l_orderkey").cast("string").alias("dong"), F.lit("1").alias("jibun"),
        F.lit("n").alias("complex_name_normalized"), "l_orderkey", "l_linenumber", "l_partkey",
    )
    out = match.attach_matches(rows, simple_log(spark, folder))
    return settle(out, "l_orderkey", "l_linenumber", "l_partkey", "internal_complex_id", "match_method", "match_score")


# Rent-to-sale crosswalk ------------------------------------------------------------------


def _sale_side(spark, folder):
    """Lines as matched sales of part keys; some keys lead to two ids."""
    k = F.col("l_partkey")
    return a.table(spark, folder, "lineitem").select(
        F.lpad((k % 40).cast("string"), 5, "0").alias("lawd_cd"), k.cast("string").alias("dong"), F.lit("1").alias("jibun"), F.concat(F.lit("n"), (k % 300).cast("string")).alias("complex_name_normalized"),
        F.when((k % 10 == 3) & (F.col("l_linenumber") > 3), F.concat(F.lit("x"), k.cast("string"))).otherwise(F.concat(F.lit("s"), k.cast("string"))).alias("internal_complex_id"),
        F.when(k % 4 != 0, k.cast("string")).alias("kapt_code"), F.lit("road_address_exact").alias("match_method"), (F.col("l_partkey") % 101).cast("double").alias("match_score"),
        F.lit("중구").alias("sigungu"), F.concat(F.lit("구"), (k % 300).cast("string"), F.lit("로")).alias("road_name"), (k % 300 + 1).cast("string").alias("road_main"),
        F.lit(None).cast("string").alias("road_sub"), F.lit("c").alias("complex_name"), F.struct("l_orderkey", "l_linenumber").alias("source_order"),
    )


def _rent_log(spark, folder):
    """Parts as the rent match log: every second one already has the sale id, every third another lot."""
    k = F.col("p_partkey")
    return a.table(spark, folder, "part").select(
        F.lpad((k % 40).cast("string"), 5, "0").alias("lawd_cd"), F.when(k % 3 == 0, "elsewhere").otherwise(k.cast("string")).alias("dong"), F.lit("1").alias("jibun"),
        F.concat(F.lit("n"), (k % 300).cast("string")).alias("complex_name_normalized"), F.col("p_name").alias("trade_complex_name"),
        F.when(k % 2 == 0, F.concat(F.lit("s"), k.cast("string"))).otherwise(F.concat(F.lit("r"), k.cast("string"))).alias("internal_complex_id"),
        F.lit(None).cast("string").alias("kapt_code"), F.lit("unmatched").alias("match_method"), F.lit(0.0).alias("match_score"), F.lit(True).alias("manual_review"),
        F.concat(F.lit("중구|구"), (k % 300).cast("string"), F.lit("로|"), (k % 300 + 1).cast("string")).alias("trade_road_address_key"), k.alias("p_partkey"),
    )


_CROSS = """sold AS (SELECT lpad(CAST(l_partkey % 40 AS VARCHAR), 5, '0') AS lawd_cd, CAST(l_partkey AS VARCHAR) AS dong, l_partkey % 300 AS road,
        CASE WHEN l_partkey % 10 = 3 AND l_linenumber > 3 THEN 'x' ELSE 's' END || l_partkey AS id, CASE WHEN l_partkey % 4 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS code, (l_partkey % 101)::DOUBLE AS score FROM lineitem),
by_lot AS (SELECT lawd_cd, dong, road, min(id) AS id, max(code) AS code, max(score) AS score FROM sold GROUP BY 1, 2, 3 HAVING count(DISTINCT id) = 1),
by_road AS (SELECT lawd_cd, road, min(id) AS id, max(code) AS code, max(score) AS score FROM sold GROUP BY 1, 2 HAVING count(DISTINCT id) = 1),
log AS (SELECT p_partkey, lpad(CAST(p_partkey % 40 AS VARCHAR), 5, '0') AS lawd_cd, CASE WHEN p_partkey % 3 = 0 THEN 'elsewhere' ELSE CAST(p_partkey AS VARCHAR) END AS dong, p_partkey % 300 AS road,
        CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE 'r' END || p_partkey AS id FROM part),
first AS (SELECT l.*, b.id IS NOT NULL AND b.id <> l.id AS c1, b.id AS bid, b.code AS bcode, b.score AS bscore FROM log l LEFT JOIN by_lot b USING (lawd_cd, dong, road)),
second AS (SELECT f.* EXCLUDE (id), f.id AS id0, CASE WHEN c1 THEN bid ELSE f.id END AS id1, r.id AS rid, r.code AS rcode, r.score AS rscore FROM first f LEFT JOIN by_road r USING (lawd_cd, road)),
final AS (SELECT *, rid IS NOT NULL AND rid <> id1 AND lawd_cd <> '00007' AS c2 FROM second)"""


@query(
    "rent_crosswalk",
    f"""WITH {_CROSS} SELECT p_partkey, CASE WHEN c2 THEN rid ELSE id1 END AS internal_complex_id, CASE WHEN c2 THEN rcode WHEN c1 THEN bcode END AS kapt_code,
    CASE WHEN c2 THEN 'sale_crosswalk_road:road_address_exact' WHEN c1 THEN 'sale_crosswalk:road_address_exact' ELSE 'unmatched' END AS match_method,
    CASE WHEN c2 THEN rcode IS NULL OR rscore < 90 WHEN c1 THEN bcode IS NULL OR bscore < 90 ELSE true END AS manual_review FROM final""",
)
def rent_crosswalk(spark, folder):
    log, _ = rent.align_rents_to_sales(_rent_log(spark, folder), _sale_side(spark, folder), "source_order", strict_regions=["00007"])
    return log.select("p_partkey", "internal_complex_id", "kapt_code", "match_method", "manual_review")


@query(
    "rent_crosswalk_audit",
    f"""WITH {_CROSS} SELECT lawd_cd, dong, id0 AS previous_internal_complex_id, bid AS corrected_internal_complex_id, 'legal_address' AS crosswalk_key FROM final WHERE c1
    UNION ALL SELECT lawd_cd, dong, id1, rid, 'road_address' FROM final WHERE c2""",
)
def rent_crosswalk_audit(spark, folder):
    _, audit = rent.align_rents_to_sales(_rent_log(spark, folder), _sale_side(spark, folder), "source_order", strict_regions=["00007"])
    return audit.select("lawd_cd", "dong", "previous_internal_complex_id", "corrected_internal_complex_id", "crosswalk_key")


@query("market_conflicts", f"WITH {_CROSS} SELECT b.lawd_cd, b.dong, b.id AS sale_internal_complex_id, l.id AS rent_internal_complex_id FROM by_lot b JOIN log l USING (lawd_cd, dong, road) WHERE b.id <> l.id")
def market_conflicts(spark, folder):
    df = rent.market_conflicts(_sale_side(spark, folder), _rent_log(spark, folder))
    return df.select("lawd_cd", "dong", "sale_internal_complex_id", "rent_internal_complex_id")


@query(
    "road_conflicts",
    f"""WITH {_CROSS}, rented AS (SELECT lawd_cd, road, min(id) AS id FROM log GROUP BY 1, 2 HAVING count(DISTINCT id) = 1)
    SELECT b.lawd_cd, 'n' || b.road AS complex_name_normalized, b.id AS sale_internal_complex_id, r.id AS rent_internal_complex_id FROM by_road b JOIN rented r USING (lawd_cd, road) WHERE b.id <> r.id""",
)
def road_conflicts(spark, folder):
    k = F.col("p_partkey")
    rented = _rent_log(spark, folder).withColumns(
        {"sigungu": F.lit("중구"), "road_name": F.concat(F.lit("구"), (k % 300).cast("string"), F.lit("로 "), (k % 300 + 1).cast("string"))}
    )
    return rent.road_conflicts(_sale_side(spark, folder), rented).select("lawd_cd", "complex_name_normalized", "sale_internal_complex_id", "rent_internal_complex_id")


@query(
    "canonical_match_keys",
    "SELECT lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS lawd_cd, '' AS dong, coalesce(CASE WHEN l_linenumber <> 2 THEN CAST(l_linenumber AS VARCHAR) END, '') AS jibun, count(*) AS contract_count FROM lineitem GROUP BY 1, 2, 3",
)
def canonical_match_keys(spark, folder):
    rows = a.table(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("lawd_cd"), F.lit(None).cast("string").alias("dong"), F.when(F.col("l_linenumber") != 2, F.col("l_linenumber")).alias("jibun")
    )
    return rent.canonical_match_keys(rows).groupBy("lawd_cd", "dong", "jibun").agg(F.count(F.lit(1)).alias("contract_count"))
