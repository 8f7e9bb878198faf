"""Valuation of area types from collected external prices, with approved adjustments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..session import local_table, materialise
from .clean import parse_date
from .quality import require_empty, require_unique
from .scale import join_keys, with_group, with_rank
from .valuation import BUILDINGS, CODE, SALE_SCOPE, SALE_TYPE, join_reasons

TYPE = "area_group_id"
# Price and valuation reasons, scopes, statuses and methods.
NO_LINK, MANY_LINKS, REUSED = "KB 타입 연결 미확인", "KB 타입 다중 후보", "KB 타입 중복 연결"
NO_PRICE, REVERSED = "KB 일반매매가 미확보", "KB 하위·일반·상위 가격 역전"
NO_DATE, OUT_OF_DATE = "KB 수집일 미확인", "평형 구성 적용 기간 밖 시세"
WHOLE_SCOPE, SALE_ONLY_SCOPE = "전체 분양 주거 세대", "분양 세대만 (임대 제외)"
NEEDS_SCOPE, NEEDS_PRICE = "임대·혼합 분양 범위 확인 필요", "KB 시세 또는 타입 연결 부족"
DONE, NOT_DONE, ADJUSTED = "산정 완료", "산정 불완전", "보정 추정 (사용자 확인 범위)"
OBSERVED_METHOD, OPEN_METHOD = "KB 일반매매가", "미산정"
LOWER_METHOD, OVERRIDE_METHOD = "하위 평형단가 기준 보정", "승인된 외부 가격 보정"
MERGED_NOTE = "동일 전용면적 타입 세대수 합산; 실거래는 타입 구별 불가"
POLICY_SCHEMA = "kapt_code string, households double, scope string, source string, price_method string, overrides map<string,double>"


def merge_equal_areas(types: DataFrame) -> DataFrame:
    """One row per complex, area and validity: households add up, names join.

    Types of one complex and area are few by nature; names are joined in sorted order. A repeated type of a complex aborts the job.
    """
    require_unique(types, [CODE, TYPE], "types")
    keys = [CODE, "exclusive_area_sqm", "valid_from", "valid_to"]
    joined = lambda c, distinct=True: F.concat_ws(" | ", F.array_sort(F.collect_set(c) if distinct else F.collect_list(c)))
    out = types.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("households").alias("households"),
        joined("type_name", False).alias("type_name"),
        joined("source").alias("source"),
        F.when(F.bool_and(F.col("verification_status") == "verified"), "verified").otherwise("pending").alias("verification_status"),
        F.when(F.countDistinct("scope") == 1, F.min("scope")).otherwise("unknown").alias("scope"),
        F.min("supply_area_sqm").alias("_supply"),
        F.max("verified_at").alias("verified_at"),
        joined("notes").alias("_notes"),
    )
    several = F.col("_n") > 1
    return out.withColumns(
        {
            TYPE: F.concat(F.lit("exclusive_"), F.regexp_replace(F.format_string("%.4f", "exclusive_area_sqm"), r"\.?0+$", "")),
            "supply_area_sqm": F.when(~several, F.col("_supply")),
            "notes": F.when(several, F.concat_ws(" | ", "_notes", F.lit(MERGED_NOTE))).otherwise(F.col("_notes")),
        }
    ).drop("_n", "_supply", "_notes")


def price_reason(value: Column, lower: Column, upper: Column, collected: Column, start: Column, end: Column) -> Column:
    """Why a linked price cannot be used; empty when it can."""
    return (
        F.when(value.isNull() | F.isnan(value) | (value <= 0) | (value == float("inf")), NO_PRICE)
        .when((lower > value) | (upper < value), REVERSED)
        .when(collected.isNull(), NO_DATE)
        .when((collected < start) | (collected > end), OUT_OF_DATE)
        .otherwise("")
    )


def link_prices(types: DataFrame, prices: DataFrame) -> DataFrame:
    """Link every type to the one external type with equal code, areas, name and households.

    A complex number in the source link must match too. Several candidates, or one external
    type linked twice, give no price. A repeated external type in the source aborts the job.
    """
    require_unique(prices, ["kb_complex_id", "kb_type_id"], "external types")
    match = [CODE, "exclusive_area_sqm", "supply_area_sqm", "type_name", "households"]
    found = ["kb_complex_id", "kb_type_id", "kb_url", "collected_at", "kb_price_date"]
    numbers = ["kb_sale_general", "kb_sale_lower", "kb_sale_upper"]
    offered = prices.select(*match, *[text.blank_if_null(F.col(c)).alias(c) for c in found], *[numeric.number(F.col(c)).alias(c) for c in numbers])
    asked = types.withColumn("_ids", text.url_complex_ids(F.col("source")))
    pairs = asked.select(CODE, TYPE, "_ids", *match[1:]).join(offered, match)
    pairs = pairs.where((F.size("_ids") == 0) | F.array_contains("_ids", F.col("kb_complex_id")))
    linked = pairs.groupBy(CODE, TYPE).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(*found, *numbers)).alias("_p")
    )
    out = types.join(linked, [CODE, TYPE], "left")
    one, many = F.col("_n") == 1, F.col("_n") > 1
    out = out.withColumns({c: F.when(one, F.col(f"_p.{c}")).otherwise("") for c in found})
    out = out.withColumns({c: F.when(one, F.col(f"_p.{c}")) for c in numbers})
    reason = price_reason(
        F.col("kb_sale_general"), F.col("kb_sale_lower"), F.col("kb_sale_upper"),
        parse_date(F.col("collected_at")), F.col("valid_from"), F.col("valid_to"),
    )
    out = out.withColumn("price_reason", F.when(one, reason).when(many, MANY_LINKS).otherwise(NO_LINK))
    out = materialise(out, "linked-types")
    uses = out.where("kb_type_id <> ''").groupBy("kb_complex_id", "kb_type_id").agg(F.count(F.lit(1)).alias("_uses"))
    out = out.join(uses, ["kb_complex_id", "kb_type_id"], "left")
    reused = F.coalesce(F.col("_uses") > 1, F.lit(False))
    out = out.withColumn("price_reason", F.when(reused, REUSED).otherwise(F.col("price_reason")))
    price = F.when(F.col("price_reason") == "", F.col("kb_sale_general") * numeric.MANWON)
    out = out.withColumn("price_krw", price).withColumn("contribution_krw", F.col("households") * F.col("price_krw"))
    return out.drop("_n", "_p", "_uses", *numbers)


def estimate_external(complexes: DataFrame, detail: DataFrame, status: DataFrame, splits: DataFrame) -> DataFrame:
    """Totals per complex from linked prices; a total counts only when no reason speaks against it."""
    priced = F.col("price_krw").isNotNull()
    sums = detail.groupBy(CODE).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum("households").alias("confirmed_households"),
        F.sum(F.when(priced, F.col("households"))).alias("priced_households"),
        F.sum("contribution_krw").alias("partial_cap_krw"),
        F.count_if(~priced).alias("_unpriced"),
        F.bool_and((F.col("verification_status") == "verified") & (F.col("scope") == SALE_SCOPE)).alias("_sound"),
        F.min(parse_date(F.col("collected_at"))).alias("_collected"),
    )
    out = complexes.join(sums, CODE, "left").join(status.select(CODE, F.col("final_status").alias("_status")), CODE, "left")
    out = out.join(splits.select(CODE, "split_validity", "sale_households", "kapt_households", "rental_households_excluded"), CODE, "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("confirmed_households", "priced_households")})
    rows = F.coalesce(F.col("_rows"), F.lit(0))
    confirmed, homes = F.col("confirmed_households"), F.col("households")
    split = (
        (F.col("split_validity") == "OFFICIALLY_SUPPORTED")
        & (F.col("sale_households") == confirmed)
        & (F.col("kapt_households") == homes)
        & (F.col("sale_households") + F.col("rental_households_excluded") == homes)
    )
    out = out.withColumn("_split", F.coalesce(split, F.lit(False)))
    rental = F.coalesce(F.col("rental_households_excluded"), F.lit(0)) != 0
    out = out.withColumns(
        {
            "eligible_households": F.when(F.col("_split"), F.col("sale_households")).otherwise(homes),
            "valuation_scope": F.when(F.col("_split") & rental, SALE_ONLY_SCOPE).otherwise(WHOLE_SCOPE),
        }
    )
    excluded = F.coalesce(F.col("_status") == "EXCLUDED_RENTAL_ONLY", F.lit(False))
    approval, collected = F.col("approval_date"), F.col("_collected")
    unknown = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    reasons = [
        ((rows == 0) & excluded, "임대 전용 제외"),
        ((rows == 0) & ~excluded, "평형별 세대수 보완 필요"),
        ((rows > 0) & ~confirmed.eqNullSafe(F.col("eligible_households")), "평형 세대수 합계 불일치"),
        ((unknown("sale_type") != SALE_TYPE) & ~F.col("_split"), NEEDS_SCOPE),
        (~unknown("building_type").isin(BUILDINGS), "아파트 주거 범위 미확인"),
        ((rows > 0) & ~F.col("_sound"), "평형 마스터 미검증"),
        (approval.isNull() | (approval > collected), "준공·입주 시점 확인 필요"),
        (F.col("_unpriced") > 0, NEEDS_PRICE),
    ]
    out = out.withColumn("reason", join_reasons(reasons))
    complete = (F.col("reason") == "") & (F.col("eligible_households") > 0) & (rows > 0)
    cap = F.when(F.coalesce(complete, F.lit(False)), F.col("partial_cap_krw"))
    out = out.withColumns(
        {
            "market_cap_krw": cap,
            "per_household_krw": numeric.ratio(cap, F.col("eligible_households")),
            "status": F.when(F.coalesce(complete, F.lit(False)), DONE).otherwise(NOT_DONE),
            "release_status": F.coalesce("_status", F.lit("미기록")),
        }
    )
    out = out.drop("split_validity", "sale_households", "kapt_households", "rental_households_excluded", *[c for c in out.columns if c.startswith("_")])
    return rank_external(materialise(out, "external-totals"))


def rank_external(totals: DataFrame, value: str = "market_cap_krw") -> DataFrame:
    """Minimum ranks overall and per district; complexes without a value get none."""
    base = totals.drop("rank", "district_rank")
    out = with_rank(base, [], value, "rank")
    return with_rank(out, ["sigungu"], value, "district_rank")


def policy_table(spark: SparkSession, policy: dict) -> DataFrame:
    """The adjustment policy as one row per approved complex."""
    if policy.get("method") != "nearest_exclusive_area_unit_price":
        raise ValueError("unknown adjustment rule")
    rows = [
        (code, float(r["households"]), r.get("scope"), r.get("source", policy.get("source")), r.get("price_method"),
         [(k, float(v)) for k, v in r.get("type_price_overrides_krw", {}).items()])
        for code, r in policy["complexes"].items()
    ]
    return local_table(spark, rows, POLICY_SCHEMA)


def unknown_overrides(detail: DataFrame, policy: DataFrame) -> DataFrame:
    """Overridden types that the register does not have."""
    named = policy.select(CODE, F.explode(F.map_keys("overrides")).alias(TYPE))
    known = detail.select(CODE).distinct()
    return named.join(known, CODE, "left_semi").join(detail.select(CODE, TYPE), [CODE, TYPE], "left_anti")


def adjust(totals: DataFrame, detail: DataFrame, policy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fill missing prices of approved complexes; observed values never change.

    A policy that names a type the register does not have aborts the job.

    Explicit overrides come first, then the household-weighted unit price of the largest priced
    area not above the type (else the smallest one) of the same external complex.
    """
    require_empty(unknown_overrides(detail, policy), "the policy overrides a type that does not exist")
    slim = totals.select(CODE, "reason", F.col("eligible_households").alias("_eligible"), F.col("households").alias("_all"))
    blockers = F.filter(
        F.split("reason", "; "), lambda r: (r != "") & ~r.isin(NEEDS_SCOPE, NEEDS_PRICE)
    )
    sound = (F.col("verification_status") == "verified") & (F.col("scope") == SALE_SCOPE)
    rows = detail.groupBy(CODE).agg(F.sum("households").alias("_sum"), F.bool_and(sound).alias("_sound"))
    approved = policy.select(
        CODE, F.col("households").alias("_agreed"), F.col("scope").alias("_scope"), F.col("source").alias("_source"),
        F.col("price_method").alias("_method"), "overrides",
    ).join(slim, CODE).join(rows, CODE)
    fits = (F.size(blockers) == 0) & (F.col("_sum") == F.col("_agreed")) & F.col("_sound")
    fits = fits & ((F.col("_eligible") == F.col("_agreed")) | (F.col("_all") == F.col("_agreed")))
    approved = approved.where(F.coalesce(fits, F.lit(False))).select(CODE, "_scope", "_source", "_method", "overrides")
    out = detail.join(approved.withColumn("_approved", F.lit(True)), CODE, "left")
    open_price = F.coalesce(F.col("_approved"), F.lit(False)) & (F.col("price_reason") == NO_PRICE)
    override = F.when(open_price, F.col("overrides")[F.col(TYPE)])
    override = F.when(override > 0, override)
    out = out.withColumn("_override", override)
    collected = parse_date(F.col("collected_at"))
    in_force = collected.isNotNull() & ~F.coalesce((collected < F.col("valid_from")) | (collected > F.col("valid_to")), F.lit(False))
    wants = open_price & F.col("price_krw").isNull() & F.col("_override").isNull() & in_force & (F.col("exclusive_area_sqm") > 0)
    out = materialise(out.withColumn("_wants", wants), "adjustable-types")
    donors = _donor_units(out.where(F.col("_approved") & F.col("price_krw").isNotNull() & (F.col("exclusive_area_sqm") > 0)))
    out = join_keys(out, _lower_nearest(out.where("_wants"), donors), [CODE, "kb_complex_id", "exclusive_area_sqm"])
    use = F.col("_wants") & F.col("_unit").isNotNull()
    estimated = F.bround(F.col("_unit") * F.col("exclusive_area_sqm"), 0)
    out = out.withColumns(
        {
            "adjusted_price_krw": F.coalesce("price_krw", "_override", F.when(use, estimated)),
            "price_method": F.when(F.col("price_krw").isNotNull(), OBSERVED_METHOD)
            .when(F.col("_override").isNotNull(), F.coalesce("_method", F.lit(OVERRIDE_METHOD)))
            .when(use, LOWER_METHOD)
            .otherwise(OPEN_METHOD),
            "reference_area_group_ids": F.when(use, F.col("_groups")).otherwise(""),
            "reference_unit_price_krw_sqm": F.when(use, F.col("_unit")),
        }
    )
    out = out.withColumn("adjusted_contribution_krw", F.col("households") * F.col("adjusted_price_krw"))
    filled = ~F.col("price_method").isin(OBSERVED_METHOD, OPEN_METHOD)
    sums = out.where("_approved").groupBy(CODE).agg(
        F.bool_and(F.col("adjusted_price_krw").isNotNull()).alias("_done"),
        F.sum("adjusted_contribution_krw").alias("_cap"),
        F.sum(F.when(filled, F.col("households")).otherwise(0)).alias("_estimated"),
        F.max("_scope").alias("_scope"), F.max("_source").alias("_source"),
    ).where("_done")
    total = totals.join(sums, CODE, "left")
    guessed = F.coalesce(F.col("_estimated") > 0, F.lit(False))
    total = total.withColumns(
        {
            "adjusted_market_cap_krw": F.coalesce("_cap", "market_cap_krw"),
            "estimated_households": F.coalesce("_estimated", F.lit(0.0)),
            "adjusted_status": F.when(guessed, ADJUSTED).otherwise(F.col("status")),
            "adjusted_scope": F.when(guessed, F.col("_scope")).otherwise(F.col("valuation_scope")),
            "adjustment_source": F.when(guessed, F.col("_source")).otherwise(""),
        }
    )
    private = lambda df: [c for c in df.columns if c.startswith("_")]
    return total.drop(*private(total)), out.drop("overrides", *private(out))


def _donor_units(rows: DataFrame) -> DataFrame:
    """Household-weighted unit price per distinct priced area of an external complex."""
    weighted = F.sum(F.col("price_krw") / F.col("exclusive_area_sqm") * F.col("households"))
    out = rows.groupBy(CODE, "kb_complex_id", "exclusive_area_sqm").agg(
        F.try_divide(weighted, F.sum("households")).alias("_unit"),
        F.concat_ws(" | ", F.array_sort(F.collect_list(TYPE))).alias("_groups"),
    )
    return out


def _lower_nearest(wanted: DataFrame, donors: DataFrame) -> DataFrame:
    """For each wanted area the donor directly at or below it, else the smallest donor.

    Both sides hold distinct areas only, so one ordered pass per external complex is bounded.
    """
    keys = [CODE, "kb_complex_id"]
    marks = wanted.select(*keys, "exclusive_area_sqm").distinct().withColumn("_d", F.lit(None).cast("struct<_unit:double,_groups:string>")).withColumn("_want", F.lit(1))
    offers = donors.select(*keys, "exclusive_area_sqm", F.struct("_unit", "_groups").alias("_d"), F.lit(0).alias("_want"))
    w = Window.partitionBy(*keys).orderBy("exclusive_area_sqm", "_want")
    below = F.last("_d", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first("_d", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    line = marks.unionByName(offers).withColumn("_pick", F.coalesce(below, above)).where("_want = 1")
    return line.select(*keys, "exclusive_area_sqm", "_pick._unit", "_pick._groups")


def reused_types(detail: DataFrame) -> DataFrame:
    """External types linked more than once, with every row that uses them."""
    linked = with_group(detail.where("kb_type_id <> ''"), ["kb_complex_id", "kb_type_id"], F.count(F.lit(1)).alias("uses"))
    return linked.where("uses > 1")
