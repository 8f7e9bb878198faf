"""Data quality reports, profiles and job gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import local_table
from .scale import Quantile, group_quantiles, unique_key_violations


def as_rows(one: DataFrame, checks: list[str]) -> DataFrame:
    """A one-row table of counts as rows of check, count and status."""
    counts = one.select(*[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in checks])
    rows = counts.unpivot([], checks, "check", "count")
    return rows.withColumn("status", F.when(F.col("count") == 0, "PASS").otherwise("REVIEW"))


def require_columns(df: DataFrame, names: list[str], label: str = "table") -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{label}: missing columns {missing}")


def require_unique(df: DataFrame, keys: list[str], label: str = "table") -> None:
    """Abort when a key repeats; reads at most one offending key."""
    if not unique_key_violations(df, keys).isEmpty():
        raise ValueError(f"{label}: {keys} is not unique")


def require_empty(df: DataFrame, message: str) -> None:
    if not df.isEmpty():
        raise ValueError(message)


def require_same_members(left: DataFrame, right: DataFrame, message: str) -> None:
    """Abort unless both tables hold the same distinct rows."""
    require_empty(left.distinct().exceptAll(right.distinct()).unionAll(right.distinct().exceptAll(left.distinct())), message)


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows found on one side only, with the side."""
    only_left = left.distinct().exceptAll(right.distinct()).withColumn("side", F.lit("left"))
    return only_left.unionAll(right.distinct().exceptAll(left.distinct()).withColumn("side", F.lit("right")))


def contract_quality(
    raw: DataFrame,
    cleaned: DataFrame,
    log: DataFrame,
    master: DataFrame,
    as_of: str,
    floors: tuple[int, int] = (-5, 100),
    iqr_multiplier: float = 3.0,
) -> DataFrame:
    """Counts of suspicious contracts, failed matches and gaps in the register.

    Each input is aggregated once; the parts meet as scalar subqueries. Price fences use
    exact quartiles.
    """
    year = F.year(F.lit(as_of).cast("date"))
    price = F.col("price_per_sqm")
    quartiles = group_quantiles(cleaned, [], {"q1": Quantile(price, 0.25), "q3": Quantile(price, 0.75)})
    fence = (F.col("q3") - F.col("q1")) * iqr_multiplier
    low = quartiles.select((F.col("q1") - fence).alias("v")).scalar()
    high = quartiles.select((F.col("q3") + fence).alias("v")).scalar()
    fenced = cleaned.withColumns({"_low": low, "_high": high})
    sane_floor = F.coalesce(F.col("floor").between(*floors), F.lit(False))
    counts = fenced.agg(
        F.count_if(F.col("deal_amount_krw") <= 0).alias("nonpositive_deal_amount"),
        F.count_if(F.col("area_sqm") <= 0).alias("nonpositive_area"),
        F.count_if(F.col("build_year") > year).alias("future_build_year"),
        F.count_if(~sane_floor).alias("abnormal_floor"),
        F.count(F.lit(1)).alias("_kept"),
        F.count_if(F.col("is_cancelled")).alias("cancelled_transactions"),
        F.count_if((price < F.col("_low")) | (price > F.col("_high"))).alias("price_outliers"),
    )
    raw_rows = raw.agg(F.count(F.lit(1)).alias("n")).scalar()
    failures = log.agg(F.count_if(F.col("match_method") == "unmatched").alias("n")).scalar()
    no_households = master.agg(F.count_if(F.col("households").isNull()).alias("n")).scalar()
    no_parking = master.agg(F.count_if(F.col("parking_total").isNull()).alias("n")).scalar()
    one = counts.withColumns({"_raw": raw_rows}).withColumns(
        {
            "duplicate_transactions": F.greatest(F.col("_raw") - F.col("_kept"), F.lit(0)),
            "complex_match_failures": failures,
            "missing_households": no_households,
            "missing_parking": no_parking,
        }
    )
    return as_rows(
        one,
        ["nonpositive_deal_amount", "nonpositive_area", "future_build_year", "abnormal_floor", "duplicate_transactions",
         "cancelled_transactions", "complex_match_failures", "missing_households", "missing_parking", "price_outliers"],
    )


def _repeats(df: DataFrame, key: str):
    """Rows beyond the first of every key value, as a scalar."""
    groups = df.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("_extra"))
    return groups.agg(F.sum("_extra").alias("n")).scalar()


def wide_area_quality(master: DataFrame, contracts: DataFrame, dimension: DataFrame, as_of: str) -> DataFrame:
    """Quality counts of register and contracts over several cities."""
    not_positive = lambda c: F.coalesce(F.col(c), F.lit(0.0)) <= 0
    both_missing = F.col("legal_address").isNull() & F.col("road_address").isNull()
    unlocated = F.col("latitude").isNull() | F.col("longitude").isNull()
    of_master = master.agg(
        F.count_if(both_missing).alias("missing_address"),
        F.count_if(unlocated).alias("missing_coordinates"),
        F.count_if(F.col("households").isNull()).alias("missing_households"),
        F.count_if(not_positive("households")).alias("nonpositive_households"),
    )
    unknown = contracts.join(dimension.select("region_code").distinct(), "region_code", "left_anti")
    of_contracts = contracts.agg(
        F.count_if(not_positive("deal_amount_krw")).alias("nonpositive_deal_amount"),
        F.count_if(not_positive("area_sqm")).alias("nonpositive_area"),
        F.count_if(F.col("deal_date").isNull()).alias("invalid_deal_date"),
        F.count_if(F.col("deal_date") > F.lit(as_of).cast("date")).alias("future_deal_date"),
    )
    scalars = {
        "duplicate_kapt_code": _repeats(master, "kapt_code"),
        "duplicate_transactions": _repeats(contracts, "transaction_id"),
        "invalid_region_code": unknown.agg(F.count(F.lit(1)).alias("n")).scalar(),
        **{c: of_contracts.select(c).scalar() for c in of_contracts.columns},
    }
    order = ["duplicate_kapt_code", "missing_address", "missing_coordinates", "missing_households",
             "nonpositive_households", "duplicate_transactions", "nonpositive_deal_amount", "nonpositive_area",
             "invalid_deal_date", "future_deal_date", "invalid_region_code"]
    return as_rows(of_master.withColumns(scalars), order)


def scope_report(master: DataFrame, contracts: DataFrame, scopes: dict[str, Column]) -> DataFrame:
    """Complexes, contracts and match rate per overlapping scope.

    Every row is repeated only for the scopes it belongs to, so one aggregation per table
    covers all scopes.
    """
    names = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in scopes.items()])
    inside = F.array_compact(names)
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    complexes = master.withColumn("scope", F.explode(inside)).groupBy("scope").agg(
        F.countDistinct("kapt_code").alias("complex_count"),
        F.count_if("is_500plus").alias("complexes_500plus"),
        F.count_if("is_1000plus").alias("complexes_1000plus"),
        F.bround(F.avg(located.cast("int")) * 100, 2).alias("located_pct"),
    )
    latest = contracts.agg(F.max("deal_date").alias("d")).scalar()
    dated = contracts.withColumn("_latest", latest)
    scoped = dated.withColumn("scope", F.explode(inside))
    deals = scoped.groupBy("scope").agg(
        F.count(F.lit(1)).alias("contract_count"),
        F.count_if(F.col("deal_date") > F.add_months("_latest", -12)).alias("contracts_12m"),
    )
    keys = ["lawd_cd", "dong", "jibun", "complex_name_normalized"]
    groups = scoped.groupBy("scope", *keys).agg(F.max(F.col("kapt_code").isNotNull()).alias("_matched"))
    matched = groups.groupBy("scope").agg(
        F.count(F.lit(1)).alias("contract_complexes"), F.count_if("_matched").alias("matched_complexes")
    )
    spine = local_table(master.sparkSession, [(n,) for n in scopes], "scope string")
    out = spine.join(complexes, "scope", "left").join(deals, "scope", "left").join(matched, "scope", "left")
    out = out.na.fill(0)
    rate = F.bround(F.col("matched_complexes") / F.greatest("contract_complexes", F.lit(1)) * 100, 2)
    return out.withColumn("match_rate", rate)


def register_quality(master: DataFrame, by: list[str] = ()) -> DataFrame:
    """Collection quality of the register, as one row or one row per region."""
    checks = [
        F.count(F.lit(1)).alias("collected_rows"),
        F.countDistinct("kapt_code").alias("unique_codes"),
        F.count_if(F.col("complex_name").isNull()).alias("missing_name"),
        F.count_if(F.col("road_address").isNull()).alias("missing_road_address"),
        F.count_if(~F.coalesce(F.col("households") > 0, F.lit(False))).alias("nonpositive_households"),
        F.count_if(F.col("parking_ground").isNull() & F.col("parking_underground").isNull()).alias("missing_parking"),
    ]
    out = master.groupBy(*by).agg(*checks) if by else master.agg(*checks)
    return out.withColumn("duplicate_codes", F.col("collected_rows") - F.col("unique_codes"))


def register_summary(master: DataFrame) -> DataFrame:
    """Nine export checks as rows."""
    missing = {c: f"missing_{c}" for c in ("complex_name", "road_address", "legal_address", "jibun", "households", "parking_total")}
    one = master.agg(
        F.count(F.lit(1)).alias("all_complexes"),
        F.countDistinct("kapt_code").alias("distinct_codes"),
        *[F.count_if(F.col(c).isNull()).alias(n) for c, n in missing.items()],
    ).withColumn("repeated_codes", F.col("all_complexes") - F.col("distinct_codes"))
    names = ["all_complexes", "distinct_codes", "repeated_codes", *missing.values()]
    return one.select(*[F.col(n).cast("long").alias(n) for n in names]).unpivot([], names, "check", "count")


def register_gate(master: DataFrame, minimum_rows: int = 1, minimum_households_share: float = 0.0) -> None:
    """Abort when the register is too small, repeats codes or lacks required values."""
    require_columns(master, ["kapt_code", "complex_name", "households"], "register")
    row = register_gate_figures(master).first()
    if row.rows < minimum_rows or row.rows != row.codes or row.share < minimum_households_share:
        raise ValueError(f"register is not usable: {row.asDict()}")


def register_gate_figures(master: DataFrame) -> DataFrame:
    """Rows, distinct codes and the share with positive households (a cache needs 0.8)."""
    known = F.coalesce(F.col("households") > 0, F.lit(False)).cast("int")
    return master.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("kapt_code").alias("codes"), F.avg(known).alias("share")
    )


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key was not updated, plus the updated rows."""
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def regions_to_recollect(report: DataFrame) -> DataFrame:
    """Regions whose report shows failed requests."""
    failed = F.coalesce(F.col("failed_basic"), F.lit(0)) + F.coalesce(F.col("failed_detail"), F.lit(0))
    return report.where(failed > 0)


def null_profile(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rows and nulls per column, for the whole table or per file family, as rows."""
    names = [c for c in df.columns if c not in by]
    counts = [F.count(F.lit(1)).alias("row_count"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names]]
    out = df.groupBy(*by).agg(*counts) if by else df.agg(*counts)
    return out.unpivot([*by, "row_count"], names, "column_name", "null_count")


def key_statistics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, rows with a complete key, distinct complete keys and repeats."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    out = groups.agg(
        F.sum("_n").alias("row_count"),
        F.sum(F.when(complete, F.col("_n")).otherwise(0)).alias("complete_rows"),
        F.count_if(complete).alias("distinct_keys"),
    )
    return out.withColumn("duplicate_rows", F.col("complete_rows") - F.col("distinct_keys"))


def key_overlap(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Distinct keys of both sides, their intersection and the coverage of each side in percent."""
    l = left.select(F.col(left_key).cast("string").alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r"))
    r = right.select(F.col(right_key).cast("string").alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    keys = l.unionAll(r).where("k IS NOT NULL").groupBy("k").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    out = keys.agg(F.sum("l").alias("left_keys"), F.sum("r").alias("right_keys"), F.sum(F.col("l") * F.col("r")).alias("shared_keys"))
    pct = lambda c: F.bround(F.try_divide(F.col("shared_keys") * 100.0, F.col(c)), 2)
    return out.withColumns({"left_covered_pct": pct("left_keys"), "right_covered_pct": pct("right_keys")})
