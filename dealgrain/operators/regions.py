"""Region dimension, enrichment and market scopes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..session import local_table
from .scale import smallest_row

REGION_SCHEMA = (
    "region_key string, region_name string, region_level_1 string, region_level_2 string, sido string, "
    "sigungu string, lawd_cd string, region_code string, market_area string, is_busan boolean, is_satellite boolean"
)
DIMENSIONS = ["region_key", "region_name", "region_level_1", "region_level_2", "market_area", "is_busan", "is_satellite"]


def region_rows(config: dict, selector: str | Iterable[str] = "all") -> list[tuple]:
    """Dimension rows from the region configuration (one row per district code)."""
    rows = []
    for key in region_keys(config, selector):
        r = config[key]
        for code, district in r["lawd_codes"].items():
            code = str(code).zfill(5)
            area = r.get("market_area_overrides", {}).get(code, r["market_area"])
            rows.append(
                (key, r["label"], r["region_level_1"], r["region_level_2"], r["sido"], district, code, code, area,
                 bool(r["is_busan"]), bool(r["is_satellite"]))
            )
    return rows


def region_keys(config: dict, selector: str | Iterable[str] = "all") -> list[str]:
    """Configured keys for a selector: a key, ``satellite``, ``all`` or a list of these."""
    keys: dict[str, None] = {}
    for value in [selector] if isinstance(selector, str) else selector:
        name = str(value).strip().lower()
        if name == "all":
            keys.update(dict.fromkeys(config))
        elif name == "satellite":
            keys.update(dict.fromkeys(k for k, r in config.items() if r["is_satellite"]))
        elif name in config:
            keys[name] = None
        else:
            raise ValueError(f"unknown region: {value}")
    return list(keys)


def region_dimension(spark: SparkSession, config: dict, selector: str | Iterable[str] = "all") -> DataFrame:
    return local_table(spark, region_rows(config, selector), REGION_SCHEMA)


def enrich(df: DataFrame, dimension: DataFrame, code: str = "region_code", sido: str = "sido", sigungu: str = "sigungu") -> DataFrame:
    """Add region columns by district code, then by province and district name where the code is unknown.

    Values already present win. The dimension is left to the optimizer, which broadcasts it
    while its measured size is small.
    """
    for c in (code, sido, sigungu, *DIMENSIONS):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("boolean" if c.startswith("is_") else "string"))
    df = df.withColumn("region_code", text.region_code(F.col(code)))
    by_code = smallest_row(dimension.select("region_code", *DIMENSIONS, "sido", "sigungu"), ["region_code"]).select(
        F.col("region_code"), *[F.col(c).alias(f"_c_{c}") for c in (*DIMENSIONS, "sido", "sigungu")]
    )
    df = df.join(by_code, "region_code", "left")
    df = df.withColumns({c: F.coalesce(F.col(c), F.col(f"_c_{c}")) for c in DIMENSIONS})
    df = df.withColumns({"sido": F.coalesce(F.col(sido), F.col("_c_sido")), "sigungu": F.coalesce(F.col(sigungu), F.col("_c_sigungu"))})
    df = df.drop(*[f"_c_{c}" for c in (*DIMENSIONS, "sido", "sigungu")])
    # One row per region: the district must match where a region is a single district,
    # and the whole province counts otherwise.
    per_region = dimension.groupBy("region_key", "sido").agg(
        F.countDistinct("region_code").alias("_n"),
        F.min("sigungu").alias("_one"),
        *[F.min(c).alias(f"_f_{c}") for c in DIMENSIONS if c not in ("region_key", "market_area")],
        F.mode("market_area").alias("_f_market_area"),
    )
    per_region = per_region.select(
        F.col("sido").alias("_f_sido"), F.when(F.col("_n") == 1, F.col("_one")).alias("_f_sigungu"),
        F.col("region_key").alias("_f_region_key"), *[F.col(f"_f_{c}") for c in DIMENSIONS if c != "region_key"],
    )
    on = (
        df["region_key"].isNull()
        & (df["sido"] == per_region["_f_sido"])
        & (per_region["_f_sigungu"].isNull() | (df["sigungu"] == per_region["_f_sigungu"]))
    )
    df = df.join(per_region, on, "left")
    df = df.withColumns({c: F.coalesce(F.col(c), F.col(f"_f_{c}")) for c in DIMENSIONS})
    return df.drop("_f_sido", "_f_sigungu", *[f"_f_{c}" for c in DIMENSIONS])


def override_district(df: DataFrame, dimension: DataFrame, code: str = "lawd_cd") -> DataFrame:
    """The configured district name of a code wins over the recorded one."""
    names = dimension.groupBy(F.col("lawd_cd").alias(code)).agg(F.min("sigungu").alias("_named"))
    joined = df.join(names, code, "left")
    recorded = F.col("sigungu") if "sigungu" in df.columns else F.lit(None).cast("string")
    return joined.withColumn("sigungu", F.coalesce(F.col("_named"), recorded)).drop("_named")


def in_scope(df: DataFrame, config: dict, selector: str) -> DataFrame:
    """Rows of the selected regions; without a region key, the city flag; without both, all rows."""
    keys = region_keys(config, selector)
    if "region_key" in df.columns:
        return df.where(F.col("region_key").isin(keys))
    if selector == "busan" and "is_busan" in df.columns:
        return df.where(F.coalesce(F.col("is_busan"), F.lit(False)))
    return df


def metadata_filter(households: tuple, approval_years: tuple, keep_unregistered: bool = False) -> Column:
    """Households and approval year within inclusive ranges, optionally or an unregistered id."""
    ok = F.col("households").between(*households) & F.col("approval_year").between(*approval_years)
    if keep_unregistered:
        ok = F.coalesce(ok, F.lit(False)) | F.col("internal_complex_id").startswith("TRADE_")
    return F.coalesce(ok, F.lit(False))


def with_approval_year(df: DataFrame, as_of: str) -> DataFrame:
    """Year of approval, else the as-of year minus the age."""
    year = F.year(F.lit(as_of).cast("date"))
    return df.withColumn("approval_year", F.coalesce(F.year("approval_date"), year - F.col("apartment_age")))


def explore(
    panel: DataFrame,
    complexes: DataFrame,
    metadata: Column,
    districts: list[str] = (),
    dongs: list[str] = (),
    names: list[str] = (),
    month_range: tuple[str, str] | None = None,
    area_groups: list[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Complexes passing all filters and the panel rows that belong to them."""
    chosen = complexes.where(metadata)
    for column, values in (("sigungu", districts), ("dong", dongs), ("complex_name", names)):
        if values:
            chosen = chosen.where(F.col(column).isin(list(values)))
    rows = panel
    if month_range:
        rows = rows.where(F.col("year_month").between(*month_range))
    if area_groups:
        rows = rows.where(F.col("area_group").isin(list(area_groups)))
    return chosen, rows.join(chosen.select("internal_complex_id").distinct(), "internal_complex_id", "left_semi")


def with_region(panel: DataFrame, complexes: DataFrame, column: str = "region_key") -> DataFrame:
    """The region of every panel row by its complex id; unknown complexes stay without one."""
    named = complexes.groupBy("internal_complex_id").agg(F.min(column).alias(column))
    return panel.drop(column).join(named, "internal_complex_id", "left")


def missing_regions(panel: DataFrame, complexes: DataFrame, required: DataFrame, column: str = "region_key") -> DataFrame:
    """Required regions without a single panel row; empty when all are covered."""
    present = with_region(panel, complexes, column).select(column).where(F.col(column).isNotNull()).distinct()
    return required.select(column).distinct().join(present, column, "left_anti")
