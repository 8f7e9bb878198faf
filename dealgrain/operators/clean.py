"""Canonical columns and cleaning of raw sale, rent and master records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bands, months, numeric, text
from .scale import pick_row

# Accepted source names per logical column, in order of preference.
SALE_ALIASES = {
    "deal_amount": ["거래금액", "거래금액(만원)", "dealamount", "deal_amount"],
    "area_sqm": ["전용면적", "전용면적(㎡)", "excluusear", "area_sqm"],
    "floor": ["층", "floor"],
    "deal_year": ["년", "dealyear", "deal_year"],
    "deal_month": ["월", "dealmonth", "deal_month"],
    "deal_day": ["일", "dealday", "deal_day"],
    "build_year": ["건축년도", "buildyear", "build_year"],
    "dong": ["법정동", "umdnm", "dong"],
    "complex_name": ["아파트", "단지명", "aptnm", "aptname", "complex_name"],
    "jibun": ["지번", "jibun"],
    "road_name": ["도로명", "roadnm", "road_name"],
    "road_main": ["도로명건물본번호코드", "roadnmbonbun", "road_main"],
    "road_sub": ["도로명건물부번호코드", "roadnmbubun", "road_sub"],
    "cancel_date": ["해제사유발생일", "cdealday", "cancel_date"],
    "cancel_yn": ["해제여부", "cdealtype", "cancel_yn"],
    "sigungu": ["sigungu", "구군"],
    "lawd_cd": ["lawd_cd", "지역코드"],
}
RENT_ALIASES = {
    **{k: v for k, v in SALE_ALIASES.items() if k not in ("deal_amount", "cancel_date", "cancel_yn")},
    "deposit": ["보증금액", "보증금", "deposit"],
    "monthly_rent": ["월세금액", "월세", "monthlyrent", "monthly_rent"],
    "contract_term": ["계약기간", "contractterm", "contract_term"],
    "contract_type": ["계약구분", "contracttype", "contract_type"],
    "renewal_right_used": ["갱신요구권사용", "userrright", "renewal_right_used"],
    "previous_deposit": ["종전계약보증금", "predeposit", "previous_deposit"],
    "previous_monthly_rent": ["종전계약월세", "premonthlyrent", "previous_monthly_rent"],
    "lawd_cd": ["lawd_cd", "지역코드", "sggcd"],
}
MASTER_ALIASES = {
    "kapt_code": ["kaptcode", "kapt_code"],
    "complex_name": ["kaptname", "단지명", "complex_name"],
    "road_address": ["dorojuso", "doro_address", "도로명주소", "road_address"],
    "legal_address": ["kaptaddr", "법정동주소", "legal_address"],
    "dong": ["bjdname", "as3", "법정동", "dong"],
    "jibun": ["지번", "jibun"],
    "households": ["kaptdacnt", "hocnt", "세대수", "households"],
    "buildings": ["kaptdongcnt", "동수", "buildings"],
    "approval_date": ["kaptusedate", "사용승인일", "approval_date"],
    "parking_total": ["parkingcnt", "totalparkingcnt", "주차대수", "parking_total"],
    "parking_ground": ["kaptdpcntu", "지상주차", "parking_ground"],
    "parking_underground": ["kaptdpcnt", "지하주차", "parking_underground"],
    "heating": ["codeheatnm", "난방방식", "heating"],
    "mixed_use": ["kaptcate", "주상복합", "mixed_use"],
    "latitude": ["wgs84lat", "latitude", "위도"],
    "longitude": ["wgs84lon", "longitude", "경도"],
    "sigungu": ["as2", "sigungu", "구군"],
    "sido": ["as1", "sido", "시도"],
    "region_code": ["bjdcode", "bjd_code", "region_code"],
}
# Columns that identify one sale contract, and those kept for audits.
SALE_IDENTITY = ["lawd_cd", "dong", "jibun", "complex_name_normalized", "area_sqm", "floor", "deal_date", "deal_amount_krw"]
AUDIT_COLUMNS = ["source_row_id", "dealinggbn", "aptdong", "aptseq"]


def _present(df: DataFrame, names: list[str]) -> list[Column]:
    by_lower = {c.strip().lower(): c for c in df.columns}
    found = dict.fromkeys(by_lower[n.lower()] for n in names if n.lower() in by_lower)
    return [F.col(f"`{c}`").cast("string") for c in found]


def canonical(df: DataFrame, aliases: dict[str, list[str]], keep: list[str] = ()) -> DataFrame:
    """One string column per logical name: the first non-null of its aliases, null when none exists."""
    out = []
    for name, names in aliases.items():
        cols = _present(df, names)
        out.append((F.coalesce(*cols) if cols else F.lit(None).cast("string")).alias(name))
    return df.select(*out, *[F.col(k) for k in keep if k in df.columns])


def first_positive(df: DataFrame, names: list[str]) -> Column:
    """The first alias whose number is above zero, else the first non-null alias."""
    cols = _present(df, names)
    if not cols:
        return F.lit(None).cast("double")
    positive = [F.when(numeric.number(c) > 0, numeric.number(c)) for c in cols]
    return F.coalesce(*positive, *[numeric.number(F.coalesce(*cols))])


def _contract_columns(df: DataFrame) -> DataFrame:
    """Numbers, dates and names common to sales and rents."""
    deal_date = months.date_from_parts(F.col("deal_year"), F.col("deal_month"), F.col("deal_day"))
    return df.withColumns(
        {
            "area_sqm": numeric.number(F.col("area_sqm")),
            "floor": numeric.number(F.col("floor")),
            **{c: numeric.number(F.col(c)).cast("int") for c in ("road_main", "road_sub", "build_year")},
            "deal_date": deal_date,
            "dong": text.remove_spaces(F.col("dong")),
            "complex_name_normalized": text.normalize_name(F.col("complex_name")),
        }
    ).drop("deal_year", "deal_month", "deal_day")


def _band_columns(df: DataFrame, as_of: str, provisional_months: int) -> DataFrame:
    """Area bands, months and the provisional flag."""
    return df.withColumns(
        {
            "area_group": bands.area_group(F.col("area_sqm")),
            "area_label": bands.area_label(F.col("area_sqm")),
            "year": F.year("deal_date"),
            "month": F.month("deal_date"),
            "year_month": months.month_label(F.col("deal_date")),
            "provisional": months.is_provisional(months.month_index(F.col("deal_date")), as_of, provisional_months),
        }
    )


def drop_repeated(df: DataFrame, keys: list[str], source_order: str) -> DataFrame:
    """Keep the last row per key in source order; combined before the shuffle."""
    return pick_row(df, keys, [F.col(source_order)], last=True)


def clean_sales(
    raw: DataFrame,
    as_of: str,
    source_order: str,
    provisional_months: int = 2,
    drop_cancelled: bool = True,
    keep_occurrences: bool = False,
) -> DataFrame:
    """Clean sale contracts.

    ``source_order`` names a column with a total order of the source rows; it decides which
    copy of a repeated contract stays. Cancelled contracts are dropped after that, so a later
    cancelled copy also removes the earlier one. ``keep_occurrences`` keeps every copy.
    """
    extra = [c for c in raw.columns if c.lower() in AUDIT_COLUMNS]
    df = _contract_columns(canonical(raw, SALE_ALIASES, keep=list(dict.fromkeys([source_order, *extra]))))
    df = df.withColumns(
        {
            "deal_amount_krw": numeric.amount_krw(F.col("deal_amount")),
            "is_cancelled": bands.cancelled(F.col("cancel_date"), F.col("cancel_yn")),
        }
    )
    # Repeats go before anything else is derived, so the shuffle carries the narrow record.
    if not keep_occurrences:
        df = drop_repeated(df, SALE_IDENTITY, source_order)
    if drop_cancelled:
        df = df.where(~F.col("is_cancelled"))
    df = _band_columns(df, as_of, provisional_months).withColumns(
        {
            "price_per_sqm": numeric.price_per_sqm(F.col("deal_amount_krw"), F.col("area_sqm")),
            "apartment_age_at_deal": numeric.age_at_deal(F.col("deal_date"), F.col("build_year")),
            "legal_dong": F.col("dong"),
            "region_code": text.region_code(text.padded_code(F.col("lawd_cd"))),
        }
    )
    names = [F.col(c) for c in ("lawd_cd", "dong", "jibun", "complex_name_normalized")]
    identity = text.contract_id(names, F.col("area_sqm"), F.col("floor"), F.col("deal_date"), F.col("deal_amount_krw"))
    return df.withColumns({"price_per_3_3sqm": F.col("price_per_sqm") * numeric.PYEONG_SQM, "transaction_id": identity})


def clean_rents(raw: DataFrame, as_of: str, provisional_months: int = 2, keep: list[str] = ()) -> DataFrame:
    """Clean rent contracts. Equal rows stay: they may be different flats."""
    df = _band_columns(_contract_columns(canonical(raw, RENT_ALIASES, keep=list(keep))), as_of, provisional_months)
    money = ("deposit", "monthly_rent", "previous_deposit", "previous_monthly_rent")
    df = df.withColumns({f"{c}_krw": numeric.amount_krw(F.col(c)) for c in money})
    return df.withColumn("rent_type", bands.rent_type(F.col("monthly_rent_krw")))


def clean_master(raw: DataFrame, as_of: str) -> DataFrame:
    """Clean the complex register: addresses, households, parking, ages and size flags."""
    df = canonical(raw.withColumn("_households", first_positive(raw, MASTER_ALIASES["households"])), MASTER_ALIASES, keep=["_households"])
    numbers = ["buildings", "parking_total", "parking_ground", "parking_underground", "latitude", "longitude"]
    legal = F.col("legal_address")
    df = df.withColumns(
        {
            **{c: numeric.number(F.col(c)) for c in numbers},
            "households": F.col("_households"),
            "jibun": F.coalesce(F.col("jibun"), text.lot_from_address(legal)),
            "dong": F.coalesce(F.col("dong"), text.dong_from_address(legal)),
            "complex_name_normalized": text.normalize_name(F.col("complex_name")),
            "approval_date": parse_date(F.col("approval_date")),
        }
    ).drop("_households")
    today = F.lit(as_of).cast("date")
    df = df.withColumns(
        {
            "parking_total": numeric.parking_total(
                F.col("parking_total"), F.col("parking_ground"), F.col("parking_underground")
            ),
            "apartment_age": numeric.age_floor_years(F.col("approval_date"), today),
            "region_code": text.region_code(F.col("region_code")),
        }
    )
    return df.withColumns(
        {
            "parking_per_household": numeric.ratio(F.col("parking_total"), F.col("households")),
            "households_per_building": numeric.ratio(F.col("households"), F.col("buildings")),
            **bands.size_and_age_flags(F.col("households"), F.col("apartment_age")),
            "age_group": bands.age_group(F.col("apartment_age")),
        }
    )


def parse_date(c: Column) -> Column:
    """A date written as ``YYYYMMDD``, ``YYYY-MM-DD`` or a timestamp; null otherwise."""
    t = F.trim(c.cast("string"))
    return F.coalesce(
        F.try_to_date(F.when(t.rlike(r"^\d{8}$"), t), "yyyyMMdd"),
        F.try_to_date(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(t, 1, 10)), "yyyy-MM-dd"),
    )


def active_master_rows(raw: DataFrame, in_use: str = "useYn") -> DataFrame:
    """Register rows still in use or with a positive number of households."""
    households = first_positive(raw, MASTER_ALIASES["households"])
    used = F.col(in_use) == "Y" if in_use in raw.columns else F.lit(False)
    return raw.where(F.coalesce(used, F.lit(False)) | F.coalesce(households > 0, F.lit(False)))


def in_district(raw: DataFrame, district: str | None, names: list[str] = ("as2", "sigungu")) -> DataFrame:
    """Rows of one district; all rows when none is named."""
    cols = _present(raw, list(names))
    if not district or not cols:
        return raw
    return raw.where(F.trim(F.coalesce(*cols)) == district)


def merge_records(listed: DataFrame, basic: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """Listed records extended by basic and detail records; a later source wins per column."""
    out = listed
    for i, extra in enumerate((basic, detail)):
        renamed = extra.select(F.col(key), *[F.col(c).alias(f"_{i}_{c}") for c in extra.columns if c != key])
        out = out.join(renamed, key, "left")
        for c in extra.columns:
            if c != key:
                new = F.col(f"_{i}_{c}")
                out = out.withColumn(c, F.coalesce(new, F.col(c)) if c in out.columns else new).drop(f"_{i}_{c}")
    return out


def missing_records(listed: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Listed records whose key has no valid cached record yet."""
    return listed.join(cached.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def relabel(df: DataFrame, labels: dict[str, str], eok: list[str] = (), manwon: list[str] = (), flags: list[str] = ()) -> DataFrame:
    """Report names and units: won to 억 or 만원, flags to 예/아니오. An unmapped column is an error."""
    unknown = [c for c in df.columns if c not in labels]
    if unknown:
        raise KeyError(f"no report name for {unknown}")
    scaled = {c: F.col(c) / numeric.EOK for c in eok if c in df.columns}
    scaled |= {c: F.col(c) / numeric.MANWON for c in manwon if c in df.columns}
    scaled |= {c: F.when(F.col(c), "예").when(~F.col(c), "아니오") for c in flags if c in df.columns}
    return df.withColumns(scaled).withColumnsRenamed(labels) if scaled else df.withColumnsRenamed(labels)


def with_overrides(rows: DataFrame, overrides: DataFrame, key: str, override: str = "override", candidates: str = "candidates") -> DataFrame:
    """Address texts to look up, a stated override first (of several the smallest), without repeats."""
    joined = rows.join(overrides.groupBy(key).agg(F.min(override).alias(override)), key, "left")
    first = F.when(F.col(override).isNotNull(), F.array(override)).otherwise(F.array().cast("array<string>"))
    return joined.withColumn(candidates, F.array_distinct(F.concat(first, candidates))).drop(override)
