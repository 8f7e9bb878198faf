"""Band classifiers: areas, ages, sizes, price bands, priorities, coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds (exclusive) of the area groups with their group and label.
AREA_BANDS = [
    (40, "under_40", "소형"),
    (55, "40_55", "49형"),
    (65, "55_65", "59형"),
    (80, "65_80", "74형"),
    (90, "80_90", "84형"),
    (120, "90_120", "중대형"),
    (None, "over_120", "대형"),
]
# Upper bounds (inclusive) of the age groups.
AGE_BANDS = [(5, "0~5년"), (10, "6~10년"), (20, "11~20년"), (30, "21~30년"), (None, "30년 초과")]
# Review priority by number of contracts, cancel codes, coordinate bounds.
PRIORITY_LEVELS = [(30, "P1"), (10, "P2")]
CANCEL_CODES = ["O", "Y", "1", "해제"]
LATITUDE_RANGE = (32, 39)
LONGITUDE_RANGE = (124, 132)
PRICE_BAND_LOWEST, PRICE_BAND_HIGHEST = 4, 12  # 억


def _below(c: Column, bands: list, pick: int) -> Column:
    out = None
    for band in bands:
        if band[0] is None:
            return out.when(c.isNotNull(), F.lit(band[pick]))
        test = c < band[0]
        out = F.when(test, F.lit(band[pick])) if out is None else out.when(test, F.lit(band[pick]))
    return out


def area_group(area: Column) -> Column:
    return _below(area, AREA_BANDS, 1)


def area_label(area: Column) -> Column:
    return _below(area, AREA_BANDS, 2)


def age_group(age: Column) -> Column:
    out = F.when(age.isNull(), F.lit(None).cast("string"))
    for bound, label in AGE_BANDS:
        out = out.otherwise(label) if bound is None else out.when(age <= bound, label)
    return out


def size_and_age_flags(households: Column, age: Column) -> dict[str, Column]:
    """Size flags are false for unknown households; age flags stay null for unknown ages."""
    return {
        "is_500plus": F.coalesce(households >= 500, F.lit(False)),
        "is_1000plus": F.coalesce(households >= 1000, F.lit(False)),
        "is_under_10years": age <= 10,
        "is_over_20years": age > 20,
        "is_over_30years": age > 30,
    }


def cancelled(cancel_date: Column, cancel_code: Column) -> Column:
    dated = F.trim(F.coalesce(cancel_date.cast("string"), F.lit(""))) != ""
    coded = F.trim(F.coalesce(cancel_code.cast("string"), F.lit(""))).isin(CANCEL_CODES)
    return dated | coded


def rent_type(monthly_rent: Column) -> Column:
    return F.when(monthly_rent == 0, "전세").when(monthly_rent > 0, "월세").otherwise("미상")


def price_band(price_eok: Column) -> Column:
    """One-억 bands between an open first band and an open last band, lower bound included."""
    low, high = PRICE_BAND_LOWEST, PRICE_BAND_HIGHEST
    whole = F.floor(price_eok).cast("int")
    return (
        F.when(price_eok.isNull(), F.lit(None).cast("string"))
        .when(price_eok < low, f"{low}억 미만")
        .when(price_eok >= high, f"{high}억 이상")
        .otherwise(F.concat(whole.cast("string"), F.lit("~"), (whole + 1).cast("string"), F.lit("억")))
    )


def review_priority(count: Column) -> Column:
    out = None
    for bound, label in PRIORITY_LEVELS:
        out = F.when(count >= bound, label) if out is None else out.when(count >= bound, label)
    return out.otherwise("P3")


def coordinate_valid(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(*LATITUDE_RANGE) & lon.between(*LONGITUDE_RANGE), F.lit(False))


def between_or_false(c: Column, low, high) -> Column:
    """Inclusive range test that is false for null."""
    return F.coalesce(c.between(low, high), F.lit(False))
