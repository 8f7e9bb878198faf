from __future__ import annotations

import datetime as dt

import pytest
from conftest import as_dicts
from pyspark.sql import functions as F

from dealgrain.operators import clean, quality, regions
from dealgrain.plans.adapters import REGIONS

RAW = "dealAmount string, excluUseAr string, floor string, dealYear string, dealMonth string, dealDay string, buildYear string, umdNm string, aptNm string, jibun string, cdealDay string, cdealType string, lawd_cd string, source_row_id string"
BASE = dict(dealAmount="50,000", excluUseAr="59", floor="10", dealYear="2026", dealMonth="8", dealDay="1", aptNm="검증 아파트", umdNm="우 동", jibun="1", lawd_cd="26110")


def test_units_bands_and_missing_days(make):
    raw = make([dict(BASE, dealAmount="85,000", excluUseAr="79.99", source_row_id="1"), dict(BASE, excluUseAr="84.95", dealDay=None, source_row_id="2"), dict(BASE, excluUseAr="90.0", dealYear="x", source_row_id="3")], RAW)
    rows = as_dicts(clean.clean_sales(raw, "2026-09-12", "source_row_id"), "source_row_id")
    assert [r["area_group"] for r in rows] == ["65_80", "80_90", "90_120"]
    assert rows[0]["deal_amount_krw"] == 850_000_000 and rows[0]["dong"] == "우동" and rows[0]["complex_name_normalized"] == "검증"
    assert rows[0]["deal_date"] == dt.date(2026, 8, 1) and rows[0]["provisional"] and rows[1]["deal_date"] is None and not rows[1]["provisional"]
    assert rows[2]["year_month"] is None and rows[0]["region_code"] == "26110"


def test_occurrences_are_kept_and_cancelled_ones_dropped(make):
    raw = make([dict(BASE, source_row_id="one"), dict(BASE, source_row_id="two"), dict(BASE, source_row_id="cancel", cdealType="O")], RAW)
    kept = as_dicts(clean.clean_sales(raw, "2026-09-12", "source_row_id", keep_occurrences=True))
    assert {r["source_row_id"] for r in kept} == {"one", "two"}


def test_a_later_cancelled_copy_removes_the_contract(make):
    raw = make([dict(BASE, source_row_id="1"), dict(BASE, source_row_id="2", cdealDay="26.08.09"), dict(BASE, floor="11", source_row_id="3", cdealDay="26.08.01"), dict(BASE, floor="11", source_row_id="4")], RAW)
    assert [r["source_row_id"] for r in as_dicts(clean.clean_sales(raw, "2026-09-12", "source_row_id"))] == ["4"]


def test_korean_names_and_alias_order(make):
    raw = make([{"거래금액": None, "dealAmount": "1", "층": "3"}], "`거래금액` string, dealAmount string, `층` string")
    row = as_dicts(clean.canonical(raw, clean.SALE_ALIASES))[0]
    assert (row["deal_amount"], row["floor"], row["jibun"]) == ("1", "3", None)


def test_rents(make):
    raw = make(
        [dict(deposit="30,000", monthlyRent="0", excluUseAr="84.9", dealYear=2026, dealMonth=8, dealDay=3, sggCd="26350"), dict(deposit="5,000", monthlyRent="120", excluUseAr="59.0", dealYear=2026, dealMonth=8, dealDay=3, sggCd="26350")] * 2,
        "deposit string, monthlyRent string, excluUseAr string, dealYear int, dealMonth int, dealDay int, sggCd string",
    )
    rows = as_dicts(clean.clean_rents(raw, "2026-09-12"), "rent_type")
    assert [(r["rent_type"], r["deposit_krw"], r["monthly_rent_krw"]) for r in rows[::2]] == [("월세", 50_000_000, 1_200_000), ("전세", 300_000_000, 0)]
    assert len(rows) == 4


def test_register(make):
    raw = make(
        [dict(kaptCode="A1", kaptName="금호 아파트", kaptAddr="부산광역시 중구 영주동 산 161-2 금호", kaptdaCnt="0", hoCnt="500", kaptUsedate="20100102", kaptdPcnt="500", kaptdPcntu="125", bjdCode="2611010100", useYn="N"),
         dict(kaptCode="A2", kaptdaCnt="0", useYn="N"), dict(kaptCode="A3", kaptdaCnt=None, useYn="Y")],
        "kaptCode string, kaptName string, kaptAddr string, kaptdaCnt string, hoCnt string, kaptUsedate string, kaptdPcnt string, kaptdPcntu string, bjdCode string, useYn string",
    )
    row = as_dicts(clean.clean_master(raw, "2026-09-12"), "kapt_code")[0]
    assert (row["households"], row["parking_total"], row["parking_per_household"]) == (500, 625, 1.25)
    assert (row["jibun"], row["dong"], row["apartment_age"], row["age_group"], row["is_500plus"]) == ("산161-2", "영주동", 16, "11~20년", True)
    assert [r.kaptCode for r in clean.active_master_rows(raw).collect()] == ["A1", "A3"]


def test_regions_by_code_then_by_province(make, spark):
    dim = regions.region_dimension(spark, REGIONS)
    assert dim.count() == 18
    rows = make([dict(region_code="2671012345", sido=None, sigungu=None), dict(region_code="", sido="경상남도", sigungu="김해시"), dict(region_code="", sido="경상남도", sigungu="창원시"), dict(region_code=None, sido="부산광역시", sigungu="없는구")], "region_code string, sido string, sigungu string")
    got = [(r["region_key"], r["market_area"], r["sigungu"], r["is_satellite"]) for r in as_dicts(regions.enrich(rows, dim))]
    assert sorted(got, key=str) == sorted([("busan", "BUSAN_GIJANG", "기장군", False), ("gimhae", "GIMHAE", "김해시", True), (None, None, "창원시", None), ("busan", "BUSAN_CORE", "없는구", False)], key=str)
    assert regions.region_keys(REGIONS, "satellite") == ["yangsan", "gimhae"]
    with pytest.raises(ValueError):
        regions.region_keys(REGIONS, "seoul")


def test_metadata_filter_keeps_unregistered_only_on_request(make):
    rows = make([dict(internal_complex_id="A", households=100.0, approval_year=2000), dict(internal_complex_id="TRADE_1"), dict(internal_complex_id="B", households=10.0, approval_year=2000)], "internal_complex_id string, households double, approval_year int")
    ids = lambda keep: [r[0] for r in rows.where(regions.metadata_filter((50, 200), (1990, 2010), keep)).collect()]
    assert ids(False) == ["A"] and ids(True) == ["A", "TRADE_1"]


def test_gates(make, spark):
    df = make([dict(k="a", v=1), dict(k="a", v=2)], "k string, v int")
    with pytest.raises(ValueError, match="missing columns"):
        quality.require_columns(df, ["k", "x", "y"])
    with pytest.raises(ValueError, match="not unique"):
        quality.require_unique(df, ["k"])
    quality.require_unique(df, ["k", "v"])
    quality.require_same_members(df.select("k"), df.select("k").distinct(), "same")
    with pytest.raises(ValueError):
        quality.require_same_members(df.select("v"), df.select("v").where("v = 1"), "differ")
    master = make([dict(kapt_code="A", complex_name="n", households=1.0)], "kapt_code string, complex_name string, households double")
    quality.register_gate(master, 1, 0.8)
    with pytest.raises(ValueError):
        quality.register_gate(master.unionAll(master))


def test_relabel_rejects_unknown_columns(make):
    df = make([dict(price=2.5e8, flag=True)], "price double, flag boolean")
    assert as_dicts(clean.relabel(df, {"price": "가격(억)", "flag": "여부"}, eok=["price"], flags=["flag"])) == [{"가격(억)": 2.5, "여부": "예"}]
    with pytest.raises(KeyError):
        clean.relabel(df.withColumn("x", F.lit(1)), {"price": "가격", "flag": "여부"})
