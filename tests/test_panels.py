from __future__ import annotations

import datetime as dt
import statistics

import pytest
from conftest import as_dicts
from pyspark.sql import Window
from pyspark.sql import functions as F

from dealgrain.operators import panel, ranking, rent, summary

SALE = "internal_complex_id string, kapt_code string, year_month string, area_group string, deal_amount_krw double, price_per_sqm double, price_per_3_3sqm double, sigungu string, dong string, complex_name string, provisional boolean"


def sale(month, price=1e8, area="80_90", complex_id="A", **more):
    return dict(internal_complex_id=complex_id, year_month=month, area_group=area, deal_amount_krw=price, price_per_sqm=price / 84, price_per_3_3sqm=price / 84 * 3.3, sigungu="구", dong="동", complex_name="이름", provisional=False, **more)


def test_twelve_months_and_turnover(make):
    sales = make([sale(f"2025-{m:02d}") for m in range(1, 13)], SALE)
    master = make([dict(kapt_code="A", households=100.0)], "kapt_code string, households double")
    last = as_dicts(panel.sale_panel(sales, master), "year_month")[-1]
    assert (last["transactions_12m"], last["turnover_12m"], last["low_sample_flag"]) == (12, 0.12, False)


def test_turnover_is_unknown_without_households(make):
    rows = as_dicts(panel.sale_panel(make([sale("2025-01")], SALE), make([dict(kapt_code="A", households=0.0)], "kapt_code string, households double")))
    assert rows[0]["turnover_12m"] is None and rows[0]["low_sample_flag"]


def test_gaps_returns_and_drawdown(make):
    sales = make([sale("2025-01", 100.0), sale("2025-04", 50.0), sale("2025-06", 80.0, area=None), sale("2025-06", 10.0, complex_id="B", area="40_55")], SALE)
    rows = {(r["internal_complex_id"], r["area_group"], r["year_month"]): r for r in as_dicts(panel.sale_panel(sales))}
    assert len(rows) == 6 + 1 + 1
    may = rows[("A", "80_90", "2025-05")]
    assert (may["transaction_count"], may["transactions_3m"], may["price_3m"], may["price_6m"]) == (0, 1, 50.0, 75.0)
    assert may["drawdown_from_peak"] == -0.5 and may["recovery_from_trough"] == 0 and may["complex_name"] == "이름"
    assert rows[("A", "80_90", "2025-04")]["return_3m"] == pytest.approx(-0.5)
    assert rows[("A", None, "2025-06")]["transaction_count"] == 1


def test_panel_has_one_row_per_series_and_month(make):
    sales = make([sale(f"20{y}-{m:02d}", 1.0 + m, area=a, complex_id=c) for y in (23, 24) for m in (1, 5, 9) for a in ("40_55", "80_90") for c in "ABC"], SALE)
    df = panel.sale_panel(sales)
    assert df.count() == 3 * 2 * 21 == df.select("internal_complex_id", "area_group", "year_month").distinct().count()
    assert df.agg(F.sum("transaction_count")).first()[0] == sales.count()


def test_rolling_medians_skip_unknown_months(make):
    values = [4, None, 9, 1, None, None, None, 7, 2]
    w = Window.partitionBy("s").orderBy("i")
    df = panel.with_rolling_medians(make([dict(s="a", i=i, v=v) for i, v in enumerate(values)], "s string, i int, v long"), {"m3": ("v", 3), "m6": ("v", 6)}, w)
    frame = lambda i, n: [v for v in values[max(0, i - n + 1) : i + 1] if v is not None]
    assert df.columns == ["s", "i", "v", "m3", "m6"]
    for r in df.collect():
        assert [r.m3, r.m6] == [statistics.median(f) if f else None for f in (frame(r.i, 3), frame(r.i, 6))]
    assert "percentile(" not in df._jdf.queryExecution().optimizedPlan().toString()


RENT = "internal_complex_id string, kapt_code string, year_month string, area_group string, complex_name string, sigungu string, dong string, provisional boolean, rent_type string, deposit_krw double, monthly_rent_krw double"
MARKET = "internal_complex_id string, kapt_code string, year_month string, area_group string, deal_amount_krw double"


def test_deposit_to_price_ratio(make):
    base = dict(kapt_code="A1", area_group="80_90", complex_name="센텀", sigungu="해운대구", dong="우동", provisional=False)
    rents = make([dict(base, internal_complex_id="A1", year_month="2025-01", rent_type="전세", deposit_krw=3e8, monthly_rent_krw=0.0), dict(base, year_month="2025-02", rent_type="월세", deposit_krw=5e7, monthly_rent_krw=1.2e6)], RENT)
    sales = make([dict(internal_complex_id="A1", year_month="2025-01", area_group="80_90", deal_amount_krw=5e8), dict(kapt_code="A1", year_month="2025-02", area_group="80_90", deal_amount_krw=6e8)], MARKET)
    rows = as_dicts(rent.rent_panel(rents, sales), "year_month")
    assert rows[0]["jeonse_ratio_12m"] == pytest.approx(0.6) and rows[1]["jeonse_ratio_12m"] == pytest.approx(300 / 550)
    assert (rows[1]["jeonse_count_12m"], rows[1]["monthly_rent_count_12m"], rows[1]["sale_count_12m"]) == (1, 1, 2)
    lines = as_dicts(rent.price_and_deposit_lines(rent.rent_panel(rents, sales), "A1", "80_90"))
    assert len(lines) == 4


def test_both_markets_meet_by_whole_and_by_unknown_keys_without_dealing_again(make):
    base = dict(year_month="2025-01", rent_type="전세", deposit_krw=3e8)
    rents = make([dict(base, internal_complex_id="A", area_group="80_90"), dict(base, internal_complex_id="A"), dict(base, area_group="80_90"), dict(base, internal_complex_id="R", area_group="80_90")], RENT)
    sales = make([dict(internal_complex_id=i, year_month="2025-01", area_group=g, deal_amount_krw=5e8) for i, g in (("A", "80_90"), ("A", None), (None, None), ("S", "80_90"))], MARKET)
    both = rent.combine_markets(rent.monthly_rents(rents), rent.monthly_sale_prices(sales))
    got = {(r["internal_complex_id"], r["area_group"], r["jeonse_count"], r["sale_count"]) for r in as_dicts(both)}
    assert got == {("A", "80_90", 1, 1), ("A", None, 1, 1), (None, "80_90", 1, None), (None, None, None, 1), ("R", "80_90", 1, None), ("S", "80_90", None, 1)}
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert any("FullOuter" in line and "<=>" not in line for line in plan.splitlines())


LOG = "lawd_cd string, dong string, jibun string, complex_name_normalized string, trade_complex_name string, kapt_code string, internal_complex_id string, match_method string, match_score double, manual_review boolean, trade_road_address_key string"
SOLD = "lawd_cd string, sigungu string, dong string, jibun string, complex_name string, complex_name_normalized string, road_name string, road_main string, road_sub string, kapt_code string, internal_complex_id string, match_method string, match_score double, src int"


def test_crosswalk_by_road_skips_strict_districts(make):
    rents = make([dict(lawd_cd=c, dong="d", jibun="9", complex_name_normalized="n", internal_complex_id="R", match_method="unmatched", match_score=0.0, manual_review=True, trade_road_address_key=f"{c}|가로|5") for c in ("26110", "48250")], LOG)
    sales = make([dict(lawd_cd=c, sigungu="구", dong="d", jibun="1", complex_name_normalized="n", road_name="가로", road_main="5", internal_complex_id="S", match_method="unmatched", match_score=0.0, src=1) for c in ("26110", "48250")], SOLD)
    log, audit = rent.align_rents_to_sales(rents, sales, "src", strict_regions=["48250"])
    rows = as_dicts(log, "lawd_cd")
    assert (rows[0]["internal_complex_id"], rows[0]["match_method"], rows[0]["manual_review"]) == ("S", "sale_crosswalk_road:unmatched", True)
    assert rows[1]["internal_complex_id"] == "R"
    assert [r["crosswalk_key"] for r in as_dicts(audit)] == ["road_address"]


def test_addresses_are_parsed_once_per_complex(make):
    side = lambda i: make([dict(lawd_cd="26110", sigungu="구", complex_name_normalized="n", road_name="가로", road_main="5", internal_complex_id=i)] * 3, SOLD)
    found = rent.road_conflicts(side("S"), side("R"))
    assert [(r.sale_internal_complex_id, r.rent_internal_complex_id) for r in found.collect()] == [("S", "R")]
    # A parse in this plan would stand below the grouping, once per contract.
    assert "regexp" not in found._jdf.queryExecution().executedPlan().toString()


def test_conflicts_abort_the_build(make):
    side = lambda i: make([dict(lawd_cd="26110", dong="d", jibun="1", complex_name="n", complex_name_normalized="n", internal_complex_id=i)], SOLD)
    rent.require_no_conflicts(rent.market_conflicts(side("S"), side("S")))
    with pytest.raises(ValueError):
        rent.require_no_conflicts(rent.market_conflicts(side("S"), side("R")))


PANEL = "internal_complex_id string, year_month string, area_group string, transaction_count long, complex_name string, sigungu string, dong string"


@pytest.fixture
def volumes(make):
    rows = [("A", "2026-08", 9, "남구"), ("A", "2026-07", 5, "남구"), ("C", "2026-08", 7, "동구"), ("B", "2026-08", 1, "남구"), ("B", "2026-06", 22, "남구"), ("D", "2025-12", 50, "동구")]
    return make([dict(internal_complex_id=i, year_month=m, area_group="80_90", transaction_count=n, complex_name=i, sigungu=s, dong=s) for i, m, n, s in rows], PANEL)


@pytest.fixture
def homes(make):
    return make([dict(internal_complex_id="A", households=700), dict(internal_complex_id="B", households=1000), dict(internal_complex_id="C", households=0)], "internal_complex_id string, households long")


def test_volume_rankings(volumes, homes):
    one = as_dicts(ranking.volume_ranking(volumes, 1, homes).orderBy("rank"))
    assert [(r["internal_complex_id"], r["transaction_count"]) for r in one] == [("A", 9), ("C", 7), ("B", 1)]
    assert one[0]["transaction_rate"] == pytest.approx(9 / 700 * 100) and one[1]["transaction_rate"] is None
    three = as_dicts(ranking.volume_ranking(volumes, 3, homes, sigungu="남구").orderBy("rank"))
    assert [(r["internal_complex_id"], r["transaction_count"]) for r in three] == [("B", 23), ("A", 14)]
    assert (three[0]["window_start"], three[0]["window_end"]) == ("2026-06", "2026-08")
    ytd = as_dicts(ranking.volume_ranking(volumes, "ytd", homes))
    assert "D" not in {r["internal_complex_id"] for r in ytd} and ytd[0]["window_start"] == "2026-01"
    for bad in (0, "year"):
        with pytest.raises(ValueError):
            ranking.volume_ranking(volumes, bad, homes)


def test_region_volume_leaves_out_unknown_places(volumes, make):
    extra = make([dict(internal_complex_id="E", year_month="2026-08", transaction_count=3)], PANEL)
    rows = as_dicts(ranking.region_volume(volumes.unionByName(extra), 1, "sigungu"))
    assert [(r["sigungu"], r["transaction_count"]) for r in rows] == [("남구", 10), ("동구", 7)]


def test_recent_prices_and_search(make):
    trades = make(
        [dict(internal_complex_id="A", year_month="2026-08", deal_amount_krw=p, complex_name="계약명", is_cancelled=c) for p, c in ((5e8, False), (7e8, False), (9e8, False), (1e10, True))]
        + [dict(internal_complex_id="B", year_month="2026-08", deal_amount_krw=4e8, complex_name="계약명"), dict(internal_complex_id="A", year_month="2026-07", deal_amount_krw=1e8)],
        "internal_complex_id string, year_month string, deal_amount_krw double, complex_name string, sigungu string, dong string, is_cancelled boolean, provisional boolean",
    )
    master = make([dict(internal_complex_id="A", complex_name="등록명", households=500, parking_per_household=1.2, apartment_age=10)], "internal_complex_id string, complex_name string, sigungu string, dong string, households long, parking_per_household double, apartment_age int")
    prices = ranking.recent_prices(trades, master)
    rows = as_dicts(prices, "internal_complex_id")
    assert (rows[0]["median_price"], rows[0]["transaction_count"], rows[0]["min_price"], rows[0]["max_price"], rows[0]["complex_name"]) == (7e8, 3, 5e8, 9e8, "등록명")
    assert rows[1]["complex_name"] == "계약명"
    found = as_dicts(ranking.search_recent_prices(prices, (1e8, 7e8), (500, 500), (1.2, 1.2), (10, 10)))
    assert [(r["row_no"], r["internal_complex_id"]) for r in found] == [(1, "A")]
    with pytest.raises(ValueError):
        ranking.search_recent_prices(prices, (2, 1), (0, 1), (0, 1), (0, 1))


def test_watchlists(make):
    schema = "internal_complex_id string, sigungu string, dong string, apartment_age int, transactions_6m double, price_84 double, price_change_3m double, price_change_6m double, drawdown_from_peak double, low_sample_flag boolean"
    good = dict(sigungu="구", dong="동", apartment_age=35, transactions_6m=5.0, price_84=90.0, price_change_3m=0.0, price_change_6m=0.1, drawdown_from_peak=-0.2, low_sample_flag=False)
    rows = [dict(good, internal_complex_id="good"), dict(good, internal_complex_id="unknown sample", low_sample_flag=None), dict(good, internal_complex_id="falling", price_change_3m=-0.5), dict(good, internal_complex_id="new", apartment_age=None, price_84=110.0, drawdown_from_peak=None)]
    complexes = make(rows, schema)
    history = make([dict(internal_complex_id="good", year_month="2026-02", transaction_count=4.0), dict(internal_complex_id="good", year_month="2026-08", transaction_count=5.0)], "internal_complex_id string, year_month string, transaction_count double")
    got = as_dicts(summary.recovery_watchlist(complexes, history))
    assert [(r["internal_complex_id"], r["previous_6m_transactions"]) for r in got] == [("good", 4.0)]
    old = as_dicts(summary.old_watchlist(complexes), "internal_complex_id")
    assert {r["internal_complex_id"] for r in old} == {"good", "unknown sample", "falling"} and old[0]["discount_vs_dong_mean"] == 0


def test_unknown_ages_do_not_count_in_ratios(make):
    rows = make([dict(internal_complex_id=str(i), sigungu="구", apartment_age=a, households=h) for i, (a, h) in enumerate([(5, 600.0), (40, None), (None, 100.0)])],
                "internal_complex_id string, sigungu string, dong string, apartment_age int, households double, parking_per_household double, transactions_12m double, price_84 double, price_84_per_3_3sqm double, price_change_6m double, price_change_12m double, drawdown_from_peak double")
    row = as_dicts(summary.district_summary(rows))[0]
    assert (row["under_10year_ratio"], row["over_30year_ratio"], row["large_complex_count"], row["household_count"], row["complex_count"]) == (0.5, 0.5, 1, 700, 3)
    assert row["transactions_12m"] is None and row["turnover_12m"] is None


def test_newest_contracts(make):
    rows = make([dict(internal_complex_id="A", source_row_id=f"{i:03d}", year_month="2026-08", deal_date=dt.date(2026, 8, 1 + i % 28), deal_amount_krw=1e8, area_group="80_90") for i in range(80)],
                "internal_complex_id string, source_row_id string, year_month string, deal_date date, deal_amount_krw double, area_group string")
    got = as_dicts(ranking.recent_contracts(rows, "A", "2026-01", "2026-12"))
    assert len(got) == 50 and got[0]["deal_date"] == dt.date(2026, 8, 28) and got[0]["deal_amount_manwon"] == 10_000


def test_panel_is_not_dealt_by_month_for_its_flags(make):
    sales = make([{**sale(f"2025-{m:02d}", complex_id=c), "provisional": m == 3 and c == "A"} for m in (1, 3, 4) for c in "AB"], SALE)
    df = panel.sale_panel(sales)
    assert {(r["year_month"], r["provisional"]) for r in as_dicts(df)} == {("2025-01", False), ("2025-02", False), ("2025-03", True), ("2025-04", False)}
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_carried_attributes_are_those_filled_in_the_calendar(make):
    rows = [dict(internal_complex_id=c, area_group="a", year_month=f"2025-{m:02d}", n=m, name=x) for c, m, x in [("A", 1, None), ("A", 3, "x"), ("A", 6, None), ("B", 2, "y"), ("B", 4, "z"), ("C", 5, None)]]
    df = make(rows, "internal_complex_id string, area_group string, year_month string, n int, name string")
    order = ("internal_complex_id", "year_month")
    got = as_dicts(panel.fill_calendar(df, carried=["name"]), *order)
    assert got == as_dicts(panel.fill_attributes(panel.fill_calendar(df), ["name"]), *order)
    assert [r["name"] for r in got] == ["x"] * 6 + ["y"] * 2 + ["z"] * 3 + [None] * 2


def test_district_medians_meet_the_panel_without_dealing_it(make):
    rows = [dict(internal_complex_id=c, area_group="a", year_month=f"2025-{m:02d}", sigungu=d, turnover_12m=t) for m in (1, 2) for c, d, t in [("A", "p", 1.0), ("B", "p", 3.0), ("C", None, 4.0), ("D", "q", None)]]
    df = panel.add_relative_turnover(make(rows, "internal_complex_id string, area_group string, year_month string, sigungu string, turnover_12m double"))
    assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()
    found = {(r["internal_complex_id"], r["district_relative_turnover"]) for r in as_dicts(df)}
    assert found == {("A", 0.5), ("B", 1.5), ("C", 1.0), ("D", None)}


def test_recent_months_are_those_of_the_whole_panel(make):
    rows = [sale(f"{2021 + m // 12}-{m % 12 + 1:02d}", 1e8 + 1e6 * ((m * 7) % 23), area, name) for name, step in (("A", 1), ("B", 5), ("C", 17)) for area in ("60_70", "80_90") for m in range(0, 40, step)]
    rows += [sale("2021-03", 9e8, complex_id="D"), sale("2024-04", 2e8, complex_id="E"), sale(None, 3e8, complex_id="F"), sale("2022-02", complex_id="G") | dict(deal_amount_krw=None), sale("2024-03", complex_id=None)]
    rows[3]["provisional"] = True
    monthly = panel.monthly_sales(make(rows, SALE))
    whole = panel.panel_of(monthly)
    for recent in (1, 3):
        found = panel.panel_of(monthly, recent=recent)
        assert set(found.columns) == set(whole.columns)
        last = sorted({r["year_month"] for r in as_dicts(whole)})[-recent:]
        want = [r for r in as_dicts(whole) if r["year_month"] in last]
        assert sorted(map(repr, as_dicts(found.select(*whole.columns)))) == sorted(map(repr, want)) and len(want) >= 8
    a, b = (sorted(map(repr, as_dicts(summary.complex_summary(p)))) for p in (whole, panel.panel_of(monthly, recent=1)))
    assert a == b
    assert panel.panel_of(monthly.limit(0), recent=1).count() == 0
