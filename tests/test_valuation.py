from __future__ import annotations

import datetime as dt
from collections import Counter

import pytest
from conftest import as_dicts
from pyspark.sql import functions as F

from dealgrain.functions import intervals
from dealgrain.operators import pricing, valuation
from dealgrain.session import local_table
from dealgrain.sources import snapshots

COMPLEX = "kapt_code string, complex_name string, sigungu string, dong string, households double, approval_date date, sale_type string, building_type string"
AREA = "row long, kapt_code string, area_group_id string, exclusive_area_sqm double, supply_area_sqm double, type_name string, households double, source string, verified_at date, valid_from date, valid_to date, verification_status string, scope string, notes string"
TRADE = "kapt_code string, area_sqm double, deal_date date, deal_amount_krw double, source_row_id string"
D = dt.date


def complexes(make, **change):
    return make([dict(kapt_code="K1", complex_name="예제", sigungu="구", dong="동", households=1000.0, approval_date=D(2010, 1, 1), sale_type="분양", building_type="아파트", **{}) | change], COMPLEX)


def area_rows(**change):
    rows = []
    for i, (area, homes) in enumerate([(59.0, 400.0), (84.0, 600.0)]):
        rows.append(dict(row=i, kapt_code="K1", area_group_id=str(area), exclusive_area_sqm=area, supply_area_sqm=area + 20, households=homes, source="fixture", verified_at=D(2026, 9, 17), verification_status="verified", scope="sale_apartment") | change)
    return rows


def trade_rows(dates=(D(2026, 6, 1), D(2026, 7, 10), D(2026, 8, 31)), prices=((59.0, 5e8), (84.0, 7e8))):
    return [dict(kapt_code="K1", area_sqm=a, deal_date=d, deal_amount_krw=p, source_row_id=f"{a}:{d}") for a, p in prices for d in dates]


def value(make, homes=None, areas=None, trades=None, **options):
    homes = complexes(make) if homes is None else homes
    total, detail = valuation.estimate(homes, make(area_rows() if areas is None else areas, AREA), make(trade_rows() if trades is None else trades, TRADE), ["2026-08"], **options)
    return as_dicts(total)[0], as_dicts(detail, "area_group_id")


def test_whole_value_and_value_per_household(make):
    total, areas = value(make)
    assert total["market_cap_krw"] == 6200 * 1e8 and total["per_household_krw"] == 620_000_000 and total["grade"] == "A"
    assert sum(r["contribution_krw"] for r in areas) == total["market_cap_krw"] and total["reason"] == ""


@pytest.mark.parametrize(
    "dates, grade, window",
    [((D(2026, 6, 1), D(2026, 7, 1), D(2026, 8, 31)), "A", 3), ((D(2026, 3, 1), D(2026, 5, 1), D(2026, 8, 31)), "B", 6),
     ((D(2025, 9, 1), D(2026, 1, 1), D(2026, 8, 31)), "C", 12), ((D(2026, 8, 31),), "D", 12)],
)
def test_window_fallback(make, dates, grade, window):
    total, areas = value(make, trades=trade_rows(dates, ((59.0, 1e8), (84.0, 1e8))))
    assert total["grade"] == grade and {r["window_months"] for r in areas} == {window} and {r["transaction_count"] for r in areas} == {len(dates)}


def test_future_and_old_contracts_are_never_used(make):
    for day in (D(2026, 9, 1), D(2025, 8, 31)):
        total, _ = value(make, trades=trade_rows((day,)))
        assert total["market_cap_krw"] is None and total["price_coverage"] == 0


def test_median_pools_contracts(make):
    trades = [dict(kapt_code="K1", area_sqm=59.0, deal_date=d, deal_amount_krw=p) for d, p in ((D(2026, 6, 1), 100.0), (D(2026, 6, 2), 200.0), (D(2026, 8, 1), 1000.0))]
    row = as_dicts(valuation.median_prices(make(trades, TRADE), ["2026-08"]))[0]
    assert (row["price_krw"], row["price_1m_krw"], row["small_sample_1m"], row["method"]) == (200, 1000, True, "median_3m")
    assert (row["period_start"], row["period_end"], row["latest_deal_date"]) == (D(2026, 6, 1), D(2026, 8, 31), D(2026, 8, 1))


def test_missing_prices_stay_partial(make):
    total, areas = value(make, trades=trade_rows(prices=((59.0, 5e8),)))
    assert total["market_cap_krw"] is None and total["partial_cap_krw"] == 400 * 5e8 and total["price_coverage"] == 0.4
    assert areas[1]["price_krw"] is None and total["reason"] == "일부 평형 시세 미확보"


@pytest.mark.parametrize("change", [dict(households=-1.0), dict(households=None), dict(supply_area_sqm=1.0), dict(kapt_code="K9"), dict(verification_status="draft"), dict(verified_at=None), dict(scope="x")])
def test_faulty_register_rows_are_reported(make, change):
    rows = area_rows()
    rows[0] |= change
    assert valuation.master_issues(make(rows, AREA), complexes(make)).count() >= 1


def test_repeated_types_overlap_unless_validity_differs(make):
    issues = lambda rows: as_dicts(valuation.master_issues(make(rows, AREA), complexes(make)), "row")
    rows = area_rows() + [dict(r, row=r["row"] + 10) for r in area_rows()]
    assert [r["row"] for r in issues(rows)] == [10, 11]
    split = [dict(r, valid_to=D(2026, 8, 31)) for r in area_rows()] + [dict(r, row=r["row"] + 10, valid_from=D(2026, 9, 1)) for r in area_rows()]
    assert issues(split) == []
    total, _ = value(make, areas=split)
    assert total["grade"] == "A"


def test_household_mismatch_and_pending_rows(make):
    rows = area_rows()
    rows[0]["households"] = 399.0
    assert value(make, areas=rows)[0]["market_cap_krw"] is None
    rows[0] |= dict(households=400.0, verification_status="pending")
    assert value(make, areas=rows)[0]["grade"] == "산정 불완전"


def test_areas_match_exactly_and_approval_counts(make):
    trades = trade_rows(prices=((59.0, 5e8), (84.01, 7e8)))
    assert value(make, trades=trades)[0]["price_coverage"] == 0.4
    total, areas = value(make, homes=complexes(make, approval_date=D(2026, 9, 1)))
    assert total["market_cap_krw"] is None and total["price_coverage"] == 0 and areas[0]["method"] == "not_existing"


def test_area_snapping(make):
    trades = make([dict(kapt_code=k, area_sqm=a, source_row_id=str(i)) for i, (k, a) in enumerate([("K1", 84.9856), ("K1", 59.9069), ("K1", 70.1234), ("K2", 84.9856)])], TRADE)
    register = make([dict(kapt_code="K1", exclusive_area_sqm=a) for a in (84.98, 84.99, 59.90)], AREA)
    rows = as_dicts(valuation.snap_areas(trades, register), "source_row_id")
    assert [r["area_sqm"] for r in rows] == [84.98, 59.90, 70.1234, 84.9856]


@pytest.mark.parametrize("small, coverage, grade", [(50.0, 1.0, "D"), (51.0, 0.949, "산정 불완전")])
def test_extrapolation_needs_approval_and_coverage(make, small, coverage, grade):
    rows = area_rows()
    rows[0]["households"], rows[1]["households"] = small, 1000 - small
    total, areas = value(make, homes=complexes(make, sale_type="혼합"), areas=rows, trades=trade_rows(prices=((84.0, 7e8),)), approved=["K1"], extrapolation_coverage=0.95)
    assert (total["price_coverage"], total["grade"]) == (coverage, grade)
    assert (areas[0]["method"] == valuation.NEAREST_METHOD) == (grade == "D")


HISTORY = "month string, kapt_code string, sigungu string, households double, market_cap_krw double, per_household_krw double, grade string, rules_hash string, composition_hash string, method_signature string, input_hash string"


def history(make, rules="r"):
    rows = []
    for month, values, rule in (("2026-07", (("a", 100.0), ("b", 200.0)), "r"), ("2026-08", (("a", 200.0), ("b", 200.0), ("c", 300.0)), rules)):
        rows += [dict(month=month, kapt_code=k, sigungu="구", households=500.0, market_cap_krw=v, per_household_krw=v / 500, grade="A", rules_hash=rule, composition_hash="c", method_signature="m", input_hash="i") for k, v in values]
    return make(rows, HISTORY)


def test_ranks_common_cohort_and_newcomers(make):
    rows = {(r["month"], r["kapt_code"]): r for r in as_dicts(valuation.rank_history(history(make)))}
    a, b, c = (rows[("2026-08", k)] for k in "abc")
    assert (a["rank"], b["rank"], a["common_rank"], a["common_rank_change"], a["mom_pct"]) == (2, 2, 1, 1, 100)
    assert c["comparison_status"] == "신규" and a["comparison_status"] == "비교 가능" and a["yoy_pct"] is None
    assert rows[("2026-07", "a")]["comparison_status"] == "비교 불가"


def test_changed_rules_are_not_compared(make):
    rows = [r for r in as_dicts(valuation.rank_history(history(make, "changed"))) if r["month"] == "2026-08"]
    assert all(r["mom_pct"] is None for r in rows)
    assert {r["comparison_status"] for r in rows} == {"규칙 변경: 비교 불가", "신규"}


def test_snapshots_are_idempotent_and_revisions_need_a_reason(make, spark, tmp_path):
    homes, areas, trades = complexes(make), make(area_rows(), AREA), make(trade_rows(), TRADE)
    total, detail = valuation.estimate(homes, areas, trades, ["2026-08"])
    used = valuation.used_contracts(detail, trades)
    assert used.count() == 6 and not any(r.unusual_price for r in used.collect())
    root = str(tmp_path / "snapshots")
    assert snapshots.save_month(root, "2026-08", total, detail, used, "i", "r", "m")
    assert not snapshots.save_month(root, "2026-08", total, detail, used, "i", "r", "m")
    with pytest.raises(ValueError, match="reason"):
        snapshots.save_month(root, "2026-08", total, detail, used, "i2", "r", "m")
    double = total.withColumn("market_cap_krw", F.col("market_cap_krw") * 2)
    assert snapshots.save_month(root, "2026-08", double, detail, used, "i2", "r", "m", reason="수정")
    first, latest = (snapshots.read_history(spark, root, mode).first().market_cap_krw for mode in ("first", "latest"))
    assert latest == first * 2
    assert snapshots.read_manifest(spark, root).count() == 2


def priced_fixture():
    types, prices = [], []
    for i, (kind, supply, homes, price) in enumerate([("a", 100.0, 400.0, 50_000.0), ("b", 101.0, 600.0, 70_000.0)]):
        types.append(dict(row=i, kapt_code="K1", area_group_id=kind, exclusive_area_sqm=84.0, supply_area_sqm=supply, type_name=kind, households=homes, source="https://x/map?complex=1", verified_at=D(2026, 9, 18), verification_status="verified", scope="sale_apartment", notes=""))
        prices.append(dict(kapt_code="K1", kb_complex_id="1", kb_type_id=kind, exclusive_area_sqm=84.0, supply_area_sqm=supply, type_name=kind, households=homes, kb_sale_general=price, kb_sale_lower=price - 1000, kb_sale_upper=price + 1000, kb_price_date="", collected_at="2026-09-18T10:00:00", kb_url=""))
    return types, prices


PRICE = "kapt_code string, kb_complex_id string, kb_type_id string, exclusive_area_sqm double, supply_area_sqm double, type_name string, households double, kb_sale_general double, kb_sale_lower double, kb_sale_upper double, kb_price_date string, collected_at string, kb_url string"
STATUS = "kapt_code string, final_status string"
SPLIT = "kapt_code string, split_validity string, sale_households double, kapt_households double, rental_households_excluded double"


def external(make, types, prices, homes=None, splits=()):
    detail = pricing.link_prices(make(types, AREA), make(prices, PRICE))
    homes = complexes(make) if homes is None else homes
    total = pricing.estimate_external(homes, detail, make([dict(kapt_code="K1", final_status="VERIFIED_MASTER")], STATUS), make(list(splits), SPLIT))
    return total, detail


def test_linked_prices_in_won(make):
    total, detail = external(make, *priced_fixture())
    assert as_dicts(total)[0]["market_cap_krw"] == 6200 * 1e8 and as_dicts(total)[0]["rank"] == 1
    assert [r["price_krw"] for r in as_dicts(detail, "area_group_id")] == [5e8, 7e8]


@pytest.mark.parametrize("where, change", [("p", dict(kb_sale_general=None)), ("p", dict(kb_sale_lower=60_000.0)), ("p", dict(households=401.0)), ("p", dict(type_name="other")), ("p", dict(kb_complex_id="2")), ("t", dict(valid_from=D(2026, 10, 1))), ("p", dict(collected_at=""))])
def test_a_bad_price_never_gives_a_whole_value(make, where, change):
    types, prices = priced_fixture()
    (types if where == "t" else prices)[0].update(change)
    total, detail = external(make, types, prices)
    row = as_dicts(total)[0]
    assert row["market_cap_krw"] is None and row["partial_cap_krw"] == 4200 * 1e8 and as_dicts(detail, "area_group_id")[0]["price_reason"]


def test_repeated_and_reused_types(make):
    types, prices = priced_fixture()
    with pytest.raises(ValueError, match="not unique"):
        external(make, types, prices + prices[:1])
    _, detail = external(make, types + [dict(types[0], area_group_id="copy")], prices)
    assert {r["price_krw"] for r in as_dicts(detail) if r["kb_type_id"] == "a"} == {None}


def test_mixed_complexes_need_a_documented_split(make):
    homes = complexes(make, households=1200.0, sale_type="혼합")
    split = dict(kapt_code="K1", split_validity="OFFICIALLY_SUPPORTED", sale_households=1000.0, kapt_households=1200.0, rental_households_excluded=200.0)
    assert as_dicts(external(make, *priced_fixture(), homes)[0])[0]["market_cap_krw"] is None
    row = as_dicts(external(make, *priced_fixture(), homes, [split])[0])[0]
    assert (row["market_cap_krw"], row["eligible_households"], row["valuation_scope"]) == (6200 * 1e8, 1000, "분양 세대만 (임대 제외)")
    assert as_dicts(external(make, *priced_fixture(), homes, [split | dict(kapt_households=0.0)])[0])[0]["market_cap_krw"] is None


POLICY = {"method": "nearest_exclusive_area_unit_price", "source": "사용자 확인", "complexes": {"K1": {"households": 1000, "scope": "전체 주거 세대"}}}


@pytest.mark.parametrize("blocked", ["", "households", "inversion", "unauthorized", "no_donor", "expired"])
def test_adjustments_fill_only_authorised_gaps(make, spark, blocked):
    types, prices = priced_fixture()
    types[1]["exclusive_area_sqm"] = prices[1]["exclusive_area_sqm"] = 100.0
    prices[1]["kb_sale_general"] = None
    policy = {**POLICY, "complexes": dict(POLICY["complexes"])}
    if blocked == "households":
        policy["complexes"]["K1"] = {"households": 1001, "scope": "x"}
    elif blocked == "inversion":
        prices[1] |= dict(kb_sale_general=70_000.0, kb_sale_lower=80_000.0)
    elif blocked == "unauthorized":
        policy["complexes"] = {}
    elif blocked == "no_donor":
        prices[0]["kb_sale_general"] = None
    elif blocked == "expired":
        types[1]["valid_to"] = D(2026, 8, 31)
    total, detail = external(make, types, prices)
    adjusted, areas = pricing.adjust(total, detail, pricing.policy_table(spark, policy))
    row, parts = as_dicts(adjusted)[0], as_dicts(areas, "area_group_id")
    assert row["market_cap_krw"] is None
    if blocked:
        assert row["adjusted_market_cap_krw"] is None
    else:
        assert row["adjusted_market_cap_krw"] == 400 * 5e8 + 600 * round(5e8 / 84 * 100)
        assert (row["partial_cap_krw"], row["estimated_households"], parts[1]["reference_area_group_ids"]) == (400 * 5e8, 600, "a")
        assert row["adjusted_status"] == pricing.ADJUSTED and row["adjustment_source"] == "사용자 확인"


def test_overrides_and_unknown_types(make, spark):
    types, prices = priced_fixture()
    for p in prices:
        p |= dict(kb_sale_general=None, kb_sale_lower=None, kb_sale_upper=None)
    rule = {"households": 1000, "scope": "전체", "source": "검증", "price_method": "보정 추정", "type_price_overrides_krw": {"a": 5e8, "b": 7e8}}
    total, detail = external(make, types, prices)
    adjusted, areas = pricing.adjust(total, detail, pricing.policy_table(spark, {**POLICY, "complexes": {"K1": rule}}))
    row = as_dicts(adjusted)[0]
    assert (row["adjusted_market_cap_krw"], row["estimated_households"], row["adjustment_source"]) == (6200 * 1e8, 1000, "검증")
    assert {r["price_method"] for r in as_dicts(areas)} == {"보정 추정"}
    with pytest.raises(ValueError, match="does not exist"):
        pricing.adjust(total, detail, pricing.policy_table(spark, {**POLICY, "complexes": {"K1": {"households": 1000, "type_price_overrides_krw": {"없음": 1.0}}}}))


def test_whole_prices_are_not_relabelled(make, spark):
    total, detail = external(make, *priced_fixture())
    row = as_dicts(pricing.adjust(total, detail, pricing.policy_table(spark, POLICY))[0])[0]
    assert (row["estimated_households"], row["adjusted_status"], row["adjustment_source"]) == (0, "산정 완료", "")


def test_equal_areas_merge(make):
    types, _ = priced_fixture()
    row = as_dicts(pricing.merge_equal_areas(make(types, AREA)))[0]
    assert (row["households"], row["supply_area_sqm"], row["area_group_id"], row["type_name"]) == (1000, None, "exclusive_84", "a | b")
    types[1]["exclusive_area_sqm"] = 84.001
    assert pricing.merge_equal_areas(make(types, AREA)).count() == 2


def test_release_checks(make):
    total = make([dict(kapt_code="K", adjusted_market_cap_krw=10.0)], "kapt_code string, adjusted_market_cap_krw double")
    detail = make([dict(kapt_code="K", area_group_id="a", adjusted_contribution_krw=10.5)], "kapt_code string, area_group_id string, adjusted_contribution_krw double")
    meta = dict(run_id="r", producer="p", snapshot_schema_version=1, targets=1, adjusted_complete=1)
    assert snapshots.release_problems(meta, meta, total, detail, "p") == []
    assert "unexpected producer" in snapshots.release_problems(meta, meta, total, detail, "q")
    off = detail.withColumn("adjusted_contribution_krw", F.lit(20.0))
    assert "types do not add up to the complex" in snapshots.release_problems(meta, meta, total, off, "p")
    assert snapshots.release_problems({**meta, "run_id": "x"}, meta, total, detail, "p") == ["pointer and metadata differ in run_id"]


def test_days_meet_no_nodes_beyond_the_longest_interval(spark):
    rows = [(f, f + n - 1) for f in (0, 1, 5, 1023, 700_000) for n in (1, 2, 7, 8, 9, 64, 1000)]
    df = local_table(spark, rows, "f long, t long").withColumn("top", intervals.top_level(F.col("f"), F.col("t")))
    days = {r: set() for r in rows}
    for c in intervals.cover(df, "f", "t").collect():
        days[c.f, c.t] |= set(range(c.at << c.level, (c.at + 1) << c.level))
        assert c.level <= c.top
    assert all(days[f, t] == set(range(f, t + 1)) for f, t in rows)
    assert intervals.above(df.where("t = f"), "f", F.col("top")).count() == 5 * 2


def test_only_approved_types_are_stored_for_neighbour_prices(make, monkeypatch):
    stored = {}
    real = valuation.materialise
    monkeypatch.setattr(valuation, "materialise", lambda df, label: (stored.setdefault(label, df), real(df, label))[1])
    total, _ = value(make, approved=["K2"])
    assert total["market_cap_krw"] == 620e9 and stored["priced-types"].count() == 0


def test_used_contracts_of_windows_over_two_years(make):
    detail = make([dict(month="2026-02", kapt_code="K1", exclusive_area_sqm=84.0, transaction_count=3, window_months=12, period_start=D(2025, 3, 1), period_end=D(2026, 2, 28))],
                  "month string, kapt_code string, exclusive_area_sqm double, transaction_count long, window_months int, period_start date, period_end date")
    days = [D(2025, 2, 28), D(2025, 3, 1), D(2025, 12, 31), D(2026, 1, 1), D(2026, 2, 28), D(2026, 3, 1)]
    trades = make([dict(kapt_code="K1", area_sqm=84.0, deal_date=d, deal_amount_krw=p, source_row_id=str(d)) for d, p in zip(days, (9e9, 1e8, 1e8, 1e8, 3e8, 9e9))], TRADE)
    used = as_dicts(valuation.used_contracts(detail, trades), "source_row_id")
    assert [(r["deal_date"], r["unusual_price"]) for r in used] == [(d, d == D(2026, 2, 28)) for d in days[1:5]]


SPANS = "kapt_code string, area_group_id string, valid_from date, valid_to date"


@pytest.mark.parametrize("labels", [["2024-01", "2024-02", "2024-03", "2024-04", "2024-05"], ["2024-05", "2024-01", "2024-03"], []])
def test_spans_hold_the_active_months(make, labels):
    bounds = [(None, None), ("2024-02-01", None), ("2024-02-29", "2024-03-31"), (None, "2024-03-30"), ("2024-04-02", "2024-04-30"), ("2023-01-01", "2023-12-31"), ("2024-03-10", "2024-01-01"), ("2025-01-01", None)]
    rows = [dict(kapt_code=code, area_group_id=f"g{i}", valid_from=a and D.fromisoformat(a), valid_to=b and D.fromisoformat(b)) for code, chosen in (("a", bounds), ("b", bounds[1:2] * 2), (None, bounds[:4])) for i, (a, b) in enumerate(chosen)]
    master = make(rows, SPANS)
    spans = valuation.active_spans(master, labels).withColumn("_vm", F.explode("_months"))
    found = Counter((r["kapt_code"], r["area_group_id"], r["_vm"]) for r in as_dicts(spans))
    assert found == Counter((r["kapt_code"], r["area_group_id"], r["_vm"]) for r in as_dicts(valuation.active_months(master, labels)))


def test_months_of_one_composition_are_listed_once(make):
    rows = [dict(kapt_code=code, area_group_id=f"g{i}", valid_from=None, valid_to=D(2024, 6, 30) if i == 3 else None) for code in "abcd" for i in range(4)]
    master = make(rows, SPANS)
    labels = [f"{y}-{m:02d}" for y in (2023, 2024) for m in range(1, 13)]
    assert valuation.active_months(master, labels).count() == 4 * (4 * 24 - 6)
    assert valuation.active_spans(master, labels).count() == 4 * (4 + 3)


def test_details_are_stored_only_for_callers_that_read_them_twice(make, monkeypatch):
    labels = []
    real = valuation.materialise
    monkeypatch.setattr(valuation, "materialise", lambda df, label: (labels.append(label), real(df, label))[1])
    once = value(make, approved=["K1"])
    assert "valued-types" not in labels
    total, areas = value(make, approved=["K1"], stored=["transaction_count"])
    assert labels.count("valued-types") == 1 and total == once[0]
    assert areas == [{c: r[c] for c in (*valuation.TOTALLED, "transaction_count")} for r in once[1]]


def test_neighbour_prices_without_dealing_rows_again(make):
    homes, trades = complexes(make, households=60.0), make(trade_rows(prices=((50.0, 5e8), (70.0, 14e8))), TRADE)
    sizes = [("a", 50.0), ("b", 70.0), ("c", 70.0), ("d", 60.0), ("e", 71.0), ("f", 40.0)]
    areas = make([area_rows()[0] | dict(row=i, area_group_id=g, exclusive_area_sqm=s, households=10.0) for i, (g, s) in enumerate(sizes)], AREA)
    none = make([], "row long, kapt_code string, reason string")
    _, detail = valuation.estimate(homes, areas, trades, ["2026-08"], approved=["K1"], extrapolation_coverage=0.5, issues=none)
    found = {r["area_group_id"]: (r["price_krw"], r["method"] == valuation.NEAREST_METHOD) for r in as_dicts(detail)}
    assert found == {"a": (5e8, False), "b": (14e8, False), "c": (14e8, False), "d": (6e8, True), "e": (14.2e8, True), "f": (4e8, True)}
