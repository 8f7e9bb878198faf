from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dealgrain.functions import bands, intervals, months, numeric, similarity, text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "fn, value, expected",
    [
        (text.normalize_name, " 센텀-파크(1차) 아파트 ", "센텀파크"),
        (text.normalize_name, None, ""),
        (text.normalize_address, " A-동 1번지 ", "a동1번지"),
        (text.lot_number, "산 0012-003", "산12-3"),
        (text.lot_number, "705-0", "705"),
        (text.lot_number, "0-5", "0-5"),
        (text.lot_number, "없음", ""),
        (text.lot_from_address, "부산광역시 중구 영주동  161-2 금호", "161-2"),
        (text.lot_from_address, "경남 김해시 외동 산 7- 이름", "산7"),
        (text.lot_from_address, "부산광역시", None),
        (text.dong_from_address, "경상남도 김해시 진영읍 진영리 1881", "진영리"),
        (text.region_code, "4825012345", "48250"),
        (text.padded_code, "123", "00123"),
    ],
)
def test_text_functions(spark, fn, value, expected):
    assert one(spark, fn(F.lit(value).cast("string"))) == expected


def test_rural_place_comes_from_the_legal_address(spark):
    address = F.lit("경상남도 김해시 진영읍 진영리 1881 동문굿모닝힐")
    assert one(spark, text.admin_dong(F.lit("진영리"), address)) == "진영읍진영리"
    assert one(spark, text.admin_dong(F.lit("우동"), F.lit(None).cast("string"))) == "우동"


@pytest.mark.parametrize(
    "name, main, sub, road, number",
    [
        ("수영로 261", "261", "0", "수영로", "261"),
        ("수영로 261-3", None, None, "수영로", "261-3"),
        ("영주로", "00051", "002", "영주로", "51-2"),
        (None, None, None, "", ""),
    ],
)
def test_contract_roads(spark, name, main, sub, road, number):
    columns = text.contract_road(*[F.lit(v).cast("string") for v in (name, main, sub)])
    assert [one(spark, c) for c in columns] == [road, number]


def test_keys_are_empty_when_a_part_is_missing(spark):
    assert one(spark, text.joined_key(F.lit("a"), F.lit("b"), F.lit("c"))) == "a|b|c"
    assert one(spark, text.joined_key(F.lit("a"), F.lit(""), F.lit("c"))) == ""
    assert one(spark, text.road_key_in_region(F.lit("26290"), F.lit("남구|수영로|261"))) == "26290|수영로|261"
    assert one(spark, text.road_key_in_region(F.lit("26290"), F.lit("수영로|261"))) == ""


def test_geocode_queries_keep_order(spark):
    got = one(spark, text.geocode_queries(F.lit("부산 중구 영주로 51 금호타운"), F.lit("부산 중구 영주동 161 금호")))
    assert got == ["부산 중구 영주로 51 금호타운", "부산 중구 영주로 51", "부산 중구 영주동 161 금호", "부산 중구 영주동 161"]


def test_formula_guard_and_links(spark):
    assert one(spark, text.guard_formula(F.lit("=1+1"))) == "'=1+1"
    assert one(spark, text.guard_formula(F.lit("x"))) == "x"
    assert one(spark, text.url_complex_ids(F.lit("https://a?complex=12&x complex=7"))) == ["12", "7"]


def test_numbers(spark):
    assert one(spark, numeric.amount_krw(F.lit("85,000"))) == 850_000_000
    assert one(spark, numeric.amount_krw(F.lit("-"))) is None
    assert one(spark, numeric.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, numeric.round_half_even(F.lit(2.5))) == 2
    ages = [numeric.age_anniversary(F.lit(d).cast("date"), F.lit("2026-09-12").cast("date")) for d in ("2000-09-12", "2000-09-13")]
    assert [one(spark, c) for c in ages] == [26, 25]
    null = F.lit(None).cast("double")
    assert one(spark, numeric.parking_total(null, F.lit(125.0), F.lit(500.0))) == 625
    assert one(spark, numeric.parking_total(null, null, null)) is None


def test_value_buckets_never_reverse_order(spark):
    rng = random.Random(7)
    values = sorted([rng.uniform(-1e9, 1e9) for _ in range(500)] + [rng.uniform(-2, 2) for _ in range(500)] + [float(2**k) for k in range(40)])
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").select("i", numeric.value_bucket(F.col("v")).alias("b"))
    buckets = [r.b for r in sorted(rows.collect())]
    assert buckets == sorted(buckets) and len(set(buckets)) > 300


def test_dates_and_months(spark):
    lit = lambda v: F.lit(v).cast("string")
    assert one(spark, months.date_from_parts(lit("2026"), lit("8"), lit("1"))) == dt.date(2026, 8, 1)
    assert one(spark, months.date_from_parts(lit("2026"), lit("2"), lit("30"))) is None
    assert one(spark, months.date_from_parts(lit("2026"), lit("2"), lit(None))) is None
    assert one(spark, months.months_between_labels(F.lit("202511"), F.lit("202602"))) == ["202511", "202512", "202601", "202602"]
    assert one(spark, months.label_to_index(F.lit("NaT"))) is None
    assert one(spark, months.index_to_label(months.label_to_index(F.lit("2026-12")))) == "2026-12"
    assert one(spark, months.is_provisional(months.label_to_index(F.lit("2026-08")), "2026-09-12")) is True
    assert one(spark, months.is_provisional(months.label_to_index(F.lit("2026-07")), "2026-09-12")) is False


@pytest.mark.parametrize("area, group, label", [(39.99, "under_40", "소형"), (79.99, "65_80", "74형"), (84.95, "80_90", "84형"), (90.0, "90_120", "중대형"), (120.0, "over_120", "대형"), (None, None, None)])
def test_area_bands_are_half_open(spark, area, group, label):
    c = F.lit(area).cast("double")
    assert one(spark, bands.area_group(c)) == group and one(spark, bands.area_label(c)) == label


@pytest.mark.parametrize("price, band", [(3.99, "4억 미만"), (4.0, "4~5억"), (11.99, "11~12억"), (12.0, "12억 이상"), (None, None)])
def test_price_bands(spark, price, band):
    assert one(spark, bands.price_band(F.lit(price).cast("double"))) == band


def test_cancel_codes(spark):
    for date, code, expected in (("24.01.02", None, True), (" ", "O", True), (None, "해제", True), ("", "N", False)):
        assert one(spark, bands.cancelled(F.lit(date).cast("string"), F.lit(code).cast("string"))) is expected


def plain_lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_similarity_against_the_plain_definition():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rng.choice("가나다ab1") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert similarity.lcs_length(a, b) == plain_lcs(a, b)
    assert similarity.similarity("센텀파크", "센텀파크") == 100
    assert similarity.similarity("abcd", "abxd") == 75
    assert similarity.similarity("", "") == 100 and similarity.similarity("", "a") == 0


def test_best_of_matches_a_full_comparison():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("가나다라ab1") for _ in range(rng.randint(0, 9)))
    lefts, rights = [word() for _ in range(60)], [word() for _ in range(80)]
    orders = [f"{i:03d}" for i in rng.sample(range(80), 80)]
    for left, (score, order) in zip(lefts, similarity.best_of(lefts, rights, orders)):
        want = min((-similarity.similarity(left, r), o) for r, o in zip(rights, orders))
        assert (score, order) == (-want[0], want[1])


def test_interval_nodes_meet_exactly_when_intervals_overlap(spark):
    rng = random.Random(11)
    top = 2**intervals.LEVELS - 1
    spans = [tuple(sorted(rng.sample(range(60), 2))) for _ in range(40)] + [(0, top), (5, 5), (9, 3), (17, top), (0, 0), (top, top)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "i long, a long, b long")
    covers, starts = {}, {}
    for r in intervals.cover(rows, "a", "b").collect():
        covers.setdefault(r.i, set()).add((r.level, r["at"]))
    for r in intervals.above(rows, "a").collect():
        starts.setdefault(r.i, set()).add((r.level, r["at"]))
    for i, (a, b) in enumerate(spans):
        mine = covers.get(i, set())
        if b < 60:
            assert sorted(x for level, at in mine for x in range(at << level, (at + 1) << level)) == list(range(a, b + 1))
        for j, (c, d) in enumerate(spans):
            if a <= b and c <= d:
                meet = bool(mine & starts[j]) or bool(covers[j] & starts[i])
                assert meet == (max(a, c) <= min(b, d)), (spans[i], spans[j])


def test_batched_lcs_matches_the_single_one():
    import random

    from dealgrain.functions import similarity

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("가나다ab1 ") for _ in range(n))
    left = [word(rng.choice((0, 1, 5, 20, 63, 64, 65, 90))) for _ in range(400)]
    right = [word(rng.choice((0, 1, 5, 20, 63, 64, 65, 90))) for _ in range(400)]
    assert similarity.lcs_lengths(left, right).tolist() == [similarity.lcs_length(a, b) for a, b in zip(left, right)]
    assert similarity.similarity("", "") == 100.0 and similarity.similarity("ab", "ab") == 100.0 and similarity.lcs_lengths([], []).tolist() == []


def test_only_plain_numbers_count(spark):
    given = ["10", " 1.5 ", "-2", "+3.", ".5", "1e3", "10d", "5f", "NaN", "Infinity", "0x1", "", None, "1,000"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string").select("i", numeric.number(F.col("v")).alias("n")).orderBy("i").collect()
    assert [r.n for r in rows] == [10.0, 1.5, -2.0, 3.0, 0.5, 1000.0] + [None] * 8
