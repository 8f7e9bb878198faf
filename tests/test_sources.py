from __future__ import annotations

import datetime as dt
import json

import pytest
from conftest import as_dicts
from pyspark.sql import functions as F

from dealgrain.operators import mapmetrics, schools
from dealgrain.operators.regions import region_dimension
from dealgrain.plans.adapters import REGIONS
from dealgrain.sources import payloads, readers, status, writers
from dealgrain.streaming import landing


def test_landing_replaces_only_its_partitions(make, spark, tmp_path):
    path = str(tmp_path / "landed")
    rows = lambda *r: make([dict(ym=m, lawd_cd=c, v=v) for m, c, v in r], "ym string, lawd_cd string, v int")
    writers.land(rows(("202601", "26110", 1), ("202601", "26140", 2)), path)
    writers.land(rows(("202601", "26110", 9)), path)
    assert {(r.lawd_cd, r.v) for r in spark.read.parquet(path).collect()} == {(26110, 9), (26140, 2)}
    landed = spark.read.schema("v int, ym string, lawd_cd string").parquet(path)
    targets = writers.collection_targets(region_dimension(spark, REGIONS, "busan"), "202601", "202602")
    counts = writers.collection_plan_counts(targets, landed).first()
    assert (counts.targets, counts.existing, counts.to_collect) == (32, 2, 30)
    assert writers.collection_plan(targets, landed).count() == 30
    assert writers.collection_plan(targets, landed, force=True).count() == 32


def test_an_attempt_without_rows_replaces_the_old_partition(make, spark, tmp_path):
    path = str(tmp_path / "landed")
    rows = lambda *r: make([dict(ym=m, lawd_cd=c, v=v) for m, c, v in r], "ym string, lawd_cd string, v int")
    targets = lambda *r: make([dict(ym=m, lawd_cd=c) for m, c in r], "ym string, lawd_cd string")
    writers.land(rows(("202601", "26110", 1), ("202601", "26140", 2)), path, attempted=targets(("202601", "26110"), ("202601", "26140")))
    writers.land(rows(), path, attempted=targets(("202601", "26110")))
    landed = spark.read.schema("v int, is_empty_landing boolean, ym string, lawd_cd string").parquet(path)
    assert {(r.lawd_cd, r.v) for r in writers.landed_rows(landed).collect()} == {("26140", 2)}
    assert writers.collection_plan(targets(("202601", "26110"), ("202601", "26140"), ("202602", "26110")), landed).count() == 1


def test_unreadable_files_are_told(make, spark, tmp_path):
    folder = tmp_path / "raw"
    make([dict(a=1)], "a int").coalesce(1).write.parquet(str(folder / "good"))
    (folder / "broken.parquet").write_bytes(b"no table")
    with pytest.raises(Exception):  # noqa: B017
        readers.read_landed(spark, str(folder), "a int").count()
    assert readers.read_landed(spark, str(folder), "a int", skip_unreadable=True).count() == 1
    assert [r.source_file.rsplit("/", 1)[1] for r in readers.skipped_files(spark, str(folder), "a int").collect()] == ["broken.parquet"]


def test_path_parts_and_columns(make, spark, tmp_path):
    folder = tmp_path / "raw" / "202608"
    make([dict(a=1)], "a int").coalesce(1).write.parquet(str(folder / "26110.parquet"))
    df = readers.read_landed(spark, str(tmp_path / "raw"))
    assert df.count() == 1 and "source_time" in df.columns
    paths = make([dict(p="file:/x/202608/26110.parquet"), dict(p="file:/x/other/7.snappy.parquet")], "p string")
    got = [(r.m, r.s) for r in paths.select(readers.path_month(F.col("p")).alias("m"), readers.path_stem(F.col("p")).alias("s")).collect()]
    assert got == [("202608", "26110"), (None, "7")]
    with pytest.raises(ValueError, match=r"\['b', 'c'\]"):
        readers.read_columns(spark, str(folder / "26110.parquet"), ["a", "b", "c"])


def test_pushed_filters_and_pruned_columns(spark, capsys):
    df = readers.read_columns(spark, "/root/testdata/sf0.001/lineitem.parquet", ["l_orderkey"], F.col("l_suppkey") == 7)
    df.explain()
    plan = capsys.readouterr().out
    assert "EqualTo(l_suppkey,7)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in plan


def test_recent_months_and_one_complex(make, spark, tmp_path):
    path = str(tmp_path / "panel")
    make([dict(internal_complex_id=i, year_month=f"2026-{m:02d}") for i in "AB" for m in range(1, 9)], "internal_complex_id string, year_month string").write.parquet(path)
    assert {r.year_month for r in readers.read_recent(spark, path, ["year_month"], 2).collect()} == {"2026-07", "2026-08"}
    assert readers.read_complex(spark, path, ["internal_complex_id", "year_month"], "A").count() == 8


def test_text_tables_find_columns_by_name(spark, tmp_path):
    path = tmp_path / "manual.csv"
    path.write_text("﻿region_code,extra,dong\n01234,x,\n", encoding="utf-8")
    assert as_dicts(readers.read_text_table(spark, str(path), ["dong", "region_code"])) == [{"dong": "", "region_code": "01234"}]
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_text_table(spark, str(path), ["kapt_code"])


def test_xml_and_json_payloads(make):
    good = "<response><header><resultCode>000</resultCode></header><body><items><item><aptNm>가</aptNm></item><item><aptNm>나</aptNm></item></items><totalCount>2</totalCount></body></response>"
    bad = "<response><header><resultCode>99</resultCode><resultMsg>NO KEY</resultMsg></header></response>"
    empty = "<response><header><resultCode>000</resultCode></header><body><items/><totalCount>0</totalCount></body></response>"
    df = make([dict(f="1", payload=good), dict(f="2", payload=empty)], "f string, payload string")
    rows = as_dicts(payloads.parse_xml(df, "aptNm:string"), "f", "aptNm")
    assert [(r["f"], r["aptNm"], r["total_count"]) for r in rows] == [("1", "가", 2), ("1", "나", 2)]
    with pytest.raises(Exception, match="NO KEY"):
        payloads.parse_xml(make([dict(payload=bad)], "payload string"), "aptNm:string").collect()
    assert payloads.parse_xml(make([dict(payload=bad)], "payload string"), "aptNm:string", strict=False).count() == 0
    uncoded = "<response><body><items><item><aptNm>다</aptNm></item></items><totalCount>1</totalCount></body></response>"
    assert payloads.parse_xml(make([dict(payload=uncoded)], "payload string"), "aptNm:string").count() == 1
    with pytest.raises(Exception, match="answered 0"):
        payloads.parse_xml(make([dict(payload=good.replace("000", "0"))], "payload string"), "aptNm:string").collect()
    refused = json.dumps({"response": {"header": {"resultCode": "22", "resultMsg": "LIMIT"}, "body": {"items": ""}}})
    with pytest.raises(Exception, match="LIMIT"):
        payloads.parse_json(make([dict(payload=refused)], "payload string"), "kaptCode string").collect()
    assert payloads.parse_json(make([dict(payload=refused)], "payload string"), "kaptCode string", strict=False).count() == 0
    part = json.dumps({"body": {"items": {"kaptCode": None, "kaptName": "나"}}})
    none = json.dumps({"body": {"items": [], "totalCount": 0}})
    rows = payloads.parse_json(make([dict(payload=part), dict(payload=none)], "payload string"), "kaptCode string, kaptName string").collect()
    assert [(r.kaptName, r.total_count) for r in rows] == [("나", 1)]
    item = {"kaptCode": "A", "kaptName": "가"}
    wraps = [{"items": [item]}, {"items": {"item": [item]}}, {"items": item}, {"item": item}, {"item": [item]}]
    df = make([dict(payload=json.dumps({"response": {"body": w}})) for w in wraps], "payload string")
    assert [(r.kaptCode, r.kaptName) for r in payloads.parse_json(df, "kaptCode string, kaptName string").collect()] == [("A", "가")] * 5


ATTEMPT = "transaction_type string, year_month string, lawd_cd string, attempted_at string, status string, raw_count long, batch_id string, error string"


def attempt(at, state, count=None, batch="b"):
    return dict(transaction_type="trade", year_month="202608", lawd_cd="26110", attempted_at=at, status=state, raw_count=count, batch_id=batch, error=None if state == "success" else "x")


def test_failure_keeps_the_earlier_success(make):
    rows = make([attempt("2026-08-01", "success", 5, "b1"), attempt("2026-08-02", "failed", None, "b2")], ATTEMPT)
    row = as_dicts(status.latest_status(rows))[0]
    assert (row["status"], row["last_attempt_status"], row["raw_count"], row["batch_id"], row["last_attempt_batch_id"], row["successful_at"]) == ("success", "failed", 5, "b1", "b2", "2026-08-01")
    later = status.upsert_status(status.latest_status(rows), make([attempt("2026-08-03", "failed", None, "b3")], ATTEMPT))
    assert (as_dicts(later)[0]["status"], as_dicts(later)[0]["raw_count"], as_dicts(later)[0]["last_attempt_batch_id"]) == ("success", 5, "b3")


def test_a_month_without_rows_is_the_latest(make, spark):
    recorded = status.latest_status(make([attempt("2026-08-01", "success", 0)], ATTEMPT))
    landed = make([dict(transaction_type="trade", year_month="202608", lawd_cd="26110", row_count=0)], "transaction_type string, year_month string, lawd_cd string, row_count long")
    records = status.backfill_status(recorded, landed, region_dimension(spark, REGIONS))
    panel = make([dict(year_month="2026-07", transaction_count=3)], "year_month string, transaction_count long")
    row = status.status_summary(records, panel, 18, ["transaction_count"]).first()
    assert (row.period_start, row.period_end, row.reflected_count, row.successful_regions, row.collection_status) == ("2026-07", "2026-08", 0, 1, "partial")


def test_rebuild_window_and_versions(make, spark):
    previous = make([dict(year_month="2026-08")], "year_month string")
    files = lambda t: make([dict(source_file="f/202605/26110.parquet", source_time=t)], "source_file string, source_time timestamp")
    built, old, new = F.lit("2026-08-10").cast("timestamp"), dt.datetime(2026, 8, 1), dt.datetime(2026, 8, 20)
    row = lambda landed, master: status.rebuild_window(previous, built, files(landed), files(master)).first()
    assert row(old, old).rebuild_from == "2026-07" and row(new, old).full_rebuild_reason and row(old, new).rebuild_from is None
    facts = make([dict(file_name="a", file_size=1, file_time=old), dict(file_name="b", file_size=2, file_time=old)], "file_name string, file_size long, file_time timestamp")
    version = lambda df: status.data_version(df).first()[0]
    assert version(facts) == version(facts.orderBy(F.desc("file_name"))) and len(version(facts)) == 16
    assert version(facts) != version(facts.withColumn("file_size", F.col("file_size") + 1))


def test_streams_read_every_file_once(make, spark, tmp_path):
    inbox, target, mark = (str(tmp_path / n) for n in ("inbox", "landed", "mark"))
    schema = "ym string, lawd_cd string, v int"
    make([dict(ym="202601", lawd_cd="26110", v=1)], schema).write.mode("append").parquet(inbox)
    landing.land_new_files(spark, inbox, schema, target, mark)
    make([dict(ym="202602", lawd_cd="26110", v=2)], schema).write.mode("append").parquet(inbox)
    landing.land_new_files(spark, inbox, schema, target, mark)
    assert sorted(r.v for r in spark.read.parquet(target).collect()) == [1, 2]
    log, table, seen = (str(tmp_path / n) for n in ("log", "status", "seen"))
    make([attempt("2026-08-01", "success", 5, "b1")], ATTEMPT).write.mode("append").json(log)
    landing.apply_attempts(spark, log, ATTEMPT, table, seen)
    make([attempt("2026-08-02", "failed", None, "b2")], ATTEMPT).write.mode("append").json(log)
    landing.apply_attempts(spark, log, ATTEMPT, table, seen)
    row = as_dicts(landing.current_status(spark, table))[0]
    assert (row["status"], row["raw_count"], row["last_attempt_status"]) == ("success", 5, "failed")


def test_overview_keeps_missing_sources_apart_from_zero(make):
    ids = make([dict(internal_complex_id="A"), dict(internal_complex_id="B")], "internal_complex_id string")
    day = lambda *d: dt.date(*d)
    trades = make([dict(internal_complex_id="A", deal_date=day(2026, 8, 31), deal_amount_krw=5.0, is_cancelled=False), dict(internal_complex_id="A", deal_date=day(2025, 8, 31), deal_amount_krw=7.0, is_cancelled=False),
                   dict(internal_complex_id="A", deal_date=day(2025, 9, 1), deal_amount_krw=1.0, is_cancelled=None), dict(internal_complex_id="B", deal_date=day(2026, 9, 30), deal_amount_krw=1.0, is_cancelled=True)],
                  "internal_complex_id string, deal_date date, deal_amount_krw double, is_cancelled boolean")
    caps = make([dict(kapt_code="A", market_cap_krw=10.0, adjusted_market_cap_krw=12.0), dict(kapt_code="B", market_cap_krw=3.0)], "kapt_code string, market_cap_krw double, adjusted_market_cap_krw double")
    rows = as_dicts(mapmetrics.overview_metrics(ids, trades, caps), "internal_complex_id")
    assert [(r["market_cap_krw"], r["transaction_count_12m"], r["transaction_value_12m"], r["school_value_gap_pct"]) for r in rows] == [(12.0, 2, 6.0, None), (3.0, 0, 0.0, None)]
    assert {r["transaction_count_12m"] for r in as_dicts(mapmetrics.overview_metrics(ids, None, None))} == {None}


def test_weighted_price_and_markers(make):
    panel = make([dict(internal_complex_id="A", mean_price=2e8, transaction_count=2.0), dict(internal_complex_id="A", mean_price=5e8, transaction_count=1.0), dict(internal_complex_id="A", mean_price=None, transaction_count=9.0)], "internal_complex_id string, mean_price double, transaction_count double")
    ids = make([dict(internal_complex_id="A"), dict(internal_complex_id="B")], "internal_complex_id string")
    rows = as_dicts(mapmetrics.with_price_band(mapmetrics.weighted_prices(ids, panel)), "internal_complex_id")
    assert (rows[0]["map_average_price_krw"], rows[0]["map_transaction_count"], rows[0]["price_band"]) == (3e8, 3, "4억 미만") and rows[1]["map_transaction_count"] == 0
    values = make([dict(v=v) for v in (None, -1.0, 0.0, 25.0, 100.0)], "v double")
    assert [r.marker_size for r in mapmetrics.scale_markers(values, "v").collect()] == [5.0, 5.0, 5.0, 15.5, 26.0]
    assert {r.marker_size for r in mapmetrics.scale_markers(make([dict(v=3.0)] * 2, "v double"), "v").collect()} == {5.0}
    with pytest.raises(ValueError):
        mapmetrics.scale_markers(values, "v", method="cube")
    assert [r.gap_ratio for r in mapmetrics.centred_ratio(values, "v").collect()][1:] == [-0.01, 0.0, 0.25, 1.0]


def test_school_limits_and_districts(make):
    data = make([dict(school_id=i, school_level="초", sigungu=s, score=v, closed="N", suspended=x) for i, s, v, x in (("A", "동구", 80.0, "N"), ("B", "동구", 70.0, None), ("C", "서구", 90.0, None), ("D", "서구", 99.0, "Y"), ("E", "동구", None, None))],
                "school_id string, school_level string, sigungu string, score double, closed string, suspended string")
    ids = lambda *a, **k: [r.school_id for r in schools.top_schools(data, "초", 2, *a, **k).orderBy("selection_rank").collect()]
    assert ids() == ["C", "A"] and ids(districts="동구") == ["A"] and ids(schools.SELECTED, ["동구"]) == ["A", "B"]
