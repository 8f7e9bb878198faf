from __future__ import annotations

import datetime as dt
import json
from collections import Counter

from conftest import as_dicts
from pyspark.sql import functions as F

from dealgrain.operators import scale, traces, valuation

TRADE = "kapt_code string, area_sqm double, deal_date date, deal_amount_krw double, source_row_id string"
D = dt.date


def test_used_contracts_of_crowded_complexes_and_others_are_the_same(make, monkeypatch):
    columns = "month string, kapt_code string, exclusive_area_sqm double, transaction_count long, window_months int, period_start date, period_end date"
    detail = make([dict(month=f"2026-0{m}", kapt_code=k, exclusive_area_sqm=84.0, transaction_count=9, window_months=3, period_start=D(2026, m - 2, 1), period_end=D(2026, m, 28))
                   for m in (3, 4, 5) for k in ("K1", "K2")], columns)
    trades = make([dict(kapt_code=k, area_sqm=a, deal_date=D(2026, 1 + i % 5, 1 + i), deal_amount_krw=1e8 * (9 if i == 4 else 1), source_row_id=f"{k}{i}")
                   for k in ("K1", "K2", "K3", None) for a in (84.0, 59.0, None) for i in range(12)], TRADE)
    used = valuation.used_contracts(detail, trades)
    few = Counter(tuple(r.values()) for r in as_dicts(used.select("month", "kapt_code", "source_row_id", "unusual_price")))
    plan = used.groupBy("month", "kapt_code").count()._jdf.queryExecution().optimizedPlan().toString()
    assert len(few) == 42 and sum(r[3] for r in few) == 2 and "percentile" not in plan
    monkeypatch.setattr(scale, "FEW_ROWS", 1)
    crowded = valuation.used_contracts(detail, trades)
    assert Counter(tuple(r.values()) for r in as_dicts(crowded.select("month", "kapt_code", "source_row_id", "unusual_price"))) == few


def test_only_crowded_lists_are_dealt_by_part(make):
    rows = [dict(k="a", e=f"{i:05d}") for i in range(2500)] + [dict(k=k, e=e) for k in ("b", None) for e in ("y", "x", "x", None)]
    df = make(rows, "k string, e string")
    found = as_dicts(traces.traces(df, ["k"], F.col("e")))
    small = {r["k"]: (r["entries"], r["entry_count"], r["parts"], r["part"]) for r in found if r["k"] != "a"}
    assert small == {k: ('["","x","x","y"]', 4, 1, 0) for k in ("b", None)}
    parts = [json.loads(r["entries"]) for r in found if r["k"] == "a"]
    assert len(parts) == 3 and sorted(sum(parts, [])) == [f"{i:05d}" for i in range(2500)] and all(p == sorted(p) for p in parts)
    plan = traces.traces(df.where("k = 'b'"), ["k"], F.col("e"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
