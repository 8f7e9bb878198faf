"""Window prices of all months against plain windows, for several estimators, buckets and crowded keys."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date
from statistics import mean, median

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dealgrain.functions import months
from dealgrain.operators import prices
from dealgrain.session import local_table

SCHEMA = "kapt_code string, area_sqm double, deal_amount_krw double, deal_date date"


def trimmed(values, share=0.1):
    values = sorted(values)
    cut = int(len(values) * share)
    return mean(values[cut : len(values) - cut])


def brute(rows, first, last, minimum, price):
    known = defaultdict(list)
    for code, area, amount, day in rows:
        if day is not None:
            known[code, area].append((day.year * 12 + day.month - 1, amount))
    out = {}
    for (code, area), own in known.items():
        for vm in range(first, last + 1):
            inside = lambda n: [p for m, p in own if vm - n < m <= vm]  # noqa: B023, E731
            window = next((n for n in (3, 6, 12) if len(inside(n)) >= minimum), 12)
            if inside(12):
                told = [p for p in inside(window) if p is not None and p == p]
                one = [p for p in inside(1) if p is not None and p == p]
                out[code, area, vm] = (window, len(inside(window)), len(inside(1)), price(told) if told else None, price(one) if one else None)
    return out


def contracts(seed):
    """Sparse and crowded keys; equal, close (one bucket) and far prices; unknown prices and dates."""
    rng = random.Random(seed)
    rows = []
    for _ in range(900):
        code, area = rng.choice(("1", "2", "3", "hot", "hot", "hot")), rng.choice((59.0, 84.0))
        base = 5e8 if code == "hot" else rng.choice((1e8, 3e8, 9e8))
        amount = rng.choice((base, base + rng.randint(0, 200_000), base + 10_000 * rng.randint(0, 90), None, float("nan")) if rng.random() < 0.5 else (base + rng.randint(0, 90_000),))
        day = None if rng.random() < 0.02 else date(2022 + rng.randint(0, 2), rng.randint(1, 12), rng.randint(1, 28))
        rows.append((code, area, amount, day))
    return rows + [("lone", 59.0, 1e8, date(2022, 5, 1)), ("lone", 59.0, None, date(2023, 2, 1))]


def found(df):
    vm = months.label_to_index(F.col("month"))
    rows = df.withColumn("vm", vm).collect()
    return {(r.kapt_code, r.area_sqm, r.vm): (r.window_months, r.transaction_count, r.count_1m, r.price_krw, r.price_1m_krw) for r in rows}


def close(a, b):
    return a.keys() == b.keys() and all(x[:3] == y[:3] and all((p is None) == (q is None) and (p is None or abs(p - q) < 1e-3) for p, q in zip(x[3:], y[3:])) for x, y in ((a[k], b[k]) for k in a))


@pytest.mark.parametrize("seed", [1, 2])
def test_all_months_equal_plain_windows(spark, seed):
    rows = contracts(seed)
    df = local_table(spark, rows, SCHEMA)
    first, last = 2022 * 12, 2024 * 12 + 11
    told = prices.window_prices(df, prices.every_month(df, "deal_date"), 3, [prices.MEDIAN, prices.trimmed_mean(0.1)])
    for source, price in (("transaction_median", median), ("transaction_trimmed_mean", trimmed)):
        assert close(found(told.where(F.col("price_source") == source)), brute(rows, first, last, 3, price))


def test_chosen_months_only(spark):
    rows = contracts(3)
    told = found(prices.window_prices(local_table(spark, rows, SCHEMA), ["2023-02", "2024-12"], 2))
    want = {k: v for k, v in brute(rows, 2022 * 12, 2024 * 12 + 11, 2, median).items() if k[2] in (2023 * 12 + 1, 2024 * 12 + 11)}
    assert close(told, want)


def test_no_contracts(spark):
    assert prices.window_prices(local_table(spark, [], SCHEMA), ["2023-02"]).count() == 0


def test_months_are_unfolded_inside_tasks(spark, monkeypatch):
    """Neither the shuffles nor the sort of the stored step see a row per valuation month."""
    stored = []
    monkeypatch.setattr(prices, "materialise", lambda df, label: (stored.append(df), df)[1])
    prices.window_prices(local_table(spark, contracts(4), SCHEMA), ["2023-02"])
    plan = stored[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate explode" not in plan


def test_no_key_is_cut(monkeypatch):
    monkeypatch.setattr(prices, "UNFOLDED", 10)
    keys = [(c, a) for c in (None, "1", "2") for a in (None, 59.0, float("nan")) for _ in range(17 if c == "1" else 3)]
    table = pa.table({"c": pa.array([k[0] for k in keys]), "a": pa.array([k[1] for k in keys], from_pandas=False)})
    parts = [list(zip(*t.to_pydict().values())) for t in prices._whole_keys(table.to_batches(max_chunksize=4))]
    assert [str(k) for p in parts for k in p] == [str(k) for k in keys] and len(parts) > 3
    assert all(str(p[-1]) != str(q[0]) for p, q in zip(parts, parts[1:]))
