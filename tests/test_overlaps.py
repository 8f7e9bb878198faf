from __future__ import annotations

import datetime as dt

from dealgrain.plans.valuations import overlapping_validity


def test_numbers_of_overlapping_rows_beyond_64_bits(make, tmp_path):
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    for order, kind in ((60_000_000, "decimal(38,0)"), (6, "bigint")):
        rows = [dict(l_orderkey=order + i, l_partkey=7, l_suppkey=3, l_linenumber=2, l_quantity=5.0, l_extendedprice=1.0, l_shipdate=dt.datetime(2000, 1, 1 + 2 * i)) for i in range(2)]
        make(rows, columns).write.parquet(f"{tmp_path}/{order}/lineitem.parquet")
        out = overlapping_validity(make([], columns).sparkSession, f"{tmp_path}/{order}")
        assert dict(out.dtypes)["row"] == kind
        assert [(int(r.row), r.kapt_code) for r in out.collect()] == [((((order + 1) * 100_000 + 3) * 100_000 + 7) * 100 + 21, "3")]
