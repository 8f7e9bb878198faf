"""Household-weighted market values from contract medians, and their rank history."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals, months, numeric
from ..functions.text import blank_if_null
from ..session import materialise
from .prices import CODE, MEDIAN, WINDOWS, PriceProvider, month_indexes, price_facts, told_facts, window_prices
from .scale import Quantile, group_quantiles, join_keys, known_quantiles, rows_by_size, with_group, with_rank
from .traces import composition_entry, method_entry, multiset_digest

# Grades, statuses and reasons of an incomplete value.
GRADES = {3: "A", 6: "B", 12: "C"}
SMALL_SAMPLE_GRADE, INCOMPLETE = "D", "산정 불완전"
NEAREST_METHOD = "nearest_exclusive_area_unit_price"
OVERLAP_REASON = "기간 중복 평형/동일 전용면적: A/B타입은 세대수를 합친 한 행 필요"
SALE_SCOPE, SCOPES, STATES = "sale_apartment", ["sale_apartment", "rental_apartment", "unknown"], ["verified", "pending"]
SALE_TYPE, BUILDINGS = "분양", ["아파트", "주상복합"]
NOT_COMPARABLE, NEW, OTHER_RULES, COMPARABLE = "비교 불가", "신규", "규칙 변경: 비교 불가", "비교 가능"
AREA_TOLERANCE = 0.01 + 1e-12


def month_rows(df: DataFrame, labels: Iterable[str] | Column) -> DataFrame:
    """Repeat rows for every valuation month (labels, or an array of month indexes), with its index."""
    return df.withColumn("_vm", F.explode(month_indexes(labels))).withColumn("month", months.index_to_label(F.col("_vm")))


def active_months(master: DataFrame, labels: Iterable[str] | Column) -> DataFrame:
    """Register rows once per valuation month at whose end they are valid, with the month's index."""
    after_start = F.coalesce(F.col("valid_from") <= months.index_month_end(F.col("_vm")), F.lit(True))
    before_end = F.coalesce(F.col("valid_to") >= months.index_month_end(F.col("_vm")), F.lit(True))
    known = master.withColumn("_all", month_indexes(labels))
    first = F.coalesce(months.month_index(F.col("valid_from")), F.array_min("_all"))
    last = F.coalesce(months.month_index(F.col("valid_to")), F.array_max("_all"))
    within = F.filter("_all", lambda m: (m >= F.col("_first")) & (m <= F.col("_last")))
    rows = known.withColumns({"_first": first, "_last": last}).withColumn("_vm", F.explode(within)).where(after_start & before_end)
    return rows.withColumn("month", months.index_to_label(F.col("_vm"))).drop("_all", "_first", "_last")


def active_spans(master: DataFrame, labels: Iterable[str] | Column) -> DataFrame:
    """Register rows once per span of months over which the valid rows of their complex stay the same.

    ``_months`` lists the span's month indexes. Together the spans hold what ``active_months`` holds (each month asked for once);
    at worst there is a span per month. A null complex is one of its own.
    """
    every = month_indexes(labels)
    ended = months.month_index(F.col("valid_to")) - (F.col("valid_to") < F.last_day("valid_to")).cast("int")
    first, last = F.greatest(months.month_index(F.col("valid_from")), F.array_min(every)), F.least(ended, F.array_max(every))
    rows = master.withColumns({"_first": first, "_last": last}).where("_first <= _last")
    # A complex has at most one change per month, and the array holds each of them once.
    changes = rows.select(CODE, F.explode(F.array("_first", F.col("_last") + 1)).alias("_at")).groupBy(CODE).agg(F.array_sort(F.collect_set("_at")).alias("_at"))
    span = F.transform("_at", lambda x, i: F.struct(x.alias("start"), F.try_element_at("_at", (i + 2).cast("int")).alias("next")))
    within = F.transform(span, lambda s: F.struct(s["start"].alias("start"), F.array_distinct(F.filter("_all", lambda m: (m >= s["start"]) & (m < s["next"]))).alias("months")))
    spans = changes.withColumn("_all", every).select(CODE, F.filter(within, lambda s: F.size(s["months"]) > 0).alias("_spans"))
    own = F.filter("_spans", lambda s: (s["start"] >= F.col("_first")) & (s["start"] <= F.col("_last")))
    return join_keys(rows, spans, [CODE], "inner").withColumn("_months", F.explode(F.transform(own, lambda s: s["months"]))).drop("_first", "_last", "_spans")


def active_at(master: DataFrame, month: Column) -> DataFrame:
    """Rows valid at the end of a month; a missing bound is open."""
    end = months.index_month_end(months.label_to_index(month))
    start, finish = F.col("valid_from"), F.col("valid_to")
    return master.where((start.isNull() | (start <= end)) & (finish.isNull() | (finish >= end)))


def eligible_contracts(contracts: DataFrame) -> DataFrame:
    """Matched, dated, uncancelled contracts with a positive area and amount."""
    ok = ~F.coalesce(F.col("is_cancelled"), F.lit(False)) & F.col("deal_date").isNotNull() & F.col(CODE).isNotNull()
    return contracts.where(ok & (F.col("area_sqm") > 0) & (F.col("deal_amount_krw") > 0))


def flag_equal_terms(contracts: DataFrame, keys: list[str]) -> DataFrame:
    """Mark contracts that share all terms with another one; both stay."""
    counted = with_group(contracts, keys, F.count(F.lit(1)).alias("_n"))
    return counted.withColumn("same_terms_multiple", F.col("_n") > 1).drop("_n")


def load_audit(contracts: DataFrame, eligible: DataFrame) -> DataFrame:
    """Counts of raw, cancelled, unmapped, eligible and equal-term contracts with period and months."""
    base = contracts.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if("is_cancelled").alias("cancelled_rows"),
        F.count_if(F.col(CODE).isNull()).alias("unverified_mapping_rows"),
        F.min("deal_date").alias("period_start"),
        F.max("deal_date").alias("period_end"),
        F.array_sort(F.collect_set(F.date_format("deal_date", "yyyy-MM"))).alias("raw_months"),
    )
    rows = eligible.agg(F.count(F.lit(1)).alias("n")).scalar()
    equal = eligible.agg(F.count_if("same_terms_multiple").alias("n")).scalar()
    return base.withColumns({"eligible_rows": rows, "same_terms_rows_preserved": equal})


def snap_areas(contracts: DataFrame, master: DataFrame) -> DataFrame:
    """Move a contract area to the register area it clearly means.

    A single register area within 0.01 wins; of several, the one equal to the area cut to two
    decimals. Only distinct (complex, area) pairs take part in the band join, which is an
    equality on complex and a whole-number area cell.
    """
    pairs = contracts.select(CODE, "area_sqm").where(F.col("area_sqm").isNotNull() & F.col(CODE).isNotNull()).distinct()
    areas = master.select(CODE, F.col("exclusive_area_sqm").alias("_area")).where(F.col("_area").isNotNull()).distinct()
    cell = lambda c: F.floor(F.col(c)).cast("long")
    offered = areas.withColumn("_cell", F.explode(F.array(cell("_area") - 1, cell("_area"), cell("_area") + 1)))
    near = pairs.withColumn("_cell", cell("area_sqm")).join(offered, [CODE, "_cell"])
    near = near.where(F.abs(F.col("_area") - F.col("area_sqm")) <= AREA_TOLERANCE)
    cut = F.floor(F.col("area_sqm") * 100) / 100
    equal = F.abs(F.col("_area") - cut) <= 1e-9
    found = near.groupBy(CODE, "area_sqm").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_area").alias("_only"),
        F.count_if(equal).alias("_equal"), F.min(F.when(equal, F.col("_area"))).alias("_cut"),
    )
    target = F.when(F.col("_n") == 1, F.col("_only")).when(F.col("_equal") == 1, F.col("_cut"))
    mapping = found.select(CODE, "area_sqm", target.alias("_target")).where(F.col("_target").isNotNull())
    # One row per pair on the small side; crowded pairs are split by adaptive execution.
    out = join_keys(contracts, mapping, [CODE, "area_sqm"])
    return out.withColumn("area_sqm", F.coalesce("_target", "area_sqm")).drop("_target")


def observed_areas(contracts: DataFrame) -> DataFrame:
    """Contracts with first and last date per complex and area."""
    return contracts.groupBy(CODE, "area_sqm").agg(
        F.count(F.lit(1)).alias("transaction_count"), F.min("deal_date").alias("first_deal"), F.max("deal_date").alias("last_deal")
    )


def median_prices(contracts: DataFrame, labels: Iterable[str] | Column, minimum: int = 3) -> DataFrame:
    """Pooled median price per valuation month, complex and area from the first sufficient window."""
    return window_prices(contracts, labels, minimum)


def window_statistics(contracts: DataFrame, labels: list[str]) -> DataFrame:
    """Counts, exact medians and latest dates of every window per valuation month, complex and area.

    Contracts outside the twelve months of every requested month are dropped at the scan. A
    contract is repeated only for the requested months it can influence, then one aggregation
    yields the medians and counts of all windows.
    """
    asked = F.array(*[months.label_to_index(F.lit(m)) for m in labels])
    dated = contracts.withColumn("_m", months.month_index(F.col("deal_date")))
    dated = dated.where((F.col("_m") <= F.array_max(asked)) & (F.col("_m") >= F.array_min(asked) - 11))
    reach = F.filter(asked, lambda v: (v >= F.col("_m")) & (v <= F.col("_m") + 11))
    rows = dated.withColumn("_vm", F.explode(reach)).withColumn("_age", F.col("_vm") - F.col("_m"))
    price = F.col("deal_amount_krw")
    keys = ["_vm", CODE, "area_sqm"]
    medians = {f"_p{n}": Quantile(F.when(F.col("_age") < n, price)) for n in (1, *WINDOWS)}
    counts = {f"_n{n}": F.count_if(F.col("_age") < n) for n in (1, *WINDOWS)}
    latest = {f"_d{n}": F.max(F.when(F.col("_age") < n, F.col("deal_date"))) for n in WINDOWS}
    return group_quantiles(rows.select(*keys, "_age", "deal_date", "deal_amount_krw"), keys, medians, {**counts, **latest})


def choose_window(stats: DataFrame, minimum: int = 3) -> DataFrame:
    """The price of the first window with enough contracts, else the twelve-month small sample."""

    def chosen(prefix: str) -> Column:
        return (
            F.when(F.col("_n3") >= minimum, F.col(f"{prefix}3"))
            .when(F.col("_n6") >= minimum, F.col(f"{prefix}6"))
            .otherwise(F.col(f"{prefix}12"))
        )

    window = F.when(F.col("_n3") >= minimum, 3).when(F.col("_n6") >= minimum, 6).when(F.col("_n12") > 0, 12)
    small = (F.col("_n12") > 0) & (F.col("_n12") < minimum)
    out = stats.withColumns(
        {
            "month": months.index_to_label(F.col("_vm")),
            "price_krw": chosen("_p"),
            "window_months": window,
            "transaction_count": chosen("_n"),
            "latest_deal_date": chosen("_d"),
            "small_sample": small,
            "price_1m_krw": F.col("_p1"),
            "count_1m": F.col("_n1"),
            "small_sample_1m": F.col("_n1") < minimum,
        }
    )
    return out.withColumns(
        {
            "period_start": months.index_month_start(F.col("_vm") - (F.coalesce("window_months", F.lit(12)) - 1)),
            "period_end": months.index_month_end(F.col("_vm")),
            "old_transactions": F.coalesce(F.col("window_months") > 3, F.lit(False)),
            "method": F.when(F.col("_n12") == 0, "unavailable")
            .when(F.col("small_sample"), "small_sample")
            .otherwise(F.concat(F.lit("median_"), F.col("window_months"), F.lit("m"))),
        }
    ).drop("_vm", *[f"_p{n}" for n in (1, *WINDOWS)], *[f"_n{n}" for n in (1, *WINDOWS)], *[f"_d{n}" for n in WINDOWS])


def overlapping_rows(master: DataFrame, row: str = "row") -> DataFrame:
    """Register rows that overlap an earlier row of the same complex with equal group or equal area.

    Each offending row is reported once. Validity intervals become dyadic nodes, so a row looks
    up the earliest row per node instead of meeting every other row of its complex.
    """
    base = master.select(
        CODE,
        F.col(row).alias("row"),
        intervals.day_number(F.col("valid_from"), 0).alias("_from"),
        intervals.day_number(F.col("valid_to"), intervals.LAST_DAY).alias("_to"),
        F.explode(
            F.array(
                F.struct(F.lit("group").alias("by"), F.col("area_group_id").cast("string").alias("value")),
                F.struct(F.lit("area").alias("by"), F.col("exclusive_area_sqm").cast("string").alias("value")),
            )
        ).alias("_s"),
    )
    rows = base.select(CODE, "row", "_from", "_to", "_s.*").where(F.col("value").isNotNull() & (F.col("_from") <= F.col("_to")))
    # A row alone under its key overlaps nothing and needs no nodes; no day needs nodes larger than the longest interval of its key.
    key = [CODE, "by", "value"]
    top = F.max(intervals.top_level(F.col("_from"), F.col("_to"))).alias("_top")
    rows = with_group(rows, key, F.count(F.lit(1)).alias("_n"), top).where(F.col("_n") > 1).drop("_n")
    node = [*key, "level", "at"]
    covers = intervals.cover(rows, "_from", "_to").select("row", *node)
    starts = intervals.above(rows, "_from", F.col("_top")).select("row", *node)
    earliest = lambda df: df.groupBy(*node).agg(F.min("row").alias("_first"))
    hits = starts.join(earliest(covers), node).unionByName(covers.join(earliest(starts), node))
    found = hits.where(F.col("_first") < F.col("row")).select("row", CODE).distinct()
    return found.withColumn("reason", F.lit(OVERLAP_REASON))


def master_issues(master: DataFrame, complexes: DataFrame, row: str = "row") -> DataFrame:
    """Every rule a register row breaks, as rows of row, complex and reason, plus overlaps."""
    known = complexes.select(CODE).distinct().withColumn("_known", F.lit(True))
    rows = master.join(known, CODE, "left")
    area, households = F.col("exclusive_area_sqm"), F.col("households")
    source = F.trim(blank_if_null(F.col("source")))
    rules = [
        (F.col("_known").isNull(), "알 수 없는 kapt_code"),
        (F.trim(blank_if_null(F.col("area_group_id"))) == "", "면적그룹 식별자 누락"),
        (area.isNull() | F.isnan(area) | (area <= 0), "전용면적 오류"),
        (households.isNull() | (households <= 0) | (households % 1 != 0), "세대수는 양의 정수 필요"),
        (F.col("supply_area_sqm") < area, "공급면적이 전용면적보다 작음"),
        (~F.coalesce(F.col("verification_status").isin(STATES), F.lit(False)), "검증 상태는 verified/pending"),
        (~F.coalesce(F.col("scope").isin(SCOPES), F.lit(False)), "주거·분양 범위 확인 필요"),
        ((F.col("verification_status") == "verified") & ((source == "") | F.col("verified_at").isNull()), "검증된 행의 출처·확인일 필요"),
        (F.col("valid_from") > F.col("valid_to"), "적용 시작·종료 역전"),
    ]
    rules += [(F.col(f"{c}_invalid"), f"{c} 날짜 오류") for c in ("valid_from", "valid_to") if f"{c}_invalid" in master.columns]
    found = F.array_compact(F.array(*[F.when(test, F.lit(reason)) for test, reason in rules]))
    single = rows.select(F.col(row).alias("row"), CODE, F.explode(found).alias("reason"))
    return single.unionByName(overlapping_rows(master, row))


def area_register_from_text(raw: DataFrame) -> DataFrame:
    """Typed area-register rows from text columns; unreadable dates are flagged."""
    from .clean import parse_date

    dates = ("verified_at", "valid_from", "valid_to")
    out = raw
    for c in dates:
        written = F.trim(blank_if_null(F.col(c))) != ""
        out = out.withColumn(f"{c}_invalid", written & parse_date(F.col(c)).isNull()).withColumn(c, parse_date(F.col(c)))
    return out.withColumns({c: numeric.number(F.col(c)) for c in ("exclusive_area_sqm", "supply_area_sqm", "households")})


def estimate(
    complexes: DataFrame,
    master: DataFrame,
    contracts: DataFrame,
    labels: Iterable[str] | Column,
    minimum: int = 3,
    approved: Iterable[str] | Column = (),
    extrapolation_coverage: float = 1.0,
    prices: DataFrame | None = None,
    issues: DataFrame | None = None,
    provider: PriceProvider = MEDIAN,
    stored: Iterable[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Values of all complexes for the given months (labels, or an array of month indexes): (complex totals, area details).

    All months and complexes are valued in one job. ``approved`` complexes may value unpriced
    types at the unit price of the nearest priced area once the priced share is high enough.
    Register rows and prices are dealt once, by complex, before months unfold, and stay there. Nothing is stored of the
    details: a caller that reads both results stores what it needs of them by ``stored``, a list of columns to keep.
    """
    if prices is None:
        facts, told = price_facts(contracts, labels, minimum, [provider]), told_facts(provider, minimum)
    else:
        asked = prices.withColumns({"_vm": months.label_to_index(F.col("month")).cast("long"), "_asked": month_indexes(labels)})
        facts = asked.where(F.array_contains("_asked", F.col("_vm").cast("int"))).drop("month", "_asked")
        told = {c: F.col(c) for c in prices.columns if c not in {"month", CODE, "area_sqm"}}
    issues = materialise(master_issues(master, complexes), "register-issues") if issues is None else issues
    bad = issues.select(CODE).distinct().withColumn("_bad", F.lit(True))
    register = master.join(bad, CODE, "left")
    register = register.withColumn("_ok", F.col("_bad").isNull() & (F.col("verification_status") == "verified") & (F.col("scope") == SALE_SCOPE))
    targets = month_rows(complexes, labels).withColumn("_end", months.index_month_end(F.col("_vm")))
    detail = _area_details(register.where("_ok"), complexes, labels, facts, told, approved, extrapolation_coverage)
    first_deal = contracts.agg(F.min("deal_date").alias("d")).scalar()
    history_start = months.index_month_start(months.label_to_index(F.col("month")) - 11)
    detail = detail.withColumn("_first", first_deal).withColumns(
        {
            "initial_history_short": F.col("_first") > history_start,
            "historical_composition_unknown": F.col("valid_from").isNull(),
        }
    ).drop("_first")
    if stored is not None:
        detail = materialise(detail.select(*dict.fromkeys([*TOTALLED, *stored])), "valued-types")
    return _complex_totals(targets, _compositions(register, labels), detail, approved), detail


def _places(df: DataFrame) -> int:
    """Partitions for rows that will unfold into months; unlike their bytes before, their number must not shrink."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _monthly_types(
    rows: DataFrame, complexes: DataFrame, labels: Iterable[str] | Column, facts: DataFrame, told: dict[str, Column], stored: str | None = None
) -> DataFrame:
    """Register rows of known complexes once per month of their validity, with the prices of the month or nulls.

    Prices of an area meet its register rows as lists, which hold the numbers of a price per month. Both are dealt once, by
    complex, and all that follows stays in these tasks. What the numbers tell is worked out last, so only what is read of it.
    ``stored`` names a table to store the types in, their prices still lists, before months unfold.
    """
    own, numbers = list(rows.columns), [c for c in facts.columns if c not in {"_vm", CODE, "area_sqm"}]
    first, last = months.month_index(F.col("valid_from")), months.month_index(F.col("valid_to")) - (F.col("valid_to") < F.last_day("valid_to")).cast("int")
    types = rows.join(complexes.select(CODE, F.col("approval_date").alias("_approval")), CODE)
    types = types.withColumns({"_first": F.coalesce(first.cast("long"), F.lit(-(2**60))), "_last": F.coalesce(last.cast("long"), F.lit(2**60))})
    price = F.struct(F.col("_vm").cast("long").alias("_vm"), *numbers)
    offers = facts.where(F.col("area_sqm").isNotNull()).select(CODE, F.col("area_sqm").cast("double").alias("_area"), price.alias("_price"))
    offered = offers.schema["_price"].dataType
    types = types.select(CODE, F.col("exclusive_area_sqm").cast("double").alias("_area"), F.struct(*[c for c in types.columns if c != CODE]).alias("_type"))
    both = types.unionByName(offers, allowMissingColumns=True).repartition(_places(rows), CODE)
    # A leading hash makes the sort by key compare numbers.
    met = both.groupBy(F.xxhash64(CODE, "_area").alias("_lead"), CODE, "_area").agg(F.collect_list("_type").alias("_types"), F.collect_list("_price").alias("_prices"))
    met = met.select(CODE, F.explode("_types").alias("_type"), "_prices")
    met = materialise(met, stored).repartition(_places(rows), CODE) if stored else met
    met = met.withColumn("_all", month_indexes(labels))
    within = lambda m: (m >= F.col("_type._first")) & (m <= F.col("_type._last"))
    unknown = F.array_except(F.transform("_all", lambda m: m.cast("long")), F.col("_prices._vm"))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in offered.fields[1:]]
    each = F.concat("_prices", F.transform(unknown, lambda m: F.struct(m.alias("_vm"), *nothing)))
    met = met.select(CODE, "_type", F.explode(each).alias("_price")).where(within(F.col("_price._vm")))
    met = met.select(CODE, "_type", "_price.*")
    exists = F.coalesce(F.col("_type._approval") <= months.index_month_end(F.col("_vm")), F.lit(False)).alias("_exists")
    rest = [F.col(f"_type.{c}").alias(c) for c in own if c not in {CODE, "exclusive_area_sqm"}]
    return met.select(
        months.index_to_label(F.col("_vm")).alias("month"), CODE, F.col("_type.exclusive_area_sqm").alias("exclusive_area_sqm"), *rest, exists,
        *[c.alias(name) for name, c in told.items()],
    )


def _area_details(
    rows: DataFrame, complexes: DataFrame, labels: Iterable[str] | Column, facts: DataFrame, told: dict[str, Column], approved: Iterable[str] | Column, coverage: float
) -> DataFrame:
    if not isinstance(approved, Column) and not approved:
        local = _existing(_monthly_types(rows, complexes, labels, facts, told))
    else:
        # Only types of approved complexes can take a neighbour's price; the others are neither stored nor sorted for it.
        mine = F.coalesce(_is_approved(approved), F.lit(False))
        chosen = lambda test, stored=None: _existing(_monthly_types(rows.where(test), complexes, labels, facts.where(test), told, stored))
        local = chosen(~mine).unionByName(_extrapolate(chosen(mine, "priced-types"), coverage))
    return local.withColumn("contribution_krw", F.col("households") * F.col("price_krw")).drop("_bad", "_ok", "_exists")


def _existing(local: DataFrame) -> DataFrame:
    """Types without a price before their complex was approved, and with every missing number told."""
    gone = ~F.col("_exists")
    hide = lambda c: F.when(gone, F.lit(None)).otherwise(F.col(c))
    return local.withColumns(
        {
            "price_krw": hide("price_krw"),
            "price_1m_krw": hide("price_1m_krw"),
            "transaction_count": F.when(gone, 0).otherwise(F.coalesce("transaction_count", F.lit(0))),
            "method": F.when(gone, "not_existing").otherwise(F.coalesce("method", F.lit("unavailable"))),
            "small_sample": F.coalesce("small_sample", F.lit(False)),
            "small_sample_1m": F.coalesce("small_sample_1m", F.lit(True)),
            "count_1m": F.coalesce("count_1m", F.lit(0)),
            "old_transactions": F.coalesce("old_transactions", F.lit(False)),
        }
    )


def _is_approved(approved: Iterable[str] | Column) -> Column:
    """A rule over the complex code, or a list of codes, as a condition."""
    return F.coalesce(approved, F.lit(False)) if isinstance(approved, Column) else F.col(CODE).isin(list(approved))


def _extrapolate(local: DataFrame, coverage: float) -> DataFrame:
    """Price the open types of approved complexes like the nearest priced area (first type on ties).

    Rows of a complex stand in one task already, so its months are told apart by sorting there. A donor is the last area at or
    below and the first one above; of types with one area the first by group.
    """
    priced = F.col("price_krw").isNotNull()
    group = Window.partitionBy(CODE, "month")
    marked = local.withColumns({"_priced": F.sum(F.when(priced, F.col("households")).otherwise(0)).over(group), "_all": F.sum("households").over(group)})
    allowed = (F.col("_priced") > 0) & (F.col("_priced") / F.col("_all") >= coverage)
    marked = marked.withColumns({"_open": F.coalesce(allowed & ~priced, F.lit(False)), "_unit": F.col("price_krw") / F.col("exclusive_area_sqm")})
    offer = F.when(F.coalesce(allowed & priced, F.lit(False)), F.struct(F.col("exclusive_area_sqm").alias("a"), F.col("area_group_id").alias("g"), F.col("_unit").alias("unit")))
    marked = marked.withColumn("_offer", offer)
    downwards = group.orderBy("exclusive_area_sqm", "_open", F.desc("area_group_id"), F.desc("_unit"))
    upwards = group.orderBy("exclusive_area_sqm", "_open", F.asc("area_group_id"), F.asc("_unit"))
    below = F.last("_offer", ignorenulls=True).over(downwards.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first("_offer", ignorenulls=True).over(upwards.rowsBetween(0, Window.unboundedFollowing))
    marked = marked.withColumns({"_b": below, "_u": above})
    far_b, far_u = F.col("exclusive_area_sqm") - F.col("_b.a"), F.col("_u.a") - F.col("exclusive_area_sqm")
    take_below = F.col("_u").isNull() | (far_b < far_u) | ((far_b == far_u) & (F.col("_b.g") <= F.col("_u.g")))
    marked = marked.withColumn("_near", F.when(F.col("_b").isNotNull() & take_below, F.col("_b.unit")).otherwise(F.col("_u.unit")))
    use = F.col("_open") & F.col("_near").isNotNull()
    new = F.bround(F.col("_near") * F.col("exclusive_area_sqm"), 0)
    step = {"price_krw": new, "method": F.lit(NEAREST_METHOD), "window_months": F.lit(12), "small_sample": F.lit(True)}
    out = marked.withColumns({c: F.when(use, v).otherwise(F.col(c)) for c, v in step.items()})
    return out.drop("_priced", "_all", "_open", "_unit", "_offer", "_b", "_u", "_near")


#: What the values of a complex are summed up from.
TOTALLED = ["month", CODE, "area_group_id", "households", "price_krw", "price_1m_krw", "contribution_krw", "method", "window_months", "small_sample", "small_sample_1m"]


def _compositions(register: DataFrame, labels: Iterable[str] | Column) -> DataFrame:
    """Register rows of every complex and month in one row, aggregated once per span of months with the same rows."""
    spans = active_spans(register, labels).groupBy("_months", CODE).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum("households").alias("_all"),
        F.bool_and(F.col("verification_status") == "verified").alias("_verified"),
        F.bool_and(F.col("scope") == SALE_SCOPE).alias("_sale"),
        F.bool_or(F.col("_bad").isNotNull()).alias("_bad"),
        F.bool_or(F.col("valid_from").isNull()).alias("_undated"),
        multiset_digest(composition_entry()).alias("composition_hash"),
    )
    return spans.withColumn("_vm", F.explode("_months")).withColumn("month", months.index_to_label(F.col("_vm"))).drop("_months", "_vm")


def _complex_totals(targets: DataFrame, composition: DataFrame, detail: DataFrame, approved: Iterable[str] | Column) -> DataFrame:
    key = ["month", CODE]
    priced = F.col("price_krw").isNotNull()
    homes = F.col("households")
    share = lambda n: F.sum(F.when(priced & (F.col("window_months") == n), homes).otherwise(0)).alias(f"_w{n}")
    values = detail.groupBy(*key).agg(
        F.sum(homes).alias("confirmed_households"),
        F.sum(F.when(priced, homes).otherwise(0)).alias("priced_households"),
        F.sum(F.when(priced, F.col("contribution_krw"))).alias("partial_cap_krw"),
        *[share(n) for n in WINDOWS],
        F.max(F.when(priced, F.col("window_months"))).alias("_window"),
        F.bool_or(priced & F.col("small_sample")).alias("_small"),
        F.bool_and(F.col("price_1m_krw").isNotNull()).alias("_one"),
        F.sum(homes * F.col("price_1m_krw")).alias("_cap1"),
        F.bool_or("small_sample_1m").alias("_small1"),
        multiset_digest(method_entry()).alias("method_signature"),
    )
    out = targets.join(composition, key, "left").join(values, key, "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("confirmed_households", "priced_households")})
    rows = F.coalesce(F.col("_rows"), F.lit(0))
    adjusted = _is_approved(approved)
    sale_type = F.coalesce(F.col("sale_type"), F.lit("unknown")) if "sale_type" in targets.columns else F.lit("unknown")
    building = F.coalesce(F.col("building_type"), F.lit("unknown")) if "building_type" in targets.columns else F.lit("unknown")
    reasons = [
        (F.col("approval_date").isNull(), "준공·입주 시점 미확인"),
        (F.col("approval_date") > F.col("_end"), "준공 전"),
        (rows == 0, "평형별 세대수 보완 필요"),
        (F.col("_bad"), "평형 마스터 검증 오류"),
        ((rows > 0) & ~F.col("_all").eqNullSafe(homes), "평형 세대수 합계 불일치"),
        ((rows > 0) & ~F.col("_verified"), "평형 세대수 미검증"),
        ((rows > 0) & ~F.col("_sale"), "임대·분양 범위 확인 필요"),
        ((sale_type != SALE_TYPE) & ~adjusted, "임대·혼합단지 분양 세대수 미확인"),
        (~building.isin(BUILDINGS), "아파트 주거용 미확인"),
        (F.col("priced_households") < F.col("confirmed_households"), "일부 평형 시세 미확보"),
    ]
    out = out.withColumn("reason", join_reasons(reasons))
    complete = (F.col("reason") == "") & F.coalesce(F.col("priced_households") == homes, F.lit(False))
    out = out.withColumn("_complete", complete)
    grade = F.when(~F.col("_complete"), INCOMPLETE).when(F.col("_small"), SMALL_SAMPLE_GRADE)
    for n, letter in GRADES.items():
        grade = grade.when(F.col("_window") == n, letter)
    cap = F.when(F.col("_complete"), F.col("partial_cap_krw"))
    one = F.coalesce(F.col("_complete") & F.col("_one"), F.lit(False))
    history_note = "현재 확보 자료로 재구성한 과거 추정치"
    out = out.withColumns(
        {
            "grade": grade,
            "market_cap_krw": cap,
            "per_household_krw": numeric.ratio(cap, F.col("priced_households")),
            "market_cap_1m_krw": F.when(one, F.col("_cap1")),
            "small_sample_1m": F.coalesce(F.col("_small1"), F.lit(False)) | ~one,
            "household_coverage": numeric.ratio(F.col("confirmed_households"), homes),
            "price_coverage": numeric.ratio(F.col("priced_households"), homes),
            **{f"share_{n}m": numeric.ratio(F.coalesce(F.col(f"_w{n}"), F.lit(0.0)), homes) for n in WINDOWS},
            "composition_hash": F.coalesce("composition_hash", F.sha2(F.lit("0"), 256)),
            "method_signature": F.coalesce("method_signature", F.sha2(F.lit("0"), 256)),
            "historical_limit": F.when((rows == 0) | F.col("_undated"), f"{history_note}; 과거 세대 구성 미확인").otherwise(history_note),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def join_reasons(rules: list[tuple[Column, str]]) -> Column:
    """The reasons that hold, in order, joined by ``"; "``; an unknown test does not hold."""
    return F.concat_ws("; ", F.array_distinct(F.array_compact(F.array(*[F.when(t, F.lit(r)) for t, r in rules]))))


def used_contracts(detail: DataFrame, contracts: DataFrame) -> DataFrame:
    """The contracts behind every valued area and month, with the unusual-price flag.

    The periods of a complex are stored as one row: a list of numbers per area. Contracts of complexes of few contracts are dealt once,
    by complex, meet their periods there and stay there, also for the medians, which are worked out only if they are read. Complexes of
    many contracts are dealt by area as well, and their medians come from stored bucket counts, so that no task holds one of them.
    """
    keys = [CODE, "area_sqm", "month"]
    chosen = detail.where((F.col("transaction_count") > 0) & F.col("window_months").isNotNull())
    periods = chosen.groupBy(CODE, F.col("exclusive_area_sqm").alias("area_sqm")).agg(F.collect_set(_packed_period()).alias("_periods"))
    listed = F.map_from_entries(F.collect_list(F.struct("area_sqm", "_periods"))).alias("_areas")
    periods = materialise(periods.where(F.col("area_sqm").isNotNull()).groupBy(CODE).agg(listed), "used-periods")
    few, many = rows_by_size(contracts, [CODE])
    # A map is many times its stored size, so it is dealt and never sent to every task; the rows then stay dealt by complex.
    met = few.join(periods.hint("merge"), CODE).withColumn("_periods", F.element_at("_areas", F.col("area_sqm").cast("double"))).drop("_areas")
    price = F.nanvl(F.col("deal_amount_krw").cast("double"), F.lit(None).cast("double"))
    rows = _within_periods(met).withColumn("_median", F.percentile(price, F.lit(0.5)).over(Window.partitionBy(*keys)))
    if many is not None:
        areas = periods.select(CODE, F.explode("_areas").alias("area_sqm", "_periods"))
        crowded = _within_periods(many.join(areas, [CODE, "area_sqm"]))
        medians = known_quantiles(crowded, keys, {"_median": Quantile(F.col("deal_amount_krw"))}, stored=True)
        rows = rows.unionByName(join_keys(crowded, medians, keys))
    return _flagged(rows)


_DAY_BITS = intervals.LEVELS


def _packed_period() -> Column:
    """Month, first and last day of a period as one number."""
    day = lambda c: F.datediff(F.col(c), F.lit(intervals.FIRST_DATE).cast("date")).cast("long")
    month = months.label_to_index(F.col("month")).cast("long")
    return F.shiftleft(F.shiftleft(month, _DAY_BITS).bitwiseOR(day("period_start")), _DAY_BITS).bitwiseOR(day("period_end"))


def _within_periods(contracts: DataFrame) -> DataFrame:
    """Contracts once per period of their list that holds them."""
    day, limit = F.datediff(F.col("deal_date"), F.lit(intervals.FIRST_DATE).cast("date")), F.lit(2**_DAY_BITS - 1)
    first, last = F.shiftright("_period", _DAY_BITS).bitwiseAND(limit), F.col("_period").bitwiseAND(limit)
    rows = contracts.withColumn("_period", F.explode("_periods")).where((day >= first) & (day <= last))
    date = lambda n: F.date_add(F.lit(intervals.FIRST_DATE).cast("date"), n.cast("int"))
    told = {"month": months.index_to_label(F.shiftright("_period", 2 * _DAY_BITS)), "period_start": date(first), "period_end": date(last)}
    return rows.withColumns(told).drop("_period", "_periods")


def flag_unusual_prices(rows: DataFrame, keys: list[str] = (CODE, "area_sqm")) -> DataFrame:
    """Prices below half or above twice the median of their group."""
    keys = list(keys)
    medians = known_quantiles(rows, keys, {"_median": Quantile(F.col("deal_amount_krw"))})
    return _flagged(join_keys(rows, medians, keys))


def _flagged(rows: DataFrame) -> DataFrame:
    odd = (F.col("deal_amount_krw") < F.col("_median") * 0.5) | (F.col("deal_amount_krw") > F.col("_median") * 2)
    return rows.withColumn("unusual_price", odd).drop("_median")


def sensitivity(
    complexes: DataFrame, master: DataFrame, contracts: DataFrame, month: str, minimums: tuple[int, ...] = (2, 3, 5), **options
) -> DataFrame:
    """Number of complexes per grade for several minimum sample sizes of one month.

    Window statistics and register issues do not depend on the minimum and are computed once.
    """
    stats = materialise(window_statistics(contracts, [month]), "window-statistics")
    issues = materialise(master_issues(master, complexes), "register-issues")
    parts = None
    for minimum in minimums:
        chosen = choose_window(stats, minimum)
        totals, _ = estimate(complexes, master, contracts, [month], minimum, prices=chosen, issues=issues, **options)
        rows = totals.select(F.lit(minimum).alias("minimum_transactions"), "grade")
        parts = rows if parts is None else parts.unionByName(rows)
    grades = [*GRADES.values(), SMALL_SAMPLE_GRADE, INCOMPLETE]
    counts = parts.groupBy("minimum_transactions").pivot("grade", grades).agg(F.count(F.lit(1)))
    return counts.na.fill(0)


def coverage_figures(totals: DataFrame) -> DataFrame:
    """Targets, complete values, missing households and prices, and the total value."""
    return totals.agg(
        F.count(F.lit(1)).alias("target_complexes"),
        F.count("market_cap_krw").alias("complete_complexes"),
        F.count_if(F.col("confirmed_households") < F.col("households")).alias("missing_households"),
        F.count_if(F.col("priced_households") < F.col("confirmed_households")).alias("missing_price"),
        F.sum("market_cap_krw").alias("total_cap_krw"),
    )


def supplement_needed(totals: DataFrame) -> DataFrame:
    """Complexes of the latest month whose value is incomplete, with their reasons."""
    latest = totals.agg(F.max("month").alias("m")).scalar()
    rows = totals.withColumn("_latest", latest).where(F.col("month") == F.col("_latest")).drop("_latest")
    return rows.where(F.col("grade") == INCOMPLETE)


def area_register_template(complexes: DataFrame) -> DataFrame:
    """One empty register row per complex to be filled in by hand; the name goes to the notes."""
    empty = ["area_group_id", "exclusive_area_sqm", "supply_area_sqm", "type_name", "households", "source", "verified_at", "valid_from", "valid_to"]
    return complexes.select(
        CODE, *[F.lit("").alias(c) for c in empty], F.lit("pending").alias("verification_status"), F.lit("unknown").alias("scope"),
        F.col("complex_name").alias("notes"),
    )


def contribution_shares(detail: DataFrame) -> DataFrame:
    """Share of every type in its complex and the difference of the one-month price in percent."""
    out = with_group(detail, ["month", CODE], F.sum("contribution_krw").alias("_all"))
    return out.withColumns(
        {
            "contribution_share": numeric.ratio(F.col("contribution_krw"), F.col("_all")),
            "price_1m_diff_pct": (numeric.ratio(F.col("price_1m_krw"), F.col("price_krw")) - 1) * 100,
        }
    ).drop("_all")


def rank_history(history: DataFrame, grades: tuple[str, ...] = ("A", "B"), minimum_households: int = 500) -> DataFrame:
    """Ranks of every month and their comparison with the month and the year before.

    Ranks are minimum ranks within the month, taken before any district filter. Values are
    compared only under equal rules; the common rank counts comparable complexes only.
    """
    chosen = F.col("grade").isin(list(grades)) & (F.col("households") >= minimum_households) & F.col("market_cap_krw").isNotNull()
    ranked = history.where(chosen).withColumn("_m", months.label_to_index(F.col("month")))
    ranked = with_rank(ranked, ["month"], "market_cap_krw", "rank")
    district = with_rank(ranked.where("sigungu IS NOT NULL").select("month", CODE, "sigungu", "market_cap_krw"), ["month", "sigungu"], "market_cap_krw", "district_rank")
    ranked = ranked.join(district.select("month", CODE, "district_rank"), ["month", CODE], "left")
    # The ranked rows meet themselves twice below, so they are stored once.
    ranked = materialise(with_rank(ranked, ["month"], "per_household_krw", "household_value_rank"), "ranked")
    facts = ["market_cap_krw", "rules_hash", "rank", "composition_hash", "method_signature", "input_hash"]
    facts = [c for c in facts if c in ranked.columns]

    def before(offset: int, prefix: str) -> DataFrame:
        return ranked.select(CODE, (F.col("_m") + offset).alias("_m"), *[F.col(c).alias(f"{prefix}{c}") for c in facts])

    months_with_ranks = ranked.select((F.col("_m") + 1).alias("_m")).distinct().withColumn("_has_ranked", F.lit(True))
    months_present = history.select((months.label_to_index(F.col("month")) + 1).alias("_m")).distinct().withColumn("_has_any", F.lit(True))
    out = ranked.join(before(1, "_p_"), [CODE, "_m"], "left").join(before(12, "_y_"), [CODE, "_m"], "left")
    out = out.join(months_with_ranks, "_m", "left").join(months_present, "_m", "left")
    known, same = F.col("_p_rank").isNotNull(), F.coalesce(F.col("_p_rules_hash") == F.col("rules_hash"), F.lit(False))
    same_year = F.coalesce(F.col("_y_rules_hash") == F.col("rules_hash"), F.lit(False))
    out = out.withColumn("_same", known & same)
    growth = lambda p: (F.col("market_cap_krw") / F.col(f"{p}market_cap_krw") - 1) * 100
    flags = [("composition_hash", "평형 구성/세대수 자료 변경"), ("method_signature", "가격 산정 기간 전환"), ("input_hash", "입력 자료 버전 변경")]
    changed = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_p_{c}")), F.lit(t)) for c, t in flags if c in facts]))
    out = out.withColumns(
        {
            "mom_krw": F.when(F.col("_same"), F.col("market_cap_krw") - F.col("_p_market_cap_krw")),
            "mom_pct": F.when(F.col("_same"), growth("_p_")),
            "yoy_pct": F.when(same_year, growth("_y_")),
            "rank_change": F.when(F.col("_same"), F.col("_p_rank") - F.col("rank")),
            "comparison_status": F.when(F.col("_same"), COMPARABLE)
            .when(known, OTHER_RULES)
            .when(F.col("_has_ranked") | F.col("_has_any"), NEW)
            .otherwise(NOT_COMPARABLE),
            "change_flags": F.when(F.col("_same"), F.concat_ws("; ", changed)).otherwise(""),
        }
    )
    out = materialise(out, "compared")
    common = out.where("_same").select("month", CODE, "market_cap_krw", "_p_market_cap_krw")
    common = with_rank(common, ["month"], "market_cap_krw", "common_rank")
    common = with_rank(common, ["month"], "_p_market_cap_krw", "_before")
    common = common.select("month", CODE, "common_rank", (F.col("_before") - F.col("common_rank")).alias("common_rank_change"))
    out = out.join(common, ["month", CODE], "left")
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def top_of_month(ranked: DataFrame, n: int | None = None, sigungu: str | None = None) -> DataFrame:
    """The best rows of the latest month by global rank; filters never change a rank."""
    latest = ranked.agg(F.max("month").alias("m")).scalar()
    rows = ranked.withColumn("_latest", latest).where(F.col("month") == F.col("_latest")).drop("_latest")
    if sigungu is not None:
        rows = rows.where(F.col("sigungu") == sigungu)
    rows = rows.orderBy(F.asc_nulls_last("rank"), CODE)
    return rows if n is None else rows.limit(n)


def common_base_index(history: DataFrame, codes: list[str]) -> DataFrame:
    """Values as an index, 100 at the first month in which all chosen complexes have one."""
    rows = history.where(F.col(CODE).isin(list(codes)) & F.col("market_cap_krw").isNotNull()).select("month", CODE, "market_cap_krw")
    rows = materialise(rows, "chosen-complexes")
    everyone = rows.agg(F.countDistinct(CODE).alias("n")).scalar()
    per_month = rows.groupBy("month").agg(F.countDistinct(CODE).alias("_n")).withColumn("_all", everyone)
    base_month = per_month.where(F.col("_n") == F.col("_all")).agg(F.min("month").alias("m")).scalar()
    rows = rows.withColumn("base_month", base_month).where(F.col("month") >= F.col("base_month"))
    base = rows.where(F.col("month") == F.col("base_month")).select(CODE, F.col("market_cap_krw").alias("_base"))
    out = rows.join(base, CODE)
    return out.withColumn("index_value", F.col("market_cap_krw") / F.col("_base") * 100).drop("_base")


def tie_out(totals: DataFrame, detail: DataFrame, tolerance: float = 1.0, keys: tuple[str, ...] = (CODE,)) -> DataFrame:
    """Complexes (or other keys) whose stored value differs from the sum of their types; empty when all agree."""
    sums = detail.groupBy(*keys).agg(F.sum("adjusted_contribution_krw").alias("detail_sum"))
    both = totals.where(F.col("adjusted_market_cap_krw").isNotNull()).join(sums, list(keys), "left")
    return both.where(F.col("detail_sum").isNull() | (F.abs(F.col("adjusted_market_cap_krw") - F.col("detail_sum")) > tolerance))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join that aborts when a key repeats on either side."""
    from .quality import require_unique

    require_unique(left, keys, "left side")
    require_unique(right, keys, "right side")
    return left.join(right, keys, how)


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join that aborts when a key repeats on the right."""
    from .quality import require_unique

    require_unique(right, keys, "mapping")
    return join_keys(left, right, keys)
