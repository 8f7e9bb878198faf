"""School snapshots, rankings and display views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bands
from .quality import require_columns, require_unique
from .scale import with_rank

CITY, SELECTED = "부산 전체", "선택 지역"
# Report names of the yearly columns and of the facts of one school.
HISTORY_LABELS = {
    "data_year": "연도", "year": "연도", "total_students": "총학생수(명)", "total_classes": "학급수(개)",
    "students_per_class": "학급당 학생수(명/학급)", "transfer_in": "전입 학생수(명)", "transfer_out": "전출 학생수(명)",
    "net_transfer_rate": "순전입률", "graduates": "졸업자 수(명)", "science_hs_count": "과학고 진학자 수(명)",
    "foreign_international_hs_count": "외고·국제고 진학자 수(명)",
    "autonomous_private_hs_count": "자율형사립고 진학자 수(명)", "academic_selective_count": "선택고 진학자 수(명)",
    "science_rate": "과학고 관측 진학률", "foreign_international_rate": "외고·국제고 관측 진학률",
    "autonomous_private_rate": "자율형사립고 관측 진학률", "academic_selective_rate": "선택고 관측 진학률",
    "eligible_for_scoring": "점수 산정 사용", "manual_review": "수동 검토 필요", "review_reason": "검토 사유",
}
FLAG_LABELS = {"eligible_for_scoring": ("사용", "제외", "자료 없음"), "manual_review": ("필요", "해당 없음", "자료 없음")}
RATE_SUFFIX = "_rate"
# Words for coded facts and for what is missing.
MISSING = "자료 없음"
QUALITY_WORDS = {"HIGH": "높음", "MEDIUM": "보통", "LOW": "낮음"}
STATUS_WORDS = {"scored": "점수 산정 완료", "no_valid_observations": "유효 관측자료 없음", "closed_or_suspended": "폐교 또는 휴교"}
REVIEW_WORDS = {"small_sample_or_missing_years": "소표본 또는 관측연도 부족", "no_valid_observations": "유효 관측자료 없음", "closed_or_suspended": "폐교 또는 휴교"}
# The facts of one school in order, with their column and form.
ELEMENTARY_FACTS = [
    ("총학생수", "total_students", "whole", "명"), ("학급수", "total_classes", "whole", "개"), ("학급당 학생수", "students_per_class", "decimal", "명/학급"),
    ("전입 학생수", "transfer_in", "whole", "명"), ("전출 학생수", "transfer_out", "whole", "명"), ("순전입률", "net_transfer_rate", "percent", ""),
    ("최근 3개년 학생수 변화율", "student_growth_3y", "percent", ""), ("학생수 추세", "student_trend_slope", "decimal", "명/년"),
    ("보정 고학년 지수", "adjusted_upper_grade_index", "decimal3", ""), ("보정 동일학년군 성장률", "adjusted_cohort_growth", "percent", ""),
    ("수요 유형", "demand_cluster_name", "words", {}), ("자료 완전성", "longitudinal_complete", "flag", ("완전", "확인 필요")),
    ("자료 신뢰도", "demand_score_quality", "words", QUALITY_WORDS), ("자료 기준연도", "data_year", "year", "년"),
]
MIDDLE_FACTS = [
    ("졸업자 수", "graduates", "whole", "명"), ("과학고 진학자 수", "science_hs_count", "whole", "명"), ("과학고 관측 진학률", "science_rate", "percent", ""),
    ("외고·국제고 진학자 수", "foreign_international_hs_count", "whole", "명"), ("외고·국제고 관측 진학률", "foreign_international_rate", "percent", ""),
    ("자율형사립고 진학자 수", "autonomous_private_hs_count", "whole", "명"), ("자율형사립고 관측 진학률", "autonomous_private_rate", "percent", ""),
    ("최근 관측연도", "latest_observation_year", "year", "년"), ("관측연도 수", "available_year_count", "whole", "개년"), ("자료 안정성", "score_stability", "percent", ""),
    ("점수 상태", "score_status", "words", STATUS_WORDS), ("소표본 주의", "sample_warning", "flag", ("확인 필요", "해당 없음")),
]


def score_table(schools: DataFrame, scores: DataFrame, score: str, score_type: str) -> DataFrame:
    """Scores joined one-to-one to the school register, with district rank and coordinate check."""
    require_columns(scores, ["school_id", score], "scores")
    require_unique(schools, ["school_id"], "schools")
    require_unique(scores, ["school_id"], "scores")
    extra = [c for c in schools.columns if c == "school_id" or c not in scores.columns]
    out = scores.join(schools.select(*extra), "school_id", "left")
    out = out.withColumns({"score": F.col(score).cast("double"), "score_type": F.lit(score_type)})
    ranks = with_rank(out.where("sigungu IS NOT NULL").select("school_id", "sigungu", "score"), ["sigungu"], "score", "district_rank")
    out = out.drop("district_rank").join(ranks.select("school_id", "district_rank"), "school_id", "left")
    return out.withColumn("coordinate_valid", bands.coordinate_valid(F.col("latitude"), F.col("longitude")))


def combine_levels(elementary: DataFrame, middle: DataFrame) -> DataFrame:
    """Both school kinds in one table; columns of one kind are null for the other."""
    return elementary.unionByName(middle, allowMissingColumns=True)


def school_history(history: DataFrame, key: list[str], eligible: str | None = None) -> DataFrame:
    """Yearly rows with a unique key, only eligible ones when such a flag exists."""
    rows = history
    if eligible is not None and eligible in history.columns:
        rows = rows.where(F.coalesce(F.col(eligible).cast("boolean"), F.lit(False)))
    require_unique(rows, key, "school history")
    return rows


def top_schools(data: DataFrame, level: str, top_n: int, scope: str = CITY, districts: list[str] | str | None = None) -> DataFrame:
    """The best open schools of a level.

    For the whole city the limit comes first and the district filter after it; for selected
    districts the filter comes first.
    """
    from .ranking import top_rows

    wanted = [districts] if isinstance(districts, str) else list(districts or [])
    shut = lambda c: F.coalesce(F.col(c) == "Y", F.lit(False))
    rows = data.where((F.col("school_level") == level) & F.col("score").isNotNull() & ~shut("closed") & ~shut("suspended"))
    if scope == SELECTED and wanted:
        rows = rows.where(F.col("sigungu").isin(wanted))
    best = top_rows(rows, [F.desc("score"), F.asc("school_id")], top_n, "selection_rank")
    if scope == CITY and wanted:
        best = best.where(F.col("sigungu").isin(wanted))
    return best


def history_view(history: DataFrame, school_id: str | None = None) -> DataFrame:
    """The yearly columns of one school, or of all, under report names; rates become percent, flags words."""
    rows = history if school_id is None else history.where(F.col("school_id") == school_id)
    out = []
    for c, label in HISTORY_LABELS.items():
        if c not in rows.columns:
            continue
        value = F.col(c)
        if c in FLAG_LABELS:
            yes, no, unknown = FLAG_LABELS[c]
            value = F.when(value, yes).when(~value, no).otherwise(unknown)
        elif c == "review_reason":
            value = as_text(value, "words", REVIEW_WORDS)
        elif c.endswith(RATE_SUFFIX):
            value = F.round(value * 100, 2)
        out.append(value.alias(label))
    return rows.select("school_id", *out)


def detail_rows(data: DataFrame, columns: list[str]) -> DataFrame:
    """Chosen facts of each school as rows of item and text."""
    texts = data.select("school_id", *[F.col(c).cast("string").alias(c) for c in columns])
    return texts.unpivot(["school_id"], columns, "item", "value").where("value IS NOT NULL")


def as_text(value: Column, form: str, extra) -> Column:
    """A fact as readers see it; unknown values say so. ``extra`` is a suffix, a word list or the words for yes and no."""
    if form == "words":
        text = value.cast("string")
        known = F.coalesce(F.create_map(*[F.lit(x) for pair in extra.items() for x in pair])[text], text) if extra else text
        return F.when(F.trim(text) == "", MISSING).otherwise(F.coalesce(known, F.lit(MISSING)))
    if form == "flag":
        return F.when(value.cast("boolean"), extra[0]).when(~value.cast("boolean"), extra[1]).otherwise(MISSING)
    amount = value.cast("double")
    amount = F.when(~F.isnan(amount), amount)
    shown = {
        "whole": F.format_number(F.bround(amount, 0), 0), "decimal": F.format_number(amount, 1), "decimal3": F.format_number(amount, 3),
        "percent": F.concat(F.replace(F.format_number(amount * 100, 1), F.lit(","), F.lit("")), F.lit("%")), "year": amount.cast("long").cast("string"),
    }[form]
    return F.coalesce(F.concat(shown, F.lit(extra)), F.lit(MISSING))


def fact_rows(data: DataFrame, facts: list[tuple]) -> DataFrame:
    """Every fact of every school as a row of position, item and text, in one pass; a missing column counts as unknown."""
    have = set(data.columns)
    rows = [
        F.struct(F.lit(i).cast("bigint").alias("position"), F.lit(label).alias("item"), as_text(F.col(c) if c in have else F.lit(None), form, extra).alias("value"))
        for i, (label, c, form, extra) in enumerate(facts, 1)
    ]
    return data.select("school_id", F.explode(F.array(*rows)).alias("_f")).select("school_id", "_f.*")
