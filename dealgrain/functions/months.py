"""Month arithmetic on an integer month index (year * 12 + month - 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """A date from text or numeric parts; anything invalid becomes null."""
    y, m, d = (p.cast("string").try_cast("double").try_cast("int") for p in (year, month, day))
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(y, m, d, zero, zero, zero.cast("decimal(16,6)")).cast("date")


def month_index(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d) - 1


def month_label(d: Column) -> Column:
    """``YYYY-MM`` of a date, null for a null date."""
    return F.substring(d.cast("date").cast("string"), 1, 7)


def label_to_index(label: Column) -> Column:
    """Month index of a ``YYYY-MM`` text; null when it is not a month."""
    text = label.cast("string")
    shaped = (F.length(text) == 7) & (F.substring(text, 5, 1) == "-")
    return month_index(F.when(shaped, F.concat(text, F.lit("-01")).try_cast("date")))


def packed_to_index(packed: Column) -> Column:
    """Month index of a ``YYYYMM`` text; null when it is not a month."""
    text = packed.cast("string")
    return label_to_index(F.when(F.length(text) == 6, F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2))))


def index_month_start(index: Column) -> Column:
    return F.add_months(F.lit("1970-01-01").cast("date"), (index - 1970 * 12).cast("int"))


def index_to_label(index: Column) -> Column:
    return month_label(index_month_start(index))


def index_to_packed(index: Column) -> Column:
    return F.replace(index_to_label(index), F.lit("-"), F.lit(""))


def index_month_end(index: Column) -> Column:
    return F.last_day(index_month_start(index))


def is_provisional(index: Column, as_of: str, months: int = 2) -> Column:
    """Whether a month is among the last ``months`` calendar months ending at ``as_of``."""
    cut = month_index(F.lit(as_of).cast("date")) - max(0, months - 1)
    return F.coalesce(index >= cut, F.lit(False))


def months_between_labels(first: Column, last: Column) -> Column:
    """Array of ``YYYYMM`` texts from one packed month to another, both included."""
    return F.transform(F.sequence(packed_to_index(first), packed_to_index(last)), index_to_packed)


def in_month_window(df: DataFrame, label_col: str, months: int | str) -> DataFrame:
    """Rows of the last ``months`` months (or ``"ytd"``) ending at the latest month in the data.

    The bounds come from one aggregate used as scalar subqueries, and ride on every row as
    ``window_start`` and ``window_end``.
    """
    if months != "ytd" and (not isinstance(months, int) or months < 1):
        raise ValueError("months must be a positive integer or 'ytd'")
    latest = df.agg(F.max(label_to_index(F.col(label_col))).alias("m")).scalar()
    indexed = df.withColumn("_midx", label_to_index(F.col(label_col))).withColumn("_last", latest)
    first = F.floor(F.col("_last") / 12).cast("int") * 12 if months == "ytd" else F.col("_last") - (months - 1)
    return (
        indexed.withColumn("_first", first)
        .where(F.col("_midx").between(F.col("_first"), F.col("_last")))
        .withColumn("window_start", index_to_label(F.col("_first")))
        .withColumn("window_end", index_to_label(F.col("_last")))
        .drop("_midx", "_first", "_last")
    )
