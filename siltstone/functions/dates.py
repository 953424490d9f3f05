"""Dates, cut-offs and the recency filter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cutoff_date(as_of: Column, years: Column) -> Column:
    """``as_of`` so many calendar years ago (29 February becomes the 28th); null years give no cut-off."""
    return F.add_months(as_of, -12 * years.cast("int"))


def whole_months(start: Column, end: Column) -> Column:
    """Difference of calendar months, whatever the days; null if an end is missing or before the start."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return F.when(months >= 0, months.cast("long"))


def year_start(year: Column) -> Column:
    return F.make_date(year.cast("int"), F.lit(1), F.lit(1))


def recent(cutoff: Column | None, strict: bool = False, failure: str = "failure_date", founding: str = "founding_date", failure_unknown: str = "failure_unknown", founding_unknown: str = "founding_unknown") -> Column:
    """Failed since the cut-off; unless strict also: founded since then with an unknown end, or both unknown.  A null cut-off keeps all."""
    if cutoff is None:
        return F.lit(True)
    known = ~F.col(failure_unknown) & (F.col(failure) >= cutoff)
    if strict:
        return F.coalesce(cutoff.isNull() | known, F.lit(False))
    young = F.col(failure_unknown) & ~F.col(founding_unknown) & (F.col(founding) >= cutoff)
    neither = F.col(failure_unknown) & F.col(founding_unknown)
    return F.coalesce(cutoff.isNull() | F.coalesce(known, F.lit(False)) | F.coalesce(young, F.lit(False)) | neither, F.lit(False))
