"""Column functions of single rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import COMPARATIVE_GAP_DAYS, SCALE_LOG_TOLERANCE


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where the whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def blank(c: Column) -> Column:
    """Null, or nothing but white space."""
    return c.isNull() | (F.regexp_replace(c, r"\s", "") == "")


def relative_delta(old: Column, new: Column) -> Column:
    return F.abs(new - old) / F.greatest(F.abs(old), F.abs(new), F.lit(1.0))


def magnitude(first: Column, final: Column) -> Column:
    return F.abs(final - first) / F.greatest(F.abs(first), F.lit(1.0))


def scale_exponent(old: Column, new: Column) -> Column:
    """k where new is old times 10**k but for rounding, k not 0; else null, as for exponents that no byte holds."""
    times = F.try_divide(new, old)
    log = F.log10(F.when((times > 0) & (times < float("inf")), times))
    k = F.round(log)
    fits = (F.abs(log - k) < SCALE_LOG_TOLERANCE) & (k != 0) & k.between(-128, 127)
    return F.when(fits, k).cast("tinyint")


def is_amendment(form: Column) -> Column:
    return form.endswith("/A")


def first_is_comparative(ddate: Column, period_first: Column) -> Column:
    """The fact was first seen as a comparative column: it ended well before the period of its first filing."""
    return F.coalesce(ddate < F.date_sub(period_first, COMPARATIVE_GAP_DAYS), F.lit(False))


def month_end(day: Column) -> Column:
    """From the 15th on the end of the month, before it the end of the month before."""
    return F.when(F.dayofmonth(day) >= 15, F.last_day(day)).otherwise(F.last_day(F.add_months(day, -1)))


def qtrs_between(start: Column, end: Column) -> Column:
    """Quarters from start to end: 0 without a start, else the months over 3, rounded, 1 at least."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return F.when(start.isNull(), 0).otherwise(F.greatest(F.lit(1), F.round(months / 3).cast("int"))).cast("int")


def lag_bin(days: Column, edges: tuple[int, ...], labels: tuple[str, ...]) -> Column:
    """The label of the left-closed bin that holds the days; anything under the first edge is in the first bin."""
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels))):
        out = F.when(days < edge, label).otherwise(out)
    return F.when(days.isNotNull(), out)
