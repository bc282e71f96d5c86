"""Time parsing and calendar expressions (T1-T4, weekday/month names)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The one timestamp format the release endpoints accept,
# and the calendar names used by the insights (English locale).
STRICT_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_time(c, strict: bool = False) -> Column:
    """T1/T2. Text -> TIMESTAMP; unparsable text -> NULL (never raises).

    Lenient mode accepts anything Spark's default cast understands
    (ISO dates and timestamps, with or without a trailing ``Z``). Strict
    mode accepts exactly ``yyyy-MM-ddTHH:mm:ssZ``. Non-string inputs
    (already dates/timestamps) are passed through.
    """
    c = _c(c)
    if strict:
        return F.try_to_timestamp(c, F.lit(STRICT_FORMAT))
    return F.coalesce(F.try_to_timestamp(c, F.lit(STRICT_FORMAT)), F.try_to_timestamp(c))


def to_day(c) -> Column:
    """T4: calendar day of a date/timestamp column (or ISO text)."""
    return _c(c).cast("date")


def to_day_text(c) -> Column:
    """T4 on raw text: the first ten characters as a date, NULL if invalid."""
    return F.try_to_date(F.substring(_c(c), 1, 10), "yyyy-MM-dd")


def to_month(c) -> Column:
    """Month-start DATE of a date/timestamp column."""
    return F.trunc(_c(c).cast("date"), "MM")


def month_text(c) -> Column:
    """'YYYY-MM' text of a date/timestamp, as the month-count maps use."""
    return F.date_format(_c(c).cast("date"), "yyyy-MM")


def weekday_name(c) -> Column:
    return F.date_format(_c(c).cast("date"), "EEEE")


def weekday_pos(c) -> Column:
    """0 = Monday ... 6 = Sunday (ISO order), for deterministic tie-breaks."""
    return F.pmod(F.dayofweek(_c(c).cast("date")) + F.lit(5), F.lit(7))


def month_name(c) -> Column:
    return F.date_format(_c(c).cast("date"), "MMMM")
