"""Rolling one-month fetch windows (S4) and records inside them."""

from __future__ import annotations

import calendar
import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import positional_index
from ..operators.clean import dedupe_records

# Twelve windows of one month; one search page shows 100.
N_WINDOWS = 12
PAGE_ROWS = 100


def add_months(d: _dt.date, k: int) -> _dt.date:
    """Calendar month shift that clamps the day (same rule as Spark's
    ``add_months`` and a one-month relative delta)."""
    m = d.month - 1 + k
    y, m = d.year + m // 12, m % 12 + 1
    return _dt.date(y, m, min(d.day, calendar.monthrange(y, m)[1]))


def window_bounds(as_of: _dt.date, n: int = N_WINDOWS) -> list[tuple[int, _dt.date, _dt.date]]:
    """Each window starts one month before the previous window's start
    (so a 31st as_of drifts: 31 Mar -> 28 Feb -> 28 Jan, defect D19)."""
    out, hi = [], as_of
    for i in range(1, n + 1):
        lo = add_months(hi, -1)
        out.append((i, lo, hi))
        hi = lo
    return out


def month_windows(spark: SparkSession, as_of: _dt.date, n: int = N_WINDOWS) -> DataFrame:
    """(window_idx, lo, hi). Window 1 is the most recent."""
    return spark.createDataFrame(window_bounds(as_of, n), "window_idx INT, lo DATE, hi DATE")


def records_in_windows(df: DataFrame, as_of: _dt.date, time_col: str = "created_at",
                       n: int = N_WINDOWS, key: str = "issue_number", fetched: str | None = None) -> DataFrame:
    """S5 + J2: records whose day falls in a window, tagged with its index.

    Windows are half-open ``(lo, hi]`` except the oldest, ``[lo, hi]``, so a
    boundary-day record is counted once (defect D4 fixed). The overall
    range is applied first as a literal filter on the bare column (pushed
    to the scan); the window index is then a CASE over the 12 sorted
    bounds (the range join of records and windows, without a join).
    ``fetched`` names a fetch-order column: the last fetched copy of a
    repeated (repo, key) record stays (P13).
    """
    b = window_bounds(as_of, n)
    lo_all, hi_all = b[-1][1], b[0][2]
    day = F.col(time_col).cast("date")
    pre = df.where((F.col(time_col) >= F.lit(lo_all)) & (F.col(time_col) < F.lit(hi_all + _dt.timedelta(days=1))))
    if fetched is not None:
        # P13 after the range filter, so the filter still reaches the scan
        pre = dedupe_records(pre, ["repo", key], fetched)
    # J2 as a lookup: windows are contiguous and sorted, so the range join
    # against the window table reduces to the first window whose start lies
    # before the day -- a CASE over the bounds, no join and no nested loop
    idx = None
    for i, lo, _hi in b:
        cond = (day >= F.lit(lo)) if i == n else (day > F.lit(lo))
        idx = F.when(cond, F.lit(i)) if idx is None else idx.when(cond, F.lit(i))
    out = pre.withColumn("window_idx", idx).where(F.col("window_idx").isNotNull() & (day <= F.lit(hi_all)))
    return out


def paged(windowed: DataFrame, time_col: str = "created_at", key: str = "issue_number",
          page_rows: int = PAGE_ROWS) -> DataFrame:
    """O3: every record of ``records_in_windows`` with its rank by (day, key)
    in its (repo, window), from 1, and the page it would be shown on.

    Nothing is dropped (a one-page fetch loses what comes later, D5). The
    rank is the skew-safe distributed one, so a hot window spans tasks.
    """
    pos = positional_index(windowed, ["repo", "window_idx"], [(time_col, False), (key, False)], out="rank_in_window")
    rank = F.col("rank_in_window") + 1
    return pos.drop("group_rows").withColumn("rank_in_window", rank) \
        .withColumn("page", F.ceil(F.col("rank_in_window") / F.lit(page_rows)).cast("long"))
