"""The metric x model matrix as data: time column, value, grain, gap rule,
minimum-data gates and the estimator that fills each of the reference's
three model slots ('lstm', 'prophet', 'statsmodels')."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Gate:
    min_records: int = 1    # rows of the entity, after cleaning
    min_points: int = 0     # series points (months / days)


@dataclass(frozen=True)
class Slot:
    estimator: str
    gate: Gate


@dataclass(frozen=True)
class Metric:
    entity: str
    time_col: str | None     # None -> synthetic timeline (T8)
    value: str               # 'count', 'sum_number', 'sum_contributions'
    grain: str               # 'day' or 'month'
    fill: bool               # zero-fill the grid before fitting
    slots: dict


# Gates per (metric, slot) as the reference enforces them.
METRICS: dict[str, Metric] = {
    "issues": Metric("issues", "created_at", "count", "day", True, {
        "lstm": Slot("lookback", Gate(1, 0)),
        "prophet": Slot("additive", Gate(1, 0)),
        "statsmodels": Slot("auto_order", Gate(1, 0)),
    }),
    "pulls": Metric("pulls", "created_at", "count", "month", False, {
        "lstm": Slot("index_trend", Gate(1, 0)),
        "prophet": Slot("additive", Gate(1, 0)),
        "statsmodels": Slot("smoothing", Gate(1, 6)),
    }),
    "commits": Metric("commits", "date", "count", "month", False, {
        "lstm": Slot("index_trend", Gate(1, 0)),
        "prophet": Slot("additive", Gate(1, 0)),
        "statsmodels": Slot("ar5", Gate(1, 12)),
    }),
    "branches": Metric("branches", None, "count", "month", True, {
        "lstm": Slot("index_trend", Gate(1, 0)),
        "prophet": Slot("additive", Gate(1, 0)),
        "statsmodels": Slot("ar5", Gate(1, 11)),  # no reference gate; AR(5) on differences needs 11
    }),
    "contributors": Metric("contributors", None, "sum_contributions", "month", False, {
        "lstm": Slot("index_trend", Gate(1, 0)),
        "prophet": Slot("additive", Gate(1, 0)),
        "statsmodels": Slot("arma", Gate(1, 6)),
    }),
    "releases": Metric("releases", "published_at", "count", "month", True, {
        "lstm": Slot("index_trend", Gate(1, 0)),
        "prophet": Slot("additive", Gate(2, 0)),
        "statsmodels": Slot("arma", Gate(3, 0)),
    }),
}
