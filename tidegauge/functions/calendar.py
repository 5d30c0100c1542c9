"""Calendar fields of a timestamp column, plain and scaled to [-0.5, 0.5]."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unit(value: Column, top: float) -> Column:
    return value / F.lit(top) - 0.5


def second_of_minute(ts: Column) -> Column:
    return _unit(F.second(ts), 59.0)


def minute_of_hour(ts: Column) -> Column:
    return _unit(F.minute(ts), 59.0)


def hour_of_day(ts: Column) -> Column:
    return _unit(F.hour(ts), 23.0)


def day_of_week(ts: Column) -> Column:
    return _unit(F.weekday(ts), 6.0)


def day_of_month(ts: Column) -> Column:
    return _unit(F.dayofmonth(ts) - 1, 30.0)


def day_of_year(ts: Column) -> Column:
    return _unit(F.dayofyear(ts) - 1, 365.0)


def month_of_year(ts: Column) -> Column:
    return _unit(F.month(ts) - 1, 11.0)


def week_of_year(ts: Column) -> Column:
    return _unit(F.weekofyear(ts) - 1, 52.0)


_DAY = [day_of_week, day_of_month, day_of_year]
_HOUR = [hour_of_day, *_DAY]
_MINUTE = [minute_of_hour, *_HOUR]
_SECOND = [second_of_minute, *_MINUTE]
# Fields used for each frequency letter.
FIELDS = {
    "Y": [], "YE": [], "A": [],
    "Q": [month_of_year], "QE": [month_of_year],
    "M": [month_of_year], "ME": [month_of_year],
    "W": [day_of_month, week_of_year],
    "D": _DAY, "B": _DAY,
    "H": _HOUR, "h": _HOUR,
    "T": _MINUTE, "min": _MINUTE,
    "S": _SECOND, "s": _SECOND,
}


def fields_for(freq: str, ts: Column) -> dict[str, Column]:
    """Scaled fields for a frequency such as ``h``, ``15min`` or ``1D``."""
    unit = re.sub(r"^\d+", "", freq).split("-")[0]
    if unit not in FIELDS:
        raise ValueError(f"unsupported frequency {freq!r}")
    return {f.__name__: f(ts) for f in FIELDS[unit]}


def plain_fields(ts: Column, quarter_hours: bool = False) -> dict[str, Column]:
    """Month, day, weekday (Monday is 0), hour and optionally the quarter of the hour."""
    out = {"month": F.month(ts), "day": F.dayofmonth(ts), "weekday": F.weekday(ts), "hour": F.hour(ts)}
    if quarter_hours:
        out["minute"] = F.floor(F.minute(ts) / 15).cast("int")
    return out


_STEP = {"s": "SECOND", "S": "SECOND", "min": "MINUTE", "T": "MINUTE", "h": "HOUR", "H": "HOUR",
         "D": "DAY", "W": "WEEK", "M": "MONTH", "Y": "YEAR"}


def future_timestamps(last: str, freq: str, steps: int) -> Column:
    """``steps`` timestamps after column ``last``, one ``freq`` apart."""
    m = re.fullmatch(r"(\d*)([A-Za-z]+)", freq)
    if not m or m.group(2) not in _STEP:
        raise ValueError(f"unsupported frequency {freq!r}")
    each, unit = int(m.group(1) or 1), _STEP[m.group(2)]
    return F.expr(
        f"transform(sequence(1, {steps}), i -> `{last}` + i * make_interval("
        + {"YEAR": "{}", "MONTH": "0,{}", "WEEK": "0,0,{}", "DAY": "0,0,0,{}", "HOUR": "0,0,0,0,{}",
           "MINUTE": "0,0,0,0,0,{}", "SECOND": "0,0,0,0,0,0,{}"}[unit].format(each)
        + "))"
    )
