"""Event, calendar and cyclic columns (builders D4, D5, D8)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Period of each calendar column for its sin/cos encoding.
CYCLE_PERIODS = {
    "TimeOfDay": 24.0,
    "DayOfWeek": 7.0,
    "DayOfMonth": 31.0,
    "DayOfQuarter": 92.0,
    "DayOfYear": 366.0,
    "Quarter": 4.0,
}
# Price of one unit of `value` in USD for the test log.
PRICE_IN_USD = 1.0
# ---------------------------------------------------------------------------

EVENT_COLUMNS = ["amount", "amountUSD", "logAmount", "logAmountUSD", "priceInUSD"]
CALENDAR_COLUMNS = ["timeOfDay", "dayOfWeek", "dayOfMonth", "dayOfQuarter", "dayOfYear", "quarter"]
CYCLIC_COLUMNS = [f"{fn}{name}" for name in CYCLE_PERIODS for fn in ("sin", "cos")]


def event_columns(value: Column) -> list[Column]:
    usd = value * F.lit(PRICE_IN_USD)
    return [
        value.alias("amount"),
        usd.alias("amountUSD"),
        F.log1p(value).alias("logAmount"),
        F.log1p(usd).alias("logAmountUSD"),
        F.lit(PRICE_IN_USD).alias("priceInUSD"),
    ]


def calendar_values(ts: Column) -> dict[str, Column]:
    """Calendar parts as doubles; dayOfWeek is 0 = Monday ... 6 = Sunday."""
    d = F.to_date(ts)
    return {
        "timeOfDay": (F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0).cast("double"),
        "dayOfWeek": F.weekday(ts).cast("double"),
        "dayOfMonth": F.dayofmonth(ts).cast("double"),
        "dayOfQuarter": (F.datediff(d, F.trunc(d, "quarter")) + 1).cast("double"),
        "dayOfYear": F.dayofyear(ts).cast("double"),
        "quarter": F.quarter(ts).cast("double"),
    }


def calendar_columns(ts: Column) -> list[Column]:
    vals = calendar_values(ts)
    out = [vals[c].alias(c) for c in CALENDAR_COLUMNS]
    lower = {"TimeOfDay": "timeOfDay", "DayOfWeek": "dayOfWeek", "DayOfMonth": "dayOfMonth",
             "DayOfQuarter": "dayOfQuarter", "DayOfYear": "dayOfYear", "Quarter": "quarter"}
    for name, period in CYCLE_PERIODS.items():
        angle = vals[lower[name]] * F.lit(2.0 * math.pi / period)
        out.append(F.sin(angle).alias(f"sin{name}"))
        out.append(F.cos(angle).alias(f"cos{name}"))
    out.append((F.weekday(ts) >= 5).alias("isWeekend"))
    return out


def category_column(props: Column) -> Column:
    """The one categorical column: key ``k`` of the JSON ``props``."""
    return F.get_json_object(props, "$.k").alias("category")
