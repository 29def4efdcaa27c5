"""History builders over the event log (D1 next outcomes, D2/D3 histories,
D6 active days, D7 recency).

Everything is a windowed scan ordered by time.  A plain ``Window.partitionBy
(user)`` would put a user that owns a third of the log into one task, and a
market-wide running sum would put the whole log into one task.  Both scans
are therefore two-level:

* the events are cut once into ranges of time with about as many rows each, the
  running value is computed inside each range (market) or inside each user, the
  few users that fill whole tasks being cut by the same ranges, and
* a small table with one row per range (and cut user) carries the totals of
  all earlier (or later) ranges, which are added back with a join.

Rows travel narrow: only counts, sums and times go through the scans and into
the written table, everything that follows from them (averages, logs, calendar)
is an expression on reading.

All frames are RANGE frames on the microsecond time, so "earlier" and
"later" are strict even when two events share a timestamp.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventsurv.functions.calendar import calendar_columns, category_column, event_columns
from eventsurv.sources.events import HISTORY_ACTIONS, OUTCOME_ACTIONS, action_col
from eventsurv.sources.materialize import materialize

DAY_US = 86_400_000_000
SECOND_US = 1_000_000
AMOUNT_DECIMAL = "decimal(18,6)"
STATS = ["Count", "Sum", "SumUSD", "AvgAmount", "AvgAmountUSD"]
ACTIONS = list(HISTORY_ACTIONS)          # Borrow Deposit Repay Withdraw Liquidated


def history_columns(prefix: str) -> list[str]:
    return [f"{prefix}{HISTORY_ACTIONS[a]}{s}" for a in ACTIONS for s in STATS]


USER_HISTORY_COLUMNS = history_columns("user")
MARKET_HISTORY_COLUMNS = history_columns("market")
ACTIVITY_COLUMNS = ["userActiveDaysWeekly", "userActiveDaysMonthly", "userActiveDaysYearly",
                    "userSecondsSinceFirstTransaction", "userSecondsSincePreviousTransaction"]
ACTIVE_DAY_WINDOWS = {"userActiveDaysWeekly": 7, "userActiveDaysMonthly": 30, "userActiveDaysYearly": 365}
NEXT_COLUMNS = {o: f"next_{o}_us" for o in OUTCOME_ACTIONS}
#: a user is cut by the time ranges if it holds more rows than this many partitions should
HOT_PARTITIONS = 4


def _is(a: str) -> Column:
    return F.col("action") == F.lit(a)


def _amount() -> Column:
    """Amounts are summed as decimals: exact, so the result does not depend
    on the order in which partitions and buckets are added."""
    return F.col("value").cast(AMOUNT_DECIMAL)


def _state_columns(prefix: str) -> list[str]:
    """What the scans leave per action: the count and the sum."""
    return [f"{prefix}{HISTORY_ACTIONS[a]}{s}" for a in ACTIONS for s in ("Count", "Sum")]


USER_STATE, MARKET_STATE = _state_columns("user"), _state_columns("market")


def _states(prefix: str, cnt: dict[str, Column], tot: dict[str, Column]) -> list[Column]:
    out = []
    for a in ACTIONS:
        name = f"{prefix}{HISTORY_ACTIONS[a]}"
        out += [cnt[a].alias(f"{name}Count"), tot[a].alias(f"{name}Sum")]
    return out


def _stat_columns(prefix: str) -> list[Column]:
    """The history columns from the counts and sums."""
    out = []
    for a in ACTIONS:
        name = f"{prefix}{HISTORY_ACTIONS[a]}"
        c, s = F.col(f"{name}Count"), F.col(f"{name}Sum")
        avg = F.try_divide(s, c.cast("double"))
        out += [c.alias(f"{name}Count"), s.alias(f"{name}Sum"), s.alias(f"{name}SumUSD"),
                avg.alias(f"{name}AvgAmount"), avg.alias(f"{name}AvgAmountUSD")]
    return out


def _partitions(ev: DataFrame, partitions: int | None) -> int:
    return partitions or int(ev.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ranged(ev: DataFrame, order: list[str], name: str, partitions: int | None) -> DataFrame:
    """``ev`` in ranges of ``order``, with the range's number ``_pid``; written
    once, so that a recompute cannot move rows."""
    n = _partitions(ev, partitions)
    return materialize(ev.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()), name)


# ---------------------------------------------------------------------------
# per-user scan: D1 next outcome, D2 user history, D6 active days, D7 recency
# ---------------------------------------------------------------------------

def _user_states(rows: DataFrame, ranged: DataFrame, n: int) -> DataFrame:
    """Adds the user counts and sums, activity and next-outcome times to ``rows``
    (those of ``ranged``, perhaps with more columns).

    One shuffle by user.  A user with more rows than ``HOT_PARTITIONS`` of ``n``
    partitions should hold is cut by the time ranges ``_pid``; there are at most
    ``n / HOT_PARTITIONS`` of them, so their names, the totals of their ranges and
    their distinct days are broadcast with that bound.
    """
    limit = max(HOT_PARTITIONS * ranged.count() // n, 1)
    ranged = ranged.where(F.col("user_id").isNotNull())
    hot = ranged.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select("user_id")
    day = F.expr(f"ts_us div {DAY_US}")
    ev = (rows.where(F.col("user_id").isNotNull()).withColumn("day", day)
          .join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "user_id", "left")
          .withColumn("_ur", F.when(F.col("_hot"), F.col("_pid")).otherwise(F.lit(-1))).drop("_hot"))
    part = ["user_id", "_ur"]
    by_time = Window.partitionBy(*part).orderBy("ts_us")
    w_pre = by_time.rangeBetween(Window.unboundedPreceding, -1)
    # "Later" rows use a reversed order with an unbounded-preceding frame: it
    # grows in O(n), where an unbounded-following frame is redone per row.
    w_suf = Window.partitionBy(*part).orderBy(F.col("ts_us").desc()).rangeBetween(Window.unboundedPreceding, -1)
    # distinct earlier days up to a lag: the first row of each day counts, frames grow in O(n)
    last_day = F.lag("day").over(by_time)
    by_day = Window.partitionBy(*part).orderBy("day")
    lags = [1, *[k + 1 for k in ACTIVE_DAY_WINDOWS.values()]]

    inner = ev.select(
        "*",
        *[F.count(F.when(_is(a), 1)).over(w_pre).alias(f"_ci_{a}") for a in ACTIONS],
        *[F.sum(F.when(_is(a), _amount())).over(w_pre).alias(f"_si_{a}") for a in ACTIONS],
        F.min("ts_us").over(w_pre).alias("_first_in"),
        F.max("ts_us").over(w_pre).alias("_prev_in"),
        F.when(last_day.isNull() | (last_day != F.col("day")), 1).otherwise(0).alias("_new_day"),
    )
    inner = inner.select("*", *[F.sum("_new_day").over(by_day.rangeBetween(Window.unboundedPreceding, -k)).alias(f"_days_{k}") for k in lags])
    inner = inner.select("*", *[F.min(F.when(_is(o), F.col("ts_us"))).over(w_suf).alias(f"_ni_{o}") for o in OUTCOME_ACTIONS])

    # one row per cut user and range
    cut = ranged.join(F.broadcast(hot), "user_id", "left_semi")
    totals = cut.groupBy("user_id", F.col("_pid").alias("_ur")).agg(
        *[F.count(F.when(_is(a), 1)).alias(f"_c_{a}") for a in ACTIONS],
        *[F.sum(F.when(_is(a), _amount())).alias(f"_s_{a}") for a in ACTIONS],
        F.min("ts_us").alias("_mn"),
        F.max("ts_us").alias("_mx"),
        *[F.min(F.when(_is(o), F.col("ts_us"))).alias(f"_n_{o}") for o in OUTCOME_ACTIONS],
    )
    wb_pre = Window.partitionBy("user_id").orderBy("_ur").rowsBetween(Window.unboundedPreceding, -1)
    wb_suf = Window.partitionBy("user_id").orderBy(F.col("_ur").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *part,
        *[F.sum(f"_c_{a}").over(wb_pre).alias(f"_cc_{a}") for a in ACTIONS],
        *[F.sum(f"_s_{a}").over(wb_pre).alias(f"_cs_{a}") for a in ACTIONS],
        F.min("_mn").over(wb_pre).alias("_first_c"),
        F.max("_mx").over(wb_pre).alias("_prev_c"),
        *[F.min(f"_n_{o}").over(wb_suf).alias(f"_nc_{o}") for o in OUTCOME_ACTIONS],
    )
    days = cut.select("user_id", day.alias("day")).distinct().select(
        "user_id", "day",
        *[F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("day").rangeBetween(-k, -1)).alias(f"_cut_{name}")
          for name, k in ACTIVE_DAY_WINDOWS.items()])
    j = inner.join(F.broadcast(carry), part, "left").join(F.broadcast(days), ["user_id", "day"], "left")
    # events without a time have no day and no row of their own
    j = j.where(F.col("day").isNotNull())

    cnt = {a: (F.col(f"_ci_{a}") + F.coalesce(F.col(f"_cc_{a}"), F.lit(0))).cast("bigint") for a in ACTIONS}
    tot = {a: (F.coalesce(F.col(f"_si_{a}"), F.lit(0)) + F.coalesce(F.col(f"_cs_{a}"), F.lit(0))).cast("double")
           for a in ACTIONS}
    earlier = {k: F.coalesce(F.col(f"_days_{k}"), F.lit(0)) for k in lags}
    first = F.coalesce(F.col("_first_c"), F.col("_first_in"))
    prev = F.coalesce(F.col("_prev_in"), F.col("_prev_c"))
    return j.select(
        *[c for c in rows.columns if c not in ("_pid", "day")], "day",
        *_states("user", cnt, tot),
        *[F.coalesce(F.col(f"_cut_{name}"), earlier[1] - earlier[k + 1]).cast("bigint").alias(name)
          for name, k in ACTIVE_DAY_WINDOWS.items()],
        ((F.col("ts_us") - first) / F.lit(SECOND_US)).cast("bigint").alias("userSecondsSinceFirstTransaction"),
        ((F.col("ts_us") - prev) / F.lit(SECOND_US)).cast("bigint").alias("userSecondsSincePreviousTransaction"),
        *[F.coalesce(F.col(f"_ni_{o}"), F.col(f"_nc_{o}")).alias(NEXT_COLUMNS[o]) for o in OUTCOME_ACTIONS],
    )


def user_scan(ev: DataFrame, partitions: int | None = None) -> DataFrame:
    """Adds user history, activity and next-outcome times to every event.

    Input needs ``user_id, ts_us, action, value``.  A user of any size, a user-day
    or a burst is spread by time.
    """
    ranged = _ranged(ev, ["ts_us"], "time-ranges", partitions)
    u = _user_states(ranged, ranged, _partitions(ev, partitions))
    return u.select(*[c for c in ev.columns if c != "day"], "day", *_stat_columns("user"), *ACTIVITY_COLUMNS, *NEXT_COLUMNS.values())


# ---------------------------------------------------------------------------
# market-wide scan: D3
# ---------------------------------------------------------------------------

def _market_states(ev: DataFrame) -> DataFrame:
    """Adds the market counts and sums to the rows of ``_ranged``.

    A prefix scan over ranges of time: running counts inside a range come from
    a RANGE window, the totals of earlier ranges are carries (one row a range).
    Ranges follow the rows, so a burst is cut finer than a quiet month.
    """
    w = Window.partitionBy("_pid").orderBy("ts_us").rangeBetween(Window.unboundedPreceding, -1)
    inner = ev.select(
        "*",
        *[F.count(F.when(_is(a), 1)).over(w).alias(f"_mci_{a}") for a in ACTIONS],
        *[F.sum(F.when(_is(a), _amount())).over(w).alias(f"_msi_{a}") for a in ACTIONS],
    )
    totals = ev.groupBy("_pid").agg(
        *[F.count(F.when(_is(a), 1)).alias(f"_mc_{a}") for a in ACTIONS],
        *[F.sum(F.when(_is(a), _amount())).alias(f"_ms_{a}") for a in ACTIONS],
    )
    # one row a range: a single ordered pass is fine
    wb = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        "_pid",
        *[F.sum(f"_mc_{a}").over(wb).alias(f"_mcc_{a}") for a in ACTIONS],
        *[F.sum(f"_ms_{a}").over(wb).alias(f"_mcs_{a}") for a in ACTIONS],
    )
    j = inner.join(F.broadcast(carry), "_pid", "inner")
    cnt = {a: (F.col(f"_mci_{a}") + F.coalesce(F.col(f"_mcc_{a}"), F.lit(0))).cast("bigint") for a in ACTIONS}
    tot = {a: (F.coalesce(F.col(f"_msi_{a}"), F.lit(0)) + F.coalesce(F.col(f"_mcs_{a}"), F.lit(0))).cast("double")
           for a in ACTIONS}
    return j.select(*ev.columns, *_states("market", cnt, tot))


def market_scan(ev: DataFrame, partitions: int | None = None) -> DataFrame:
    """Adds market history (all users, strictly earlier timestamps)."""
    return _market_states(_ranged(ev, ["ts_us"], "time-ranges", partitions)).select(*ev.columns, *_stat_columns("market"))


# ---------------------------------------------------------------------------
# the full per-event feature row
# ---------------------------------------------------------------------------

BASE_NUMERIC = (["amount", "amountUSD", "logAmount", "logAmountUSD", "priceInUSD",
                 "timeOfDay", "dayOfWeek", "dayOfMonth", "dayOfQuarter", "dayOfYear", "quarter",
                 "sinTimeOfDay", "cosTimeOfDay", "sinDayOfWeek", "cosDayOfWeek",
                 "sinDayOfMonth", "cosDayOfMonth", "sinDayOfQuarter", "cosDayOfQuarter",
                 "sinDayOfYear", "cosDayOfYear", "sinQuarter", "cosQuarter"]
                + USER_HISTORY_COLUMNS + MARKET_HISTORY_COLUMNS + ACTIVITY_COLUMNS)
FEATURE_COLUMNS = BASE_NUMERIC + ["isWeekend", "category"]


def event_states(ev: DataFrame, partitions: int | None = None) -> DataFrame:
    """Every event with the counts, sums and times of both scans: the narrow
    table that is written; ``with_features`` gives the columns it stands for."""
    base = ev.select("event_id", "ts", "ts_us", "user_id", "event_type", "action", "value", category_column(F.col("props")))
    ranged = _ranged(base, ["ts_us"], "time-ranges", partitions)
    u = _user_states(_market_states(ranged), ranged, _partitions(ev, partitions))
    return u.select("event_id", "ts", "user_id", "event_type", "value", "category", *USER_STATE, *MARKET_STATE, *ACTIVITY_COLUMNS, *NEXT_COLUMNS.values())


#: what a row must carry for ``from_state``
STATE_COLUMNS = ["ts", "amount", *USER_STATE, *MARKET_STATE, *ACTIVITY_COLUMNS]


def _feature_columns(value: Column) -> list:
    return [*event_columns(value), *calendar_columns(F.col("ts")), *_stat_columns("user"), *_stat_columns("market"), *ACTIVITY_COLUMNS]


def with_features(states: DataFrame) -> DataFrame:
    """The feature columns of ``event_states``."""
    return states.select(
        "event_id", "ts", F.unix_micros("ts").alias("ts_us"), "user_id", "event_type", action_col(F.col("event_type")).alias("action"),
        *_feature_columns(F.col("value")),
        "category",
        *NEXT_COLUMNS.values(),
    )


def from_state(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the feature columns (without the category) of rows that carry only ``STATE_COLUMNS``, which is what moves."""
    return rows.select(*keep, *_feature_columns(F.col("amount")))


def event_features(ev: DataFrame) -> DataFrame:
    """Every event with the 78 numeric columns, ``isWeekend``, ``category``
    and the next time of each outcome action (microseconds, null if none)."""
    return with_features(event_states(ev))
