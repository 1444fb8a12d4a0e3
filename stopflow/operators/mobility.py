"""User-month mobility metrics: each is one aggregate Column over the shared frame of steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar
from ..functions.geo import great_circle
from ..sources.stops import KEYS
from .steps import steps

#: Gaps of this many seconds and more are no travel.
LONGEST_GAP = 12 * 3600
#: A travelled distance below this many kilometres counts as none.
SHORTEST_KM = 0.1


def _moves() -> Column:
    return F.col("prev_loc").isNotNull() & (F.col("prev_loc") != F.col("loc"))


def _cost() -> Column:
    total = F.round(F.sum(F.when(_moves(), F.col("km"))), 5)
    return F.when(total < SHORTEST_KM, F.lit(0.0)).otherwise(total)


def _gap() -> Column:
    gap = F.col("start") - F.col("prev_end")
    return F.when((gap >= 0) & (gap < LONGEST_GAP), gap)


def metrics() -> dict[str, Column]:
    """Metric name -> aggregate over steps()."""
    stay = F.sum(F.col("end") - F.col("start"))
    return {
        "visits": F.count("loc"),
        "locations": F.count_distinct("loc"),
        "total_stay_time": stay.cast("long"),
        "coverage_stay_time": F.round(stay / (86400.0 * F.max(calendar.days_in_month(F.col("start")))), 6),
        "total_travel_time": F.coalesce(F.sum(_gap()), F.lit(0)).cast("long"),
        "total_cost_travel_distance": _cost(),
    }


#: Metrics that need the previous stop, and whether they need distances.
_OF_STEPS = {"total_travel_time": False, "total_cost_travel_distance": True}


def mobility(stops: DataFrame, keys: list[str] = KEYS, names: list[str] | None = None) -> DataFrame:
    """A row for each key with the metrics named, all by default; KeyError for an unknown name.

    Stops may be steps() already; otherwise steps are taken only where a metric needs them.
    """
    known = metrics()
    wanted = {n: known[n] for n in names or known}
    stepped = [_OF_STEPS[n] for n in wanted if n in _OF_STEPS]
    rows = steps(stops, keys, any(stepped)) if stepped else stops
    return rows.groupBy(*keys).agg(*(of.alias(n) for n, of in wanted.items()))


def home_rewards(stops: DataFrame, anchor: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Distances of stops away from home: their sum and maximum, and twice both as rewards; has_home.

    anchor: keys, home_loc, home_lat, home_lon, as of anchors.labelled_home(). A stop that follows one at the same
    place does not count again.
    """
    moved = steps(stops, keys, distances=False)
    home = anchor.select(*keys, "home_loc", "home_lat", "home_lon")
    km = great_circle(F.col("latitude"), F.col("longitude"), F.col("home_lat"), F.col("home_lon"))
    away = (F.col("loc") != F.col("home_loc")) & (F.col("prev_loc").isNull() | (F.col("prev_loc") != F.col("loc")))
    far = F.when(away, km)
    return (
        moved.join(home, keys, "left")
        .groupBy(*keys)
        .agg(
            F.max(F.col("home_loc").isNotNull().cast("int")).alias("has_home"),
            F.round(F.sum(far), 5).alias("sum_home_distance"),
            F.round(F.max(far), 5).alias("max_home_distance"),
            F.round(2 * F.sum(far), 5).alias("total_reward_home_distance"),
            F.round(2 * F.max(far), 5).alias("max_reward_home_distance"),
        )
    )


def efficiency(cost: Column, reward: Column) -> Column:
    """1 - log10(cost) / log10(reward), where 0 < cost <= reward and reward is not 1; else null."""
    good = (reward > 0) & (cost > 0) & (reward >= cost) & (reward != 1)
    return F.when(good, 1 - F.try_divide(F.log10(cost), F.log10(reward)))


def with_efficiency(rows: DataFrame) -> DataFrame:
    value = efficiency(F.col("total_cost_travel_distance"), F.col("total_reward_home_distance"))
    return rows.withColumn("tour_efficiency_dist", F.round(value, 6))
