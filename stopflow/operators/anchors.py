"""Home and work anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar
from ..sources.stops import KEYS

#: Hours after midnight that count as night.
NIGHT_HOURS = 6


def night_home(stops: DataFrame, keys: list[str] = KEYS, share: float = 0.2, hours: int = NIGHT_HOURS) -> DataFrame:
    """keys, home_loc, night_share: the location of most time at night, ties to the smaller, if its share suffices."""
    night = calendar.daily_overlap(F.col("start"), F.col("end"), hours)
    spent = stops.groupBy(*keys, "loc").agg(F.sum(night).alias("night"))
    all_ = Window.partitionBy(*keys)
    first = F.row_number().over(all_.orderBy(F.col("night").desc(), "loc"))
    return (
        spent.withColumns({"total": F.sum("night").over(all_), "first": first})
        .filter((F.col("first") == 1) & (F.col("total") > 0) & (F.col("night") >= F.col("total") * share))
        .select(*keys, F.col("loc").alias("home_loc"), F.round(F.col("night") / F.col("total"), 6).alias("night_share"))
    )


def label_home_work(
    stops: DataFrame,
    *,
    home_days: int = 28,
    work_days: int = 42,
    coverage: float = 0.4,
    home_valid: float = 0.4,
    work_valid: float = 0.5,
    home_share: float = 0.7,
    work_share: float = 0.4,
    work_presence: float = 0.6,
    min_stop: int = 60,
    night: tuple[int, int] = (0, 6),
    office: tuple[int, int] = (8, 18),
    past_only: bool = False,
) -> DataFrame:
    """Stops with detect_H_loc, detect_W_loc and location_type H, W or O, by day.

    Stays under min_stop seconds are left out. Each stay is cut into local days; a day counts for home when
    its night hours, for work when its office hours on weekdays, are observed for the share `coverage`. Over a
    window of days around each day (before it, with past_only), enough days must count; home is then the place
    of the largest mean share of night time, if at least home_share, work the place of the largest mean share
    of office time, if at least work_share, present on the share work_presence of the days, and not home.
    """
    day = calendar.DAY
    cut = (
        stops.filter(F.col("end") - F.col("start") >= min_stop)
        .withColumn("d", F.explode(F.sequence(F.floor(F.col("start") / day), F.floor((F.col("end") - 1) / day))))
        .select("useruuid", "loc", "d", (F.col("start") - F.col("d") * day).alias("a"), (F.col("end") - F.col("d") * day).alias("b"))
    )

    def within(hours: tuple[int, int]) -> Column:
        low, high = (h * 3600 for h in hours)
        return F.greatest(F.lit(0), F.least("b", F.lit(high)) - F.greatest("a", F.lit(low)))

    weekday = F.pmod(F.col("d") + 3, F.lit(7)) < 5
    spent = cut.groupBy("useruuid", "d", "loc").agg(
        F.sum(within(night)).alias("H"), F.sum(F.when(weekday, within(office)).otherwise(0)).alias("W")
    )

    def detected(kind: str, hours: tuple[int, int], window: int, valid: float, share: float) -> DataFrame:
        width = (hours[1] - hours[0]) * 3600
        on = Window.partitionBy("useruuid", "d")
        counted = spent.withColumn("seen", F.sum(kind).over(on)).filter(F.col("seen") >= coverage * width)
        daily = counted.select("useruuid", "d", "loc", (F.col(kind) / F.col("seen")).alias("part"))
        reach = (-(window - 1), 0) if past_only else (-(window // 2), window // 2)
        days = counted.select("useruuid", "d").distinct()
        around = Window.partitionBy("useruuid").orderBy("d").rangeBetween(*reach)
        counts = days.withColumn("days", F.count("*").over(around)).filter(F.col("days") >= valid * window)
        # A day's rows go to the days whose window holds it, at most `window` + 1 of them.
        held = F.explode(F.sequence(F.col("d") - reach[1], F.col("d") - reach[0]))
        near = daily.withColumn("d", held).join(counts, ["useruuid", "d"])
        means = near.groupBy("useruuid", "d", "loc", "days").agg(
            F.round(F.sum("part") / F.first("days"), 9).alias("mean"), F.sum((F.col("part") > 0).cast("int")).alias("present")
        )
        if kind == "W":
            means = means.filter(F.col("present") >= work_presence * F.col("days"))
        first = F.row_number().over(Window.partitionBy("useruuid", "d").orderBy(F.col("mean").desc(), "loc"))
        best = means.filter(F.col("mean") >= share).withColumn("first", first)
        return best.select("useruuid", "d", F.col("loc").alias(f"detect_{kind}_loc"), "first")

    home = detected("H", night, home_days, home_valid, home_share).filter("first = 1").drop("first")
    work = detected("W", office, work_days, work_valid, work_share)
    work = (
        work.join(home, ["useruuid", "d"], "left")
        .filter(F.col("detect_H_loc").isNull() | (F.col("detect_H_loc") != F.col("detect_W_loc")))
        .groupBy("useruuid", "d")
        .agg(F.min_by("detect_W_loc", "first").alias("detect_W_loc"))
    )
    kind = F.when(F.col("loc") == F.col("detect_H_loc"), "H").when(F.col("loc") == F.col("detect_W_loc"), "W").otherwise("O")
    return (
        stops.withColumn("d", F.floor(F.col("start") / day))
        .join(home, ["useruuid", "d"], "left")
        .join(work, ["useruuid", "d"], "left")
        .withColumn("location_type", kind)
        .drop("d")
    )


def labelled_home(labelled: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, home_loc, home_lat, home_lon, total_home_time: of the stops at home (location_type H) the place of most stay.

    Ties go to the smaller place; its coordinates are the medians of its stops at home.
    """
    spent = labelled.filter("location_type = 'H'").groupBy(*keys, F.col("loc").alias("home_loc")).agg(
        F.sum(F.col("end") - F.col("start")).alias("total_home_time"),
        F.median("latitude").alias("home_lat"),
        F.median("longitude").alias("home_lon"),
    )
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("total_home_time").desc(), "home_loc"))
    best = spent.withColumn("first", first).filter("first = 1")
    return best.select(*keys, "home_loc", "home_lat", "home_lon", "total_home_time")


def modal(labels: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """The value of a column with most rows per key, ties to the smaller; null values do not count."""
    counted = labels.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), column))
    return counted.withColumn("first", first).filter("first = 1").select(*keys, column)


def simple_labels(stops: DataFrame, hours: int = NIGHT_HOURS) -> DataFrame:
    """Stop-level labels without windows: a stop that touches the night is at home, one in office hours at work."""
    night = calendar.daily_overlap(F.col("start"), F.col("end"), hours)
    hour = F.floor(F.pmod(F.col("start"), F.lit(calendar.DAY)) / 3600)
    office = (hour >= 8) & (hour < 18) & (F.col("weekday_weekend") == "weekday")
    return stops.withColumn("detect_H_loc", F.when(night > 0, F.col("loc"))).withColumn(
        "detect_W_loc", F.when(office, F.col("loc"))
    )


def relabelled(stops: DataFrame, home: DataFrame, work: DataFrame, keys: list[str]) -> DataFrame:
    """A text column `stops`: H at home, W at work, else the location."""
    place = (
        F.when(F.col("loc") == F.col("detect_H_loc"), "H")
        .when(F.col("loc") == F.col("detect_W_loc"), "W")
        .otherwise(F.col("loc").cast("string"))
    )
    return stops.join(home, keys, "left").join(work, keys, "left").withColumn("stops", place)
