"""Gaps between men and women by tour length, distance, duration and reward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import counts_by_gender, fixed_bin, grouped, linear_edges, log_edges
from .stats import pooled_error, resampled, steady_mean

#: Edges in kilometres, in minutes, and in log10 kilometres. Fixed values.
DISTANCE_KM = log_edges(0.1, 300.0, 15)
DURATION_MIN = log_edges(1.0, 4320.0, 15)
REWARD_LOG = linear_edges(0.7781512503836436, 3.9542425094393248, 30)


def length_share(tours: DataFrame) -> DataFrame:
    """Tours of each length bin and their share of all."""
    counts = tours.groupBy("leng_bin").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    return counts.crossJoin(F.broadcast(total)).select("leng_bin", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


def distance_bin(tours: DataFrame) -> Column:
    """Bin of the largest reward, in kilometres kept within the outer edges."""
    km = F.least(F.greatest(F.col("tour_max_reward") / 1000.0, F.lit(DISTANCE_KM[0])), F.lit(DISTANCE_KM[-1]))
    return fixed_bin(km, DISTANCE_KM)


def duration_bin(tours: DataFrame) -> Column:
    return fixed_bin(F.col("total_duration") / 60.0, DURATION_MIN)


def gaps(tours: DataFrame, bins: list[str], within: list[str], least: int, iteration: str | None = None) -> DataFrame:
    """Share of a gender's tours in each bin, men less women, normalised over `within`; frac is the bin's share.

    Null where either gender has fewer than `least` tours in the bin.
    """
    by = [iteration] if iteration else []
    counts = tours.groupBy(*by, *dict.fromkeys([*bins, *within])).agg(*counts_by_gender())
    all_ = Window.partitionBy(*by, *within)
    share = F.try_divide(F.col("n_m"), F.sum("n_m").over(all_)) - F.try_divide(F.col("n_f"), F.sum("n_f").over(all_))
    enough = (F.col("n_m") >= least) & (F.col("n_f") >= least)
    frac = (F.col("n_m") + F.col("n_f")) / F.sum(F.col("n_m") + F.col("n_f")).over(all_)
    return counts.withColumns({"gap": F.round(F.when(enough, share), 6), "frac": F.round(frac, 6)})


def bootstrap_gaps(tours: DataFrame, bins: list[str], within: list[str], least: int, times: int, order: list[str]) -> DataFrame:
    """Mean and sample deviation over resamples of the gaps of each country."""
    drawn = resampled(tours, ["GID_0"], order, times)
    each = gaps(drawn, bins, within, least, "b")
    return each.groupBy(*dict.fromkeys([*bins, *within])).agg(
        F.round(F.avg("gap"), 9).alias("gap_mean"), F.round(F.stddev_samp("gap"), 6).alias("gap_std")
    )


def over_countries(rows: DataFrame, bins: list[str]) -> DataFrame:
    """Mean gap over countries with its pooled error."""
    some = rows.filter("gap_mean IS NOT NULL")
    return some.groupBy(*bins).agg(
        F.count("*").alias("countries"),
        F.round(F.avg("gap_mean"), 9).alias("gap_mean"),
        F.round(pooled_error("gap_std"), 6).alias("gap_se"),
    )


def palindrome_share(tours: DataFrame, shortest: int, times: int, order: list[str]) -> DataFrame:
    """Per gender the mean and sample deviation, over resamples, of the share of tours that read the same backwards."""
    some = tours.filter(F.col("tour_total_stops") >= shortest).withColumn("pal", (F.col("tour") == F.reverse("tour")).cast("double"))
    each = resampled(some, ["gender"], order, times).groupBy("gender", "b").agg(F.avg("pal").alias("share"))
    return each.groupBy("gender").agg(F.round(F.avg("share"), 6).alias("pal_mean"), F.round(F.stddev_samp("share"), 6).alias("pal_std"))


def reward_bin(column: str) -> Column:
    return fixed_bin(F.log10(F.when(F.col(column) > 0, F.col(column))), REWARD_LOG)


def bootstrap_by_reward(rows: DataFrame, values: list[str], times: int, order: list[str]) -> DataFrame:
    """By gender, reward_bin and q_bin: the user-months, and for each value the mean and deviation of resampled medians.

    rows: user-months with cost, reward and efficiency. Only those with all three and an efficiency of 0 and more
    count; q_bin numbers the fifths of their visits from 0; a reward outside the bins has none and is left out.
    """
    named = ["total_cost_travel_distance", "total_reward_home_distance", "tour_efficiency_dist"]
    some = rows.na.drop(subset=named).filter("tour_efficiency_dist >= 0")
    binned = grouped(some, {"visits": "q"}, 5).withColumn("reward_bin", reward_bin("total_reward_home_distance"))
    binned = binned.withColumn("q_bin", F.col("q") - 1).filter("reward_bin IS NOT NULL")
    by = ["gender", "reward_bin", "q_bin"]
    each = resampled(binned, by, order, times).groupBy(*by, "b").agg(*(F.median(v).alias(v) for v in values), F.count("*").alias("n"))
    return each.groupBy(*by).agg(
        F.max("n").alias("n_user_months"),
        *(steady_mean(v).alias(f"{v}_median") for v in values),
        *(F.stddev_samp(v).alias(f"{v}_se") for v in values),
    )


def symmetric_gap(summary: DataFrame, on: list[str], least: int) -> DataFrame:
    """From rows (on, gender, mean, se, n): 2 (M - F) / (M + F) with its error, where both have `least` user-months."""
    m, f = (summary.filter(F.col("gender") == g).drop("gender") for g in ("MALE", "FEMALE"))
    both = m.join(f.withColumnsRenamed({"mean": "mean_f", "se": "se_f", "n": "n_f"}), on)
    total = F.col("mean") + F.col("mean_f")
    return both.filter((F.col("n") >= least) & (F.col("n_f") >= least)).select(
        *on,
        F.round(F.try_divide(2 * (F.col("mean") - F.col("mean_f")), total), 6).alias("rel_gap"),
        F.round(F.try_divide(2 * F.sqrt(F.col("se") * F.col("se") + F.col("se_f") * F.col("se_f")), total), 6).alias("rel_gap_se"),
    )
