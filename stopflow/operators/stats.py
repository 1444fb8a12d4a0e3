"""Resampling, dispersion, histograms and two-sample statistics; iterations are a column, not a loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mixer import mixed
from ..sources.working import dealt, kept, materialised

#: Each country's share of the people of these ten. Fixed values.
POPULATION = {
    "USA": 0.416723038548721,
    "JPN": 0.1600502537374388,
    "DEU": 0.10440386812912543,
    "GBR": 0.08347925503431211,
    "FRA": 0.08105224253089227,
    "ESP": 0.058863593224739726,
    "AUS": 0.03107225947862733,
    "TWN": 0.029903041019936665,
    "NLD": 0.02174295481940657,
    "SWE": 0.012709493476800057,
}


def ordinals(rows: DataFrame, scope: list[str], order: list[str], name: str = "place", keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """rows with their number from 0 in the order within each scope, and the size n of the scope.

    Rows are dealt by ranges of the order; a small table of counts by range and scope gives what comes before,
    so a scope of any size is spread over tasks. keep holds the ranges: kept(), or materialised() within long plans.
    """
    at = keep(rows.repartitionByRange(*scope, *order).withColumn("_part", F.spark_partition_id()))
    counts = at.groupBy(*scope, "_part").agg(F.count("*").alias("_rows"))
    all_ = Window.partitionBy(*scope)
    earlier = F.sum("_rows").over(all_.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(*scope, "_part", F.coalesce(earlier, F.lit(0)).alias("_before"), F.sum("_rows").over(all_).alias("n"))
    local = F.row_number().over(Window.partitionBy(*scope, "_part").orderBy(*order)).cast("long") - 1
    numbered_ = at.withColumn(name, local).join(dealt(before), [*scope, "_part"])  # rows are dealt by these for local
    return numbered_.withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def resampled(rows: DataFrame, scope: list[str], order: list[str], times: int, seed: int = 0, shares: DataFrame | None = None) -> DataFrame:
    """rows drawn with replacement, n of them for each scope and iteration b in 0..times-1.

    With shares (a column of scope, weight), weight * n of them, rounded half to even.
    """
    at = ordinals(rows, scope, order)
    draws = at.select(*scope, "place", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))).alias("b"))
    if shares is not None:
        by = [c for c in shares.columns if c != "weight"]
        draws = draws.join(shares, by).filter(F.col("place") < F.bround(F.col("n") * F.col("weight"))).drop("weight")
    drawn = draws.select(*scope, "b", (mixed(F.col("place"), F.col("b"), seed) % F.col("n")).alias("place"))
    return drawn.join(at.drop("n"), [*scope, "place"]).drop("place")


def permuted(rows: DataFrame, column: str, scope: list[str], order: list[str], times: int, seed: int = 0) -> DataFrame:
    """rows for each iteration b, with the values of a column shuffled within its scope.

    Ranges and places are written: a persisted frame that a plan reads in several places was computed for each of them.
    """
    at = materialised(ordinals(rows, scope, order, keep=materialised).drop("n"), "places")
    turns = at.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))
    shuffled = turns.select(*scope, "b", column, "place", mixed(F.col("place"), F.col("b"), seed).alias("_mix"))
    moved = ordinals(shuffled.withColumnRenamed("place", "_from"), [*scope, "b"], ["_mix", "_from"], keep=materialised)
    return turns.drop(column).join(dealt(moved.select(*scope, "b", "place", column)), [*scope, "b", "place"]).drop("place")


def bootstrap(rows: DataFrame, scope: list[str], order: list[str], of: Column, times: int, ddof: int = 0, seed: int = 0) -> DataFrame:
    """Mean and deviation over resamples of an aggregate: bs_mean, bs_std."""
    each = resampled(rows, scope, order, times, seed).groupBy(*scope, "b").agg(of.alias("value"))
    spread = F.stddev_samp("value") if ddof else F.stddev_pop("value")
    return each.groupBy(*scope).agg(F.round(F.avg("value"), 6).alias("bs_mean"), F.round(spread, 6).alias("bs_std"))


def rcvq(column: str) -> Column:
    """Three quarters of the interquartile range over the median; null for a zero median."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return 0.75 * F.try_divide(F.get(q, F.lit(2)) - F.get(q, F.lit(0)), F.get(q, F.lit(1)))


def robust_dispersion(rows: DataFrame, column: str, scope: list[str]) -> DataFrame:
    """rcvq, and rcvm = 1.4826 * median absolute deviation over the median."""
    middle = rows.groupBy(*scope).agg(F.median(column).alias("med"), rcvq(column).alias("rcvq"))
    away = rows.join(middle, scope).withColumn("away", F.abs(F.col(column) - F.col("med")))
    return away.groupBy(*scope).agg(
        F.round(F.first("rcvq"), 6).alias("rcvq"),
        F.round(1.4826 * F.try_divide(F.median("away"), F.first("med")), 6).alias("rcvm"),
    )


def gap(first: Column, second: Column) -> Column:
    """Difference over the mean of both; null for a zero mean."""
    return F.try_divide(first - second, (first + second) / 2)


def bootstrap_gap(rows: DataFrame, column: str, scope: list[str], order: list[str], times: int) -> DataFrame:
    """Mean and sample deviation of the symmetric gap of medians, men against women."""
    drawn = resampled(rows, [*scope, "gender"], order, times).groupBy(*scope, "b").agg(
        F.median(F.when(F.col("gender") == "MALE", F.col(column))).alias("m"),
        F.median(F.when(F.col("gender") == "FEMALE", F.col(column))).alias("f"),
    )
    value = gap(F.col("m"), F.col("f"))
    return drawn.groupBy(*scope).agg(
        F.round(F.avg(value), 6).alias("gap_mean"), F.round(F.stddev_samp(value), 6).alias("gap_std")
    )


def histogram(rows: DataFrame, column: str, scope: list[str], edges: int = 11) -> DataFrame:
    """Density over edges - 1 equal bins from 0 to the largest value; empty bins are left out."""
    some = rows.filter((F.col(column) >= 0) & (F.col(column) < float("inf")))
    about = some.groupBy(*scope).agg(F.max(column).cast("double").alias("top"), F.count("*").alias("n"))
    width = F.col("top") / (edges - 1)
    place = F.least(F.floor(F.try_divide(F.col(column), width)), F.lit(edges - 2)).cast("long")
    return (
        some.join(about, scope)
        .groupBy(*scope, F.coalesce(place, F.lit(0)).alias("bin"), "top", "n")
        .agg(F.count("*").alias("count"))
        .select(
            *scope,
            "bin",
            F.round((F.col("bin") + 0.5) * width, 6).alias("midpoint"),
            F.round(F.try_divide(F.col("count"), F.col("n") * width), 9).alias("density"),
        )
    )


def log_histogram(rows: DataFrame, column: str, scope: list[str], edges: int = 10) -> DataFrame:
    """Density over edges - 1 bins between powers of ten from 1 to the largest value; smaller values lie outside."""
    some = rows.filter((F.col(column) >= 1) & (F.col(column) < float("inf")))
    about = some.groupBy(*scope).agg(F.max(column).cast("double").alias("top"), F.count("*").alias("n")).filter("top > 1")
    step = F.log10("top") / (edges - 1)
    place = F.least(F.floor(F.log10(column) / step), F.lit(edges - 2)).cast("long")
    low, high = (F.pow(F.lit(10.0), (F.col("bin") + k) * step) for k in (0, 1))
    return (
        some.join(about, scope)
        .groupBy(*scope, place.alias("bin"), "top", "n")
        .agg(F.count("*").alias("count"))
        .select(*scope, "bin", F.round((low + high) / 2, 6).alias("midpoint"), F.round(F.col("count") / (F.col("n") * (high - low)), 9).alias("density"))
    )


def _cumulated(at: DataFrame, scope: list[str], order: str, columns: list[str]) -> DataFrame:
    """at with each column's sum up to the row (sum_*) and over the whole scope (all_*), in the order.

    Rows are dealt by ranges of the order, and a small table of sums by range and scope gives what comes before.
    """
    dealt = kept(at.repartitionByRange(*scope, order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy(*scope, "_part").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    whole = Window.partitionBy(*scope)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"_before_{c}": F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)) for c in columns}
    before = parts.withColumns(sums | {f"all_{c}": F.sum(f"_{c}").over(whole) for c in columns}).drop(*(f"_{c}" for c in columns))
    local = Window.partitionBy(*scope, "_part").orderBy(order)
    out = dealt.join(before, [*scope, "_part"]).withColumns({f"sum_{c}": F.sum(c).over(local) + F.col(f"_before_{c}") for c in columns})
    return out.drop("_part", *(f"_before_{c}" for c in columns))


def kolmogorov_smirnov(rows: DataFrame, column: str, scope: list[str]) -> DataFrame:
    """One-sided two-sample statistics of positive values, men against women, with asymptotic p-values.

    d_greater is the largest excess of the men's distribution function, d_less of the women's; loc_* the
    smallest value where it is reached.
    """
    some = rows.filter(F.col(column) > 0)
    at = some.groupBy(*scope, F.col(column).cast("double").alias("x")).agg(
        F.count_if(F.col("gender") == "MALE").alias("m"), F.count_if(F.col("gender") == "FEMALE").alias("f")
    )
    lined = _cumulated(at, scope, "x", ["m", "f"]).filter("all_m > 0 AND all_f > 0")
    diff = F.round(F.col("sum_m") / F.col("all_m") - F.col("sum_f") / F.col("all_f"), 9)
    found = lined.withColumn("diff", diff).groupBy(*scope, F.col("all_m").alias("nm"), F.col("all_f").alias("nf")).agg(
        F.greatest(F.max("diff"), F.lit(0.0)).alias("d_greater"),
        F.greatest(F.max(-F.col("diff")), F.lit(0.0)).alias("d_less"),
        F.max_by("x", F.struct(F.col("diff"), -F.col("x"))).alias("loc_greater"),
        F.max_by("x", F.struct(-F.col("diff"), -F.col("x"))).alias("loc_less"),
    )
    size = F.col("nm") * F.col("nf") / (F.col("nm") + F.col("nf"))
    return found.select(
        *scope, "d_greater", "d_less", "loc_greater", "loc_less",
        *(F.round(F.exp(-2 * F.col(f"d_{s}") * F.col(f"d_{s}") * size), 6).alias(f"p_{s}") for s in ("greater", "less")),
    )


def permutation_test(rows: DataFrame, column: str, scope: list[str], order: list[str], times: int, seed: int = 0) -> DataFrame:
    """Observed statistics of each scope, and the share of shuffles of the genders that reach them."""
    seen = kolmogorov_smirnov(rows, column, scope).select(*scope, "d_greater", "d_less")
    each = kolmogorov_smirnov(permuted(rows, "gender", scope, order, times, seed), column, [*scope, "b"])
    both = seen.join(each.select(*scope, *(F.col(f"d_{s}").alias(f"s_{s}") for s in ("greater", "less"))), scope)
    reached = (F.round(F.avg((F.col(f"s_{s}") >= F.col(f"d_{s}")).cast("double")), 6).alias(f"perm_p_{s}") for s in ("greater", "less"))
    return both.groupBy(*scope, "d_greater", "d_less").agg(*reached)


def population(spark) -> DataFrame:
    """Each country's share of the ten countries' people."""
    return spark.createDataFrame(list(POPULATION.items()), "GID_0 string, weight double")


def over_countries(rows: DataFrame, weights: DataFrame, scope: list[str]) -> DataFrame:
    """From bs_mean and bs_std per country: the equal mean with its pooled error, and the weighted one.

    Weights are shares of the countries present; the weighted error sums w * se^2, with w not squared.
    """
    joined = rows.join(weights, "GID_0")
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy(*scope))
    return joined.withColumn("w", share).groupBy(*scope).agg(
        F.round(F.avg("bs_mean"), 6).alias("equal_mean"),
        F.round(F.sqrt(F.sum(F.pow("bs_std", F.lit(2)) / F.lit(1.0))) / F.sqrt(F.count("*")), 6).alias("equal_se"),
        F.round(F.sum(F.col("w") * F.col("bs_mean")), 6).alias("weighted_mean"),
        F.round(F.sqrt(F.sum(F.col("w") * F.pow("bs_std", F.lit(2)))), 6).alias("weighted_se"),
    )


def steady_mean(column: str) -> Column:
    """Aggregate: the mean, the same in any order of rows; values are added in order, and what a sum loses is carried along."""
    values = F.array_sort(F.collect_list(F.col(column).cast("double")))

    def step(acc: Column, x: Column) -> Column:
        total = acc["total"] + x
        lost = F.when(F.abs(acc["total"]) >= F.abs(x), (acc["total"] - total) + x).otherwise((x - total) + acc["total"])
        return F.struct(total.alias("total"), (acc["lost"] + lost).alias("lost"))

    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("lost"))
    return F.try_divide(F.aggregate(values, start, step, lambda acc: acc["total"] + acc["lost"]), F.size(values))


def rounded(value: Column, digits: int) -> Column:
    """Half away from zero of the scaled double, as SQL engines round it; F.round goes by the decimal that is printed."""
    scale = float(10**digits)
    return F.round(value * scale) / scale


def pooled_error(column: str) -> Column:
    """Aggregate: the root of the sum of squares over the count."""
    return F.sqrt(F.sum(F.col(column) * F.col(column))) / F.count(column)


def km_label(power: Column) -> Column:
    """A base-10 logarithm as text: two decimals below 1, one below 10, else the whole part with separators."""
    km = F.pow(F.lit(10.0), power)
    return F.when(km < 1, F.format_number(km, 2)).when(km < 10, F.format_number(km, 1)).otherwise(F.format_number(F.floor(km), 0))
