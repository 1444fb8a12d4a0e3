"""Quantile grouping with interpolated edges, and binning by fixed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(column: str, parts: int) -> Column:
    """Aggregate: the distinct interpolated quantiles 1/parts..1 that are above the minimum, in order."""
    cuts = F.percentile(column, F.array(*(F.lit(i / parts) for i in range(parts + 1))))
    return F.array_sort(F.array_distinct(F.filter(cuts, lambda e: e > F.get(cuts, F.lit(0)))))


def bin_of(value: Column, upper: Column) -> Column:
    """1 + the number of edges below the value: right-closed bins, the lowest holding the minimum."""
    return F.when(value.isNotNull(), 1 + F.size(F.filter(upper, lambda e: e < value))).cast("long")


def grouped(rows: DataFrame, columns: dict[str, str], parts: int = 10, scope: list[str] | None = None) -> DataFrame:
    """rows with a bin column for each of columns (source -> name), by the quantiles of each scope or of all rows."""
    found = [edges(c, parts).alias(f"{name}_edges") for c, name in columns.items()]
    cuts = rows.groupBy(*scope).agg(*found) if scope else rows.agg(*found)
    joined = rows.join(cuts, scope) if scope else rows.crossJoin(F.broadcast(cuts))  # one row
    out = joined.withColumns({name: bin_of(F.col(c), F.col(f"{name}_edges")) for c, name in columns.items()})
    return out.drop(*(f"{name}_edges" for name in columns.values()))


def activity_group(activity: Column, repertoire: Column) -> Column:
    """inactive, moderate or active where both deciles say so, else other."""

    def both(low: int, high: int) -> Column:
        return activity.between(low, high) & repertoire.between(low, high)

    return F.when(both(1, 3), "inactive").when(both(4, 7), "moderate").when(both(8, 10), "active").otherwise("other")


def with_groups(rows: DataFrame) -> DataFrame:
    """Deciles of visits and locations over all rows, and the activity-repertoire group."""
    out = grouped(rows, {"visits": "activity_deciles", "locations": "repertoire_deciles"})
    return out.withColumn("activity_repertoire_groups", activity_group(F.col("activity_deciles"), F.col("repertoire_deciles")))


def percentile_groups(rows: DataFrame, column: str, parts: int) -> DataFrame:
    """Positive values with their quantile number and its upper percentile; rows with a null anywhere are dropped."""
    some = grouped(rows.filter(F.col(column) > 0), {column: f"q{parts}_{column}"}, parts)
    return some.withColumn(f"perc_{column}", 100.0 * F.col(f"q{parts}_{column}") / parts).na.drop()


def fixed_bin(value: Column, cuts: list[float]) -> Column:
    """Number from 0 of the right-closed bin of ascending edges, the lowest edge included; null outside."""
    below = sum((value > F.lit(float(c))).cast("int") for c in cuts)
    inside = (value >= F.lit(float(cuts[0]))) & (value <= F.lit(float(cuts[-1])))
    return F.when(inside, F.greatest(below - 1, F.lit(0))).cast("long")


def linear_edges(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) * i / (n - 1) for i in range(n)]


def log_edges(low: float, high: float, n: int) -> list[float]:
    from math import log10

    return [10.0 ** (log10(low) + (log10(high) - log10(low)) * i / (n - 1)) for i in range(n)]


def share_gap(rows: DataFrame, column: str, parts: int = 10) -> DataFrame:
    """Per quantile, the share of men in it less the share of women."""
    name = f"q_{column}"
    counts = grouped(rows, {column: name}, parts).groupBy(name).agg(*counts_by_gender())
    total = counts.agg(F.sum("n_m").alias("all_m"), F.sum("n_f").alias("all_f"))
    gap = F.col("n_m") / F.col("all_m") - F.col("n_f") / F.col("all_f")
    return counts.crossJoin(F.broadcast(total)).select(F.col(name).alias("quantile"), "n_m", "n_f", F.round(gap, 6).alias("gap"))


def counts_by_gender() -> list[Column]:
    return [F.count_if(F.col("gender") == g).alias(n) for g, n in (("MALE", "n_m"), ("FEMALE", "n_f"))]


def decile_grid(rows: DataFrame, split: str | None = None) -> DataFrame:
    """Distinct users in each cell of the two deciles, in per cent of all; with split, of each value of it."""
    by = [split] if split else []
    cells = rows.groupBy(*by, "activity_deciles", "repertoire_deciles").agg(F.count_distinct("useruuid").alias("users"))
    total = rows.groupBy(*by).agg(F.count_distinct("useruuid").alias("total"))
    joined = cells.join(total, by) if by else cells.crossJoin(F.broadcast(total))
    return joined.withColumn("pct", F.round(100.0 * F.col("users") / F.col("total"), 6)).drop("total")


def grid_delta(rows: DataFrame) -> DataFrame:
    """The grid of men less the grid of women, over all 100 cells."""
    both = decile_grid(rows, "gender").groupBy("activity_deciles", "repertoire_deciles").agg(
        F.sum(F.when(F.col("gender") == "MALE", F.col("pct"))).alias("m"),
        F.sum(F.when(F.col("gender") == "FEMALE", F.col("pct"))).alias("f"),
    )
    spark = rows.sparkSession
    cells = spark.range(1, 11).withColumnRenamed("id", "activity_deciles").crossJoin(
        spark.range(1, 11).withColumnRenamed("id", "repertoire_deciles")
    )
    joined = cells.join(both, ["activity_deciles", "repertoire_deciles"], "left").na.fill(0.0, ["m", "f"])
    return joined.select("activity_deciles", "repertoire_deciles", F.round(F.col("m") - F.col("f"), 6).alias("delta"))
