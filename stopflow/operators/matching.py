"""Nearest-neighbour matching of men and women on two controls, and permutation inference.

Controls are small integers: each side is reduced to its distinct points, points meet within a scope, and the
members of the winning points join back, so the pairs compared do not grow with the rows. Joins with members are by
shuffles: rows are often a working table, whose files are far smaller than its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.working import dealt, materialised
from .stats import ordinals

ID = ["useruuid", "start_month"]
#: Parts of the offered points of a scope.
PARTS = 8
#: Largest difference in locations by group. Fixed values.
CALIPER = {"all": 1, "inactive": 1, "moderate": 2, "active": 4}


def eligible(rows: DataFrame, metrics: list[str], least: int) -> DataFrame:
    """Rows with more than `least` visits and locations and every metric above 0."""
    good = (F.col("visits") > least) & (F.col("locations") > least)
    for m in metrics:
        good = good & (F.col(m) > 0)
    return rows.filter(good)


def scoped(rows: DataFrame) -> DataFrame:
    """rows once for each scope they are matched in: scope_country is all or their own, scope_group all or their own.

    People of the group `other` are matched among all only, as the caliper has no value for it.
    """
    own = F.when(F.col("activity_repertoire_groups").isin([g for g in CALIPER if g != "all"]), F.col("activity_repertoire_groups"))
    group = F.explode(F.array_compact(F.array(F.lit("all"), own)))
    country = F.explode(F.array_compact(F.array(F.lit("all"), F.col("GID_0"))))
    return rows.withColumn("scope_group", group).withColumn("scope_country", country)


def nearest(asking: DataFrame, offered: DataFrame, scope: list[str]) -> DataFrame:
    """For each asking row the nearest offered row of its scope, in z-space of the asking side.

    Columns: scope, a_ and b_ ids, dist2. Equal distances go to the smallest user, then month.
    """
    z = asking.groupBy(*scope).agg(
        F.avg("visits").alias("mv"), F.stddev_pop("visits").alias("sv"),
        F.avg("locations").alias("ml"), F.stddev_pop("locations").alias("sl"),
    )
    point = asking.select(*scope, F.col("visits").alias("v1"), F.col("locations").alias("l1")).distinct()
    first = Window.partitionBy(*scope, "visits", "locations").orderBy(*ID)
    best_of = offered.withColumn("r", F.row_number().over(first)).filter("r = 1")
    other = best_of.select(*scope, F.col("visits").alias("v2"), F.col("locations").alias("l2"), *(F.col(c).alias(f"b_{c}") for c in ID))
    dv = F.coalesce(F.try_divide(F.col("v1") - F.col("v2"), F.col("sv")), F.lit(0.0))
    dl = F.coalesce(F.try_divide(F.col("l1") - F.col("l2"), F.col("sl")), F.lit(0.0))
    # Offered points are dealt into parts that every asking point visits; the nearest is taken before any row moves on.
    part = F.pmod(F.xxhash64("v2", "l2"), F.lit(PARTS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    met = point.join(z, scope).withColumn("part", every).join(dealt(other.withColumn("part", part)), [*scope, "part"])
    ids = [f"b_{c}" for c in ID]
    best = F.min(F.struct(F.round(dv * dv + dl * dl, 9).alias("dist2"), *ids))
    won = met.groupBy(*scope, "v1", "l1").agg(best.alias("best")).select(*scope, "v1", "l1", "best.*")
    members = asking.select(*scope, F.col("visits").alias("v1"), F.col("locations").alias("l1"), *(F.col(c).alias(f"a_{c}") for c in ID))
    return members.join(dealt(won), [*scope, "v1", "l1"]).select(*scope, *(f"a_{c}" for c in ID), *(f"b_{c}" for c in ID), "dist2")


def _side(matched: DataFrame, male: str, female: str, scope: list[str]) -> DataFrame:
    return matched.select(*scope, *(F.col(f"{male}_{c}").alias(f"m_{c}") for c in ID), *(F.col(f"{female}_{c}").alias(f"f_{c}") for c in ID))


def match_male(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Each man with the nearest woman."""
    return nearest(rows.filter("gender = 'MALE'"), rows.filter("gender = 'FEMALE'"), scope)


def match_unmatched_female(rows: DataFrame, scope: list[str], men: DataFrame | None = None) -> DataFrame:
    """Each woman whom no man was matched to, with the nearest man, in z-space of these women; men is match_male()."""
    men = match_male(rows, scope) if men is None else men
    taken = men.select(*scope, *(F.col(f"b_{c}").alias(c) for c in ID)).distinct()
    left = rows.filter("gender = 'FEMALE'").join(dealt(taken), [*scope, *ID], "left_anti")
    return nearest(left, rows.filter("gender = 'MALE'"), scope)


def matched_pairs(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Distinct pairs of both directions: scope, m_ and f_ ids.

    Each direction, and the pairs, are written before they are read: as one plan they filled the driver, which holds a
    plan's threads, code and every revision of it.
    """
    men = materialised(match_male(rows, scope), "men")
    forth = _side(men, "a", "b", scope)
    back = _side(match_unmatched_female(rows, scope, men), "b", "a", scope)
    return materialised(forth.unionByName(back).distinct(), "pairs")


def deltas(pairs: DataFrame, rows: DataFrame, metrics: list[str], scope: list[str]) -> DataFrame:
    """One row for each pair and metric: abs_dif, rel_dif, abs_abs_dif; d_locations for the caliper."""
    wanted = [*metrics, *(m for m in ("locations", "visits") if m not in metrics)]

    def side(gender: str) -> DataFrame:
        values = [F.col(m).cast("double").alias(f"{gender}_of_{m}") for m in wanted]
        return dealt(rows.select(*scope, *(F.col(c).alias(f"{gender}_{c}") for c in ID), F.col("locations").alias(f"{gender}_locs"), *values))

    joined = pairs.join(side("m"), [*scope, *(f"m_{c}" for c in ID)]).join(side("f"), [*scope, *(f"f_{c}" for c in ID)])
    both = [F.struct(F.lit(m).alias("metric"), F.col(f"m_of_{m}").alias("m_value"), F.col(f"f_of_{m}").alias("f_value")) for m in wanted]
    each = joined.select(*scope, *(f"m_{c}" for c in ID), *(f"f_{c}" for c in ID), "m_locs", "f_locs", F.inline(F.array(*both)))
    diff = F.col("m_value") - F.col("f_value")
    return each.select(
        *scope, *(f"m_{c}" for c in ID), *(f"f_{c}" for c in ID), "metric",
        F.round(diff, 6).alias("abs_dif"),
        F.round(F.try_divide(diff, F.col("m_value") + F.col("f_value")), 6).alias("rel_dif"),
        F.round(F.abs(diff), 6).alias("abs_abs_dif"),
        (F.col("m_locs") - F.col("f_locs")).alias("d_locations"),
    )


def within_caliper(found: DataFrame, group: Column) -> DataFrame:
    """Pairs whose locations differ by no more than their group allows; a group without a caliper is an error."""
    allowed = F.lit(None).cast("int")
    for name, most in CALIPER.items():
        allowed = F.when(group == name, most).otherwise(allowed)
    checked = F.when(allowed.isNull(), F.raise_error(F.concat(F.lit("no caliper for group "), group)).cast("int")).otherwise(allowed)
    return found.filter(F.abs("d_locations") <= checked)


def delta_summary(found: DataFrame, scope: list[str]) -> DataFrame:
    """Per metric the mean relative difference, the means of its two signs, and the counts of the signs."""
    d = F.col("rel_dif")
    return found.groupBy(*scope, "metric").agg(
        F.round(F.avg(d), 12).alias("mean_rel"),
        F.round(F.avg(F.when(d >= 0, d)), 12).alias("mean_pos"),
        F.round(F.avg(F.when(d <= 0, d)), 12).alias("mean_neg"),
        F.count_if(d > 0).alias("n_pos"),
        F.count_if(d < 0).alias("n_neg"),
        F.count_if(d == 0).alias("n_zero"),
    )


def significance(observed: DataFrame, shuffled: DataFrame, scope: list[str]) -> DataFrame:
    """Observed means against those of shuffles: percentiles, who is above, rank, and two-tailed p with its flag."""
    value = 2 * F.col("mean_rel")
    base = shuffled.withColumn("s", value)
    q = F.percentile("s", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    cuts = base.groupBy(*scope, "metric").agg(*(F.get(q, F.lit(i)).alias(n) for i, n in enumerate(("p5", "p50", "p95"))))
    seen = observed.withColumn("obs", value).select(*scope, "metric", "obs").join(cuts, [*scope, "metric"])
    both = seen.join(base.select(*scope, "metric", "s"), [*scope, "metric"])
    far = F.round(F.abs(F.col("s") - F.col("p50")), 9) >= F.round(F.abs(F.col("obs") - F.col("p50")), 9)
    found = both.groupBy(*scope, "metric", "obs", "p5", "p50", "p95").agg(
        F.avg(far.cast("double")).alias("p_value"), F.avg((F.col("s") <= F.col("obs")).cast("double")).alias("pct_rank")
    )
    who = F.when((F.col("obs") > F.col("p95")) & (F.col("obs") > 0), "MALE").when((F.col("obs") < F.col("p5")) & (F.col("obs") < 0), "FEMALE").otherwise("none")
    flag = F.when(F.col("p_value") < 0.01, "***").when(F.col("p_value") < 0.05, "**").when(F.col("p_value") < 0.1, "*").otherwise("")
    rounded = [F.round(c, 6).alias(c) for c in ("obs", "p5", "p50", "p95", "p_value", "pct_rank")]
    return found.select(*scope, "metric", *rounded, who.alias("higher"), flag.alias("flag"))


def counted_countries(found: DataFrame) -> DataFrame:
    """From significance() by country and group: how many countries, all together aside, favour men, women or neither."""
    each = found.filter("scope_country <> 'all'")
    return each.groupBy("scope_group", "metric").agg(*(F.count_if(F.col("higher") == who).alias(f"sig_{who}") for who in ("MALE", "FEMALE", "none")))


def anonymised(rows: DataFrame, column: str = "useruuid") -> DataFrame:
    """user_1, user_2, ... in the order of the ids, which do not appear."""
    ids = ordinals(rows.select(column, F.lit(0).alias("_all")).distinct(), ["_all"], [column])
    named = ids.select(column, F.concat(F.lit("user_"), (F.col("place") + 1).cast("string")).alias("anon"))
    return rows.join(named, column).drop(column)
