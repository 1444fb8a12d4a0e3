"""Stop sequences, tours, keystones and sequence efficiency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import great_circle
from ..sources.stops import KEYS, ordered
from .mobility import efficiency


def sequences(stops: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """A row for each key: its stops in time order as array<struct>."""
    one = F.struct("start", "event_id", "end", "loc", "latitude", "longitude")
    return stops.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("sequence"))


def visits(stops: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Runs of one location merged: idx from 1, first arrival and position, last departure."""
    w = ordered(keys)
    changed = F.lag("loc").over(w).isNull() | (F.lag("loc").over(w) != F.col("loc"))
    marked = stops.withColumns({"rn": F.row_number().over(w), "new": changed.cast("long")})
    return (
        marked.withColumn("idx", F.sum("new").over(w).cast("int"))
        .groupBy(*keys, "idx")
        .agg(
            F.min_by("loc", "rn").alias("loc"),
            F.min_by("start", "rn").alias("arr"),
            F.max_by("end", "rn").alias("dep"),
            F.min_by("latitude", "rn").alias("lat"),
            F.min_by("longitude", "rn").alias("lon"),
        )
    )


def closed_loops(places: Column) -> Column:
    """array<struct<s, e>> of the tours of array<struct<idx, loc>> in order, inner ones first.

    A stack holds the locations since the last return; a location on it closes a tour from there, and all
    above it is forgotten.
    """
    empty_stack = F.transform(F.slice(places, 1, 0), lambda x: F.struct(x["loc"].alias("l"), x["idx"].alias("i")))
    empty_out = F.transform(F.slice(places, 1, 0), lambda x: F.struct(x["idx"].alias("s"), x["idx"].alias("e")))

    def step(acc: Column, x: Column) -> Column:
        at = F.array_position(F.transform(acc["stack"], lambda y: y["l"]), x["loc"]).cast("int")
        here = F.array(F.struct(x["loc"].alias("l"), x["idx"].alias("i")))
        tour = F.array(F.struct(F.get(acc["stack"], at - 1)["i"].alias("s"), x["idx"].alias("e")))
        back = F.struct(
            F.concat(F.slice(acc["stack"], F.lit(1), F.greatest(at - 1, F.lit(0))), here).alias("stack"),
            F.concat(acc["out"], tour).alias("out"),
        )
        on = F.struct(F.concat(acc["stack"], here).alias("stack"), acc["out"].alias("out"))
        return F.when(at > 0, back).otherwise(on)

    begin = F.struct(empty_stack.alias("stack"), empty_out.alias("out"))
    return F.aggregate(places, begin, step, lambda acc: acc["out"])


def tours(seen: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """A row for each tour of visits(): from idx s to idx e, its location, stay_departure and total_duration."""
    one = F.struct("idx", "loc", "arr", "dep")
    rows = seen.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("places"))
    each = rows.select(*keys, "places", F.explode(closed_loops(F.col("places"))).alias("t"))
    at = F.get("places", F.col("t.s") - 1)
    return each.select(
        *keys,
        F.col("t.s").alias("s"),
        F.col("t.e").alias("e"),
        at["loc"].alias("loc"),
        (at["dep"] - at["arr"]).alias("stay_departure"),
        (F.get("places", F.col("t.e") - 1)["arr"] - at["dep"]).alias("total_duration"),
        F.transform(F.slice("places", F.col("t.s"), F.col("t.e") - F.col("t.s") + 1), lambda x: x["loc"]).alias("tour"),
    )


def measured(found: DataFrame, seen: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Tours with their number of stops, and distance, reward and largest reward in metres."""
    w = Window.partitionBy(*keys).orderBy("idx")
    step = F.round(1000 * great_circle(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))
    path = seen.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("run", F.sum("step").over(w))
    begin = path.select(*keys, F.col("idx").alias("s"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), F.col("run").alias("run0"))
    away = F.round(1000 * great_circle(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")))
    carried = ["loc", "stay_departure", "total_duration", "tour"]
    # A row for each stop of a tour, joined by its place: work grows with the tours' stops.
    each = found.join(begin, [*keys, "s"]).withColumn("idx", F.explode(F.sequence("s", "e")))
    joined = each.join(path.select(*keys, "idx", "lat", "lon", "run"), [*keys, "idx"])
    return joined.groupBy(*keys, "s", "e", *carried).agg(
        F.count("*").alias("tour_total_stops"),
        (F.max("run") - F.first("run0")).cast("long").alias("tour_total_distance"),
        (2 * F.sum(away)).cast("long").alias("tour_total_reward"),
        (2 * F.max(away)).cast("long").alias("tour_max_reward"),
    )


def keystones(found: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Locations left for a tour that took less time than the stay before it."""
    return found.filter("total_duration < stay_departure").select(*keys, "loc").distinct()


def keystone_tours(found: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """All tours from any keystone that hold more than one place."""
    return found.join(keystones(found, keys), [*keys, "loc"], "left_semi").filter(F.size(F.array_distinct("tour")) > 1)


def main_keystone(found: DataFrame, seen: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """For every key the keystone of most total stay, ties to the smaller; null without one."""
    stay = seen.groupBy(*keys, "loc").agg(F.sum(F.col("dep") - F.col("arr")).alias("stay"))
    held = stay.join(keystones(found, keys), [*keys, "loc"], "left_semi")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("stay").desc(), "loc"))
    best = held.withColumn("first", first).filter("first = 1").select(*keys, F.col("loc").alias("main_keystone"))
    return seen.select(*keys).distinct().join(best, keys, "left")


def sequence_efficiency(seen: DataFrame, home: DataFrame, keystone: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Cost in metres, and reward, efficiency and savings from the start, the home and the main keystone."""
    w = Window.partitionBy(*keys).orderBy("idx")
    step = F.round(1000 * great_circle(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))
    path = seen.withColumn("step", step)
    total = path.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("step").alias("seq_cost")).filter("n > 1")
    out = total
    anchors = {
        "start": seen.filter("idx = 1").select(*keys, F.col("loc").alias("anchor")),
        "home": home.select(*keys, F.col("home_loc").alias("anchor")),
        "keystone": keystone.select(*keys, F.col("main_keystone").alias("anchor")),
    }
    for name, anchor in anchors.items():
        at = (
            seen.join(anchor, keys)
            .filter("loc = anchor")
            .groupBy(*keys)
            .agg(F.min_by("lat", "idx").alias("lat0"), F.min_by("lon", "idx").alias("lon0"))
        )
        away = F.round(1000 * great_circle(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")))
        reward = seen.join(at, keys).groupBy(*keys).agg((2 * F.sum(away)).alias(f"reward_{name}"))
        cost, gain = F.col("seq_cost"), F.col(f"reward_{name}")
        out = out.join(reward, keys, "left").withColumns(
            {f"efficiency_{name}": F.round(efficiency(cost, gain), 4), f"savings_{name}": gain - cost}
        )
    return out


def summary(found: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per key the number of tours, of distinct lists of places, and totals."""
    return found.groupBy(*keys).agg(
        F.count("*").alias("jrny_total"),
        F.count_distinct("tour").alias("jrny_total_unique"),
        F.sum("tour_total_distance").alias("jrny_distance"),
        F.sum("tour_total_reward").alias("jrny_reward"),
        F.max("tour_max_reward").alias("jrny_max_reward"),
        F.sum("total_duration").alias("jrny_duration"),
    )


def length_bin(stops: Column) -> Column:
    """The label of a tour's length; null below 3."""
    fixed = F.when(stops == 3, "3\nABA").when(stops == 4, "4\nABCA").when(stops == 5, "5\nABCDA").when(stops == 6, "6")
    wide = F.when((stops > 6) & (stops <= 10), "7-10").when((stops > 10) & (stops <= 20), "11-20").when(stops > 20, "20+")
    return F.coalesce(fixed, wide)


def palindrome(tour: Column) -> Column:
    return tour == F.reverse(tour)


def tour_rows(found: DataFrame, groups: DataFrame | None = None, keys: list[str] = KEYS) -> DataFrame:
    """The tour dataset: measured tours of 3 and more stops with their length bin, and their key's group if given."""
    rows = found.withColumn("leng_bin", length_bin(F.col("tour_total_stops"))).filter("leng_bin IS NOT NULL")
    return rows if groups is None else rows.join(groups.dropDuplicates(keys), keys, "left")
