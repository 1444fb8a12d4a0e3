"""The one windowed frame of consecutive stops that distances, times and transitions share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import great_circle
from ..sources.stops import KEYS, ordered


def steps(stops: DataFrame, keys: list[str] = KEYS, distances: bool = True) -> DataFrame:
    """Stops with the previous and the next of their key: prev_loc, prev_end, next_loc, rn.

    With distances, a place is at the median coordinates of its stops (mlat, mlon), and km is the way from the previous
    stop, next_km to the next. Stops are dealt by key once: medians and order are windows over the same partitions.
    A frame that has these columns is returned as it is.
    """
    if "rn" in stops.columns and ("km" in stops.columns or not distances):
        return stops
    w, place = ordered(keys), Window.partitionBy(*keys, "loc")
    dealt = stops.repartition(*keys)
    around = {"prev_loc": F.lag("loc").over(w), "prev_end": F.lag("end").over(w), "next_loc": F.lead("loc").over(w), "rn": F.row_number().over(w)}
    if not distances:
        return dealt.withColumns(around)
    at = dealt.withColumns({"mlat": F.median("latitude").over(place), "mlon": F.median("longitude").over(place)})
    back = at.withColumns(
        around
        | {
            "plat": F.lag("mlat").over(w),
            "plon": F.lag("mlon").over(w),
            "next_mlat": F.lead("mlat").over(w),
            "next_mlon": F.lead("mlon").over(w),
        }
    )
    km = great_circle(F.col("plat"), F.col("plon"), F.col("mlat"), F.col("mlon"))
    ahead = great_circle(F.col("mlat"), F.col("mlon"), F.col("next_mlat"), F.col("next_mlon"))
    return back.withColumn("km", km).withColumn("next_km", ahead).drop("plat", "plon")
