"""Mobility graphs as relations: nodes, undirected weighted edges, origin-destination flows, relational metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import great_circle
from ..sources.stops import KEYS
from ..sources.working import dealt, materialised
from .steps import steps


def transitions(stops: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Stops that are followed by another location."""
    return steps(stops, keys).filter(F.col("next_loc").isNotNull() & (F.col("next_loc") != F.col("loc")))


def largest_component(edge: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The edges within the largest component of each key's graph, the one of the smallest node among equals.

    Labels spread along edges until none changes; graphs of people are small, so rounds are few.
    """
    both = materialised(adjacency(edge, keys).select(*keys, "a", "b").distinct(), "adjacency")
    labels = both.groupBy(*keys, "a").agg(F.least(F.min("a"), F.min("b")).alias("c"))
    while True:
        labels = materialised(labels, "labels")
        near = both.join(dealt(labels.withColumnsRenamed({"a": "b", "c": "d"})), [*keys, "b"]).groupBy(*keys, "a").agg(F.min("d").alias("d"))
        after = materialised(dealt(labels).join(near, [*keys, "a"]).select(*keys, "a", F.least("c", "d").alias("to"), "c"), "labels")
        done = after.filter("to < c").isEmpty()
        labels = after.select(*keys, "a", F.col("to").alias("c"))
        if done:
            break
    sizes = labels.groupBy(*keys, "c").agg(F.count("*").alias("n"))
    best = sizes.groupBy(*keys).agg(F.min_by("c", F.struct(-F.col("n"), F.col("c"))).alias("c"))
    inside = dealt(labels).join(best, [*keys, "c"]).select(*keys, F.col("a").alias("u"))
    return edge.join(dealt(inside), [*keys, "u"], "left_semi")


def edges(moves: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """u < v and the number of moves between them in either direction."""
    u, v = F.least("loc", "next_loc"), F.greatest("loc", "next_loc")
    return moves.groupBy(*keys, u.alias("u"), v.alias("v")).agg(F.count("*").alias("w"))


def nodes(moves: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Every end of a move, with the number of departures."""
    ends = moves.select(*keys, F.inline(F.array(
        F.struct(F.col("loc").alias("node"), F.lit(1).alias("out")),
        F.struct(F.col("next_loc").alias("node"), F.lit(0).alias("out")),
    )))
    return ends.groupBy(*keys, "node").agg(F.sum("out").alias("departures"))


def flows(moves: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Directed trips, mean kilometres, and the power-of-ten bin of that mean, the lowest from 1 km down."""
    power = F.greatest(F.lit(0), F.floor(F.log10(F.when(F.col("mean_km") > 0, F.col("mean_km"))))).cast("int")
    low, high = F.pow(F.lit(10), power).cast("long"), F.pow(F.lit(10), power + 1).cast("long")
    label = F.concat(low.cast("string"), F.lit("-"), high.cast("string"), F.lit(" km"))
    return (
        moves.groupBy(*keys, F.col("loc").alias("origin_id"), F.col("next_loc").alias("destination_id"))
        .agg(F.count("*").alias("count_trips_OD"), F.round(F.avg("next_km"), 2).alias("mean_km"))
        .withColumn("distance_bin_OD", label)
    )


def basic(edge: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """nodes, edges, density, n_cycles (edges - nodes + 1: walks are connected), n_cycles_per_edge."""
    ends = edge.select(*keys, "u", "v", F.explode(F.array("u", "v")).alias("node"))
    n, m = F.count_distinct("node"), F.count("*") / 2
    out = ends.groupBy(*keys).agg(n.alias("nodes"), m.cast("long").alias("edges"))
    size = F.col("nodes") * (F.col("nodes") - 1)
    cycles = F.col("edges") - F.col("nodes") + 1
    return out.withColumns(
        {
            "density": F.round(F.try_divide(2.0 * F.col("edges"), size), 6),
            "n_cycles": cycles.cast("long"),
            "n_cycles_per_edge": F.round(cycles / F.col("edges"), 6),
        }
    )


def adjacency(edge: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Both directions of every edge: a, b, w."""
    return edge.select(*keys, F.col("u").alias("a"), F.col("v").alias("b"), "w").unionByName(
        edge.select(*keys, F.col("v").alias("a"), F.col("u").alias("b"), "w")
    )


def clustering(edge: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """avg_unw_cluster, avg_weighted_cluster, transitivity per key, by joins of the edge list.

    The weighted form takes the cube root of the product of a triangle's weights over the largest of the key.
    """
    adj = adjacency(edge, keys)
    top = edge.groupBy(*keys).agg(F.max("w").alias("top"))
    degree = adj.groupBy(*keys, "a").agg(F.count("*").alias("d"))
    # An edge starts at its end of the smaller (degree, node): few wedges leave any node, and each triangle has one first.
    one = degree.select(*keys, F.col("a").alias("u"), F.col("d").alias("du"))
    two = degree.select(*keys, F.col("a").alias("v"), F.col("d").alias("dv"))
    ranked = edge.join(one, [*keys, "u"]).join(two, [*keys, "v"])
    up = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    low, high = F.struct(F.col("du").alias("d"), F.col("u").alias("n")), F.struct(F.col("dv").alias("d"), F.col("v").alias("n"))
    arcs = ranked.select(*keys, F.when(up, low).otherwise(high).alias("x"), F.when(up, high).otherwise(low).alias("y"), "w")
    wedge = arcs.select(*keys, "x", F.col("y").alias("p"), F.col("w").alias("w1")).join(
        arcs.select(*keys, "x", F.col("y").alias("q"), F.col("w").alias("w2")), [*keys, "x"]
    )
    third = arcs.select(*keys, F.col("x").alias("p"), F.col("y").alias("q"), F.col("w").alias("w3"))
    closed = wedge.filter("p < q").join(third, [*keys, "p", "q"])
    corners = closed.select(*keys, F.explode(F.array("x.n", "p.n", "q.n")).alias("a"), F.cbrt(F.col("w1") * F.col("w2") * F.col("w3")).alias("tw"))
    triangles = corners.groupBy(*keys, "a").agg(F.count("*").alias("t"), F.sum("tw").alias("tw"))
    pairs = F.col("d") * (F.col("d") - 1)
    joined = degree.join(triangles, [*keys, "a"], "left").join(top, keys)
    local = F.when(F.col("d") > 1, 2.0 * F.coalesce("t", F.lit(0)) / F.nullif(pairs, F.lit(0))).otherwise(0.0)
    weighted = F.when(
        F.col("d") > 1, 2.0 * F.coalesce("tw", F.lit(0.0)) / F.col("top") / F.nullif(pairs, F.lit(0))
    ).otherwise(0.0)
    triples = F.sum(pairs) / 2.0
    return joined.groupBy(*keys).agg(
        F.round(F.avg(local), 6).alias("avg_unw_cluster"),
        F.round(F.avg(weighted), 6).alias("avg_weighted_cluster"),
        F.when(
            F.count("*") > 2, F.round(F.coalesce(F.try_divide(F.coalesce(F.sum("t"), F.lit(0)), triples), F.lit(0.0)), 6)
        ).alias("transitivity"),
    )


def degree_top(edge: DataFrame, keys: list[str] = KEYS, k: int = 3) -> DataFrame:
    """The k largest degrees over nodes - 1."""
    degree = adjacency(edge, keys).groupBy(*keys, "a").agg(F.count("*").alias("d"))
    share = degree.withColumn("c", F.col("d") / (F.count("*").over(Window.partitionBy(*keys)) - 1))
    top = F.slice(F.sort_array(F.collect_list("c"), asc=False), 1, k)
    best = share.groupBy(*keys).agg(top.alias("best"))
    return best.select(*keys, *(F.round(F.get("best", F.lit(i)), 6).alias(f"top{i + 1}_degree_centrality") for i in range(k)))


def edge_distances(moves: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Trips and mean kilometres of every undirected edge."""
    u, v = F.least("loc", "next_loc"), F.greatest("loc", "next_loc")
    return moves.groupBy(*keys, u.alias("ei"), v.alias("ej")).agg(
        F.count("*").alias("trips"), F.round(F.avg("next_km"), 2).alias("km")
    )


def ideal_distances(moves: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Kilometres between all pairs of nodes of a key; a node is at the least of its coordinates."""
    ends = moves.select(*keys, F.inline(F.array(
        F.struct(F.col("loc").alias("node"), F.col("mlat").alias("lat"), F.col("mlon").alias("lon")),
        F.struct(F.col("next_loc").alias("node"), F.col("next_mlat").alias("lat"), F.col("next_mlon").alias("lon")),
    )))
    at = ends.groupBy(*keys, "node").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    far = at.select(*keys, F.col("node").alias("ej"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    km = great_circle(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    pairs = at.withColumnRenamed("node", "ei").join(far, keys).filter("ei < ej")
    return pairs.select(*keys, "ei", "ej", F.round(km, 2).alias("ideal_km"))


def log_distances(moves: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Ideal pairs with the observed edge where there is one, in log10 metres; null for no distance."""

    def log_metres(name: str):
        return F.round(F.log10(F.when(F.col(name) > 0, F.col(name) * 1000)), 6)

    pairs = ideal_distances(moves, keys).join(edge_distances(moves, keys), [*keys, "ei", "ej"], "left")
    return pairs.select(*keys, "ei", "ej", log_metres("ideal_km").alias("log_ideal"), log_metres("km").alias("log_observed"))


def compressed(moves: DataFrame, keys: list[str] = KEYS, pairs: bool = True) -> DataFrame:
    """A row for each key: its edges as sorted arrays of struct<u, v, w> and, if asked for, all pairs of its nodes as
    struct<ei, ej, log_ideal, log_observed>, which only distance efficiency reads."""
    arcs = edges(moves, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("u", "v", "w"))).alias("edges"))
    if not pairs:
        return arcs
    far = log_distances(moves, keys).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("ei", "ej", "log_ideal", "log_observed"))).alias("pairs")
    )
    return arcs.join(far, keys)
