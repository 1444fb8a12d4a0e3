"""Runs from files to files: stops and demographics in, metrics or tours out, as a configuration says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anchors, graph, graph_kernel, mobility, quantiles, tours
from ..operators.steps import steps
from ..sources import stops as source
from ..sources.stops import Config
from ..sources.working import kept, unkept

#: Relational network metrics by the function that yields them; all others are the kernel's.
_BASIC = ["nodes", "edges", "density", "n_cycles", "n_cycles_per_edge"]
_CLUSTERING = ["avg_unw_cluster", "avg_weighted_cluster", "transitivity"]
_DEGREE = [f"top{k}_degree_centrality" for k in (1, 2, 3)]


def labelled_stops(spark: SparkSession, config: Config) -> DataFrame:
    """Clean local stops of known people with their home and work labels; config.home holds the labelling's settings."""
    raw = source.with_tie_breaker(source.read_stops(spark, config.stops))
    people = source.read_demographics(spark, config.demographics)
    local = source.with_demographics(source.localised(source.valid_locations(raw)), people)
    return anchors.label_home_work(local, **config.home)


def metrics(labelled: DataFrame, config: Config) -> DataFrame:
    """A row for each key with its mobility and network metrics, rewards, efficiency, deciles and groups."""
    keys, asked = config.keys, config.network_metrics
    moved = kept(steps(labelled, keys))
    home = kept(anchors.labelled_home(labelled, keys))
    wide = mobility.mobility(moved, keys, config.mobility_metrics or None)
    if "locations" in wide.columns:
        wide = wide.filter(F.col("locations") >= config.least_locations)
    wide = wide.join(mobility.home_rewards(moved, home, keys), keys, "left")
    if "total_cost_travel_distance" in wide.columns:
        wide = mobility.with_efficiency(wide)
    moves = moved.filter(F.col("next_loc").isNotNull() & (F.col("next_loc") != F.col("loc")))
    edge = kept(graph.edges(moves, keys))
    for names, of in ((_BASIC, graph.basic), (_CLUSTERING, graph.clustering), (_DEGREE, graph.degree_top)):
        if chosen := [n for n in names if not asked or n in asked]:
            wide = wide.join(of(edge, keys).select(*keys, *chosen), keys, "left")
    fields = {name: out for name, (_, out) in graph_kernel.REGISTRY.items()}
    chosen = [n for n, out in fields.items() if n in asked or set(out) & set(asked)]
    if chosen:
        graphs = graph.compressed(moves, keys, pairs="global_efficiency_distance" in chosen).join(home.select(*keys, "home_loc"), keys, "left")
        wide = wide.join(graph_kernel.kernel(graphs, chosen, keys), keys, "left")
    return quantiles.with_groups(wide) if {"visits", "locations"} <= set(wide.columns) else wide


def run_metrics(spark: SparkSession, config: Config) -> None:
    """Writes the metrics of config.stops to config.output/metrics, by user_group."""
    labelled = kept(labelled_stops(spark, config))
    groups = labelled.select("useruuid", "user_group").distinct()
    source.write_parquet(metrics(labelled, config).join(groups, "useruuid", "left"), f"{config.output}/metrics")
    unkept()


def run_tours(spark: SparkSession, config: Config) -> None:
    """Writes sequence efficiencies, keystone tours and their summary of config.stops below config.output."""
    labelled = kept(labelled_stops(spark, config))
    keys = config.keys
    seen = kept(tours.visits(labelled, keys))
    found = kept(tours.tours(seen, keys))
    measured = kept(tours.measured(tours.keystone_tours(found, keys), seen, keys))
    whole = tours.sequence_efficiency(seen, anchors.labelled_home(labelled, keys), tours.main_keystone(found, seen, keys), keys)
    source.write_parquet(whole, f"{config.output}/sequences")
    source.write_parquet(measured, f"{config.output}/tours")
    source.write_csv(tours.summary(measured, keys), f"{config.output}/tour_summary")
    unkept()
