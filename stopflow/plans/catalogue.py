"""Every query of the library by name, over the driver's tables.

Frames that a query uses several times are persisted, or written out where their plans would be repeated often; what a
query persisted is released when the next one is asked for.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar
from ..operators import anchors, contrasts, graph, graph_kernel, matching, matching_kernel, mobility, quantiles, stats, tours
from ..operators.matching_kernel import SEEN
from ..operators.steps import steps
from ..sources import stops as source
from ..sources.stops import KEYS
from ..sources.working import kept, materialised, unkept
from . import oracles

UM = ["useruuid", "start_month"]
#: Iterations of resampling queries, and thresholds small enough for the test tables.
TIMES, LEAST = 10, 2
#: Shuffles of match_significance, as many as the reference's.
SHUFFLES = 1000
HOME_SHARE = 0.2
#: Settings of home and work labels: stays of the test tables are short.
LABELS = {"coverage": 0.1, "home_valid": 0.1, "work_valid": 0.05, "home_share": 0.2, "work_share": 0.2, "work_presence": 0.1}

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(of: Query) -> Query:
    _REGISTRY[of.__name__] = of
    return of


def queries() -> dict[str, Query]:
    def released(of: Query) -> Query:
        @functools.wraps(of)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            unkept()
            return of(spark, sf)

        return run

    return {name: released(of) for name, of in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return oracles.sql()


def _stops(spark: SparkSession, sf: str) -> DataFrame:
    return source.prepared(spark, sf)


def _home(stops: DataFrame) -> DataFrame:
    """The place of most stay among the stops labelled as home."""
    return anchors.labelled_home(anchors.label_home_work(stops, **LABELS))


def _moves(spark: SparkSession, sf: str) -> DataFrame:
    return graph.transitions(_stops(spark, sf))


def _months(spark: SparkSession, sf: str) -> DataFrame:
    """Mobility metrics of user-months with two locations and more."""
    rows = mobility.mobility(_stops(spark, sf), names=["visits", "locations", "total_stay_time", "total_cost_travel_distance"])
    return rows.filter("locations >= 2")


def user_months(spark: SparkSession, sf: str) -> DataFrame:
    """_months() with deciles and groups."""
    return kept(quantiles.with_groups(kept(_months(spark, sf))))


def rewarded_months(spark: SparkSession, sf: str) -> DataFrame:
    """user_months() with their rewards and efficiency."""
    clean = kept(_stops(spark, sf))
    return kept(mobility.with_efficiency(user_months(spark, sf).join(mobility.home_rewards(clean, _home(clean)), KEYS, "left")))


def stage_one(spark: SparkSession, sf: str) -> DataFrame:
    """The wide row of every user-month: mobility, home, graph and kernel metrics, and groups."""
    clean = kept(_stops(spark, sf))
    moved = kept(steps(clean))
    moves = graph.transitions(moved)
    home = kept(_home(clean))
    wide = mobility.mobility(moved).filter("locations >= 2")
    wide = wide.join(mobility.home_rewards(moved, home), KEYS, "left")
    wide = mobility.with_efficiency(wide)
    edge = kept(graph.edges(moves))
    for part in (graph.basic(edge), graph.clustering(edge).select(*KEYS, "avg_unw_cluster"), graph.degree_top(edge)):
        wide = wide.join(part, KEYS, "left")
    names = ["cycle_lengths", "global_efficiency_edges", "global_efficiency_distance", "mfpt"]
    graphs = graph.compressed(moves).join(home.select(*KEYS, "home_loc"), KEYS, "left")
    wide = wide.join(graph_kernel.kernel(graphs, names), KEYS, "left")
    groups = wide.join(clean.select("useruuid", "user_group").distinct(), "useruuid", "left")
    return quantiles.with_groups(groups)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Per user-month visits, repertoire, stay time, travel cost and graph density."""
    clean = _stops(spark, sf)
    names = ["visits", "locations", "total_stay_time", "total_cost_travel_distance"]
    dense = graph.basic(graph.edges(graph.transitions(clean))).select(*KEYS, "nodes", "edges", "density")
    return mobility.mobility(clean, names=names).filter("locations >= 2").join(dense, KEYS, "left")


@query
def user_month_density(spark, sf):
    return flagship(spark, sf)


# Sources, filters, calendar


@query
def invalid_loc_filter(spark, sf):
    clean = source.valid_locations(source.stops_of_events(spark, sf))
    return clean.select("event_id", "useruuid", "loc", "start", "end", F.round("latitude", 6).alias("lat"), F.round("longitude", 6).alias("lon"))


@query
def local_time_shift(spark, sf):
    return source.localised(source.valid_locations(source.stops_of_events(spark, sf))).select("event_id", "start", "end")


@query
def demographic_join(spark, sf):
    raw = source.stops_of_events(spark, sf)
    people = raw.select("useruuid", "gender", "GID_0").distinct()
    joined = source.with_demographics(source.valid_locations(raw).drop("gender", "GID_0"), people)
    return joined.groupBy("gender", "GID_0").agg(F.count("*").alias("stops"), F.count_distinct("useruuid").alias("users"))


def _bucket(name: str):
    def of(spark, sf):
        return _stops(spark, sf).groupBy(name).agg(F.count("*").alias("stops"), F.count_distinct("useruuid").alias("users"))

    return of


for _name in ("start_day", "start_week", "start_month"):
    _REGISTRY["bucket_" + _name[6:]] = _bucket(_name)


@query
def bucket_hourbin(spark, sf):
    by = ["start_hour_bin", "weekday_weekend", "start_week"]
    return _stops(spark, sf).groupBy(*by).agg(F.count("*").alias("stops"))


@query
def days_in_month(spark, sf):
    rows = _stops(spark, sf).select("start_month", calendar.days_in_month(F.col("start")).alias("days"))
    return rows.groupBy("start_month", "days").agg(F.count("*").alias("stops"))


@query
def group_union(spark, sf):
    rows = mobility.mobility(_stops(spark, sf).withColumnRenamed("user_group", "g"), [*KEYS, "g"], ["visits"])
    names = ["00", "01", "02", "03"]
    return source.union_groups([rows.filter(F.col("g") == n).drop("g") for n in names], names).select(*UM, "visits", "user_group")


# Mobility metrics


@query
def visits_locations(spark, sf):
    return mobility.mobility(_stops(spark, sf), names=["visits", "locations"])


@query
def min_repertoire(spark, sf):
    return mobility.mobility(_stops(spark, sf), names=["locations"]).filter("locations >= 2")


@query
def stay_time_coverage(spark, sf):
    return mobility.mobility(_stops(spark, sf), names=["total_stay_time", "coverage_stay_time"])


@query
def travel_time(spark, sf):
    return mobility.mobility(_stops(spark, sf), names=["total_travel_time"])


@query
def travel_cost(spark, sf):
    return mobility.mobility(_stops(spark, sf), names=["total_cost_travel_distance"])


@query
def home_anchor(spark, sf):
    return anchors.night_home(_stops(spark, sf), KEYS, HOME_SHARE)


@query
def labelled_home_anchor(spark, sf):
    return _home(_stops(spark, sf)).select(*KEYS, "home_loc", F.round("home_lat", 6).alias("home_lat"), F.round("home_lon", 6).alias("home_lon"), "total_home_time")


@query
def home_reward(spark, sf):
    clean = kept(_stops(spark, sf))
    return mobility.home_rewards(clean, _home(clean))


@query
def tour_efficiency(spark, sf):
    clean = kept(_stops(spark, sf))
    moved = kept(steps(clean))
    cost = mobility.mobility(moved, names=["total_cost_travel_distance"])
    rows = mobility.with_efficiency(cost.join(mobility.home_rewards(moved, _home(clean)), KEYS))
    return rows.select(*KEYS, "total_cost_travel_distance", "total_reward_home_distance", "tour_efficiency_dist")


@query
def modal_home_work(spark, sf):
    labels = anchors.simple_labels(_stops(spark, sf))
    home, work = (anchors.modal(labels, f"detect_{k}_loc", UM) for k in "HW")
    return home.join(work, UM, "full")


@query
def semantic_labels(spark, sf):
    clean = _stops(spark, sf)
    labels = anchors.simple_labels(clean)
    home, work = (anchors.modal(labels, f"detect_{k}_loc", UM) for k in "HW")
    return anchors.relabelled(clean, home, work, UM).groupBy(*UM, "stops").agg(F.count("*").alias("n"))


@query
def homework_labels(spark, sf):
    clean = _stops(spark, sf)
    found = anchors.label_home_work(clean, **LABELS)
    return found.select("useruuid", "event_id", "loc", "detect_H_loc", "detect_W_loc", "location_type")


# Graphs


@query
def graph_nodes(spark, sf):
    return graph.nodes(_moves(spark, sf))


@query
def graph_edges(spark, sf):
    return graph.edges(_moves(spark, sf))


@query
def od_matrix(spark, sf):
    return graph.flows(_moves(spark, sf))


@query
def graph_basic(spark, sf):
    return graph.basic(graph.edges(_moves(spark, sf)))


@query
def clustering(spark, sf):
    return graph.clustering(graph.edges(_moves(spark, sf)))


@query
def degree_topk(spark, sf):
    return graph.degree_top(graph.edges(_moves(spark, sf)))


@query
def largest_component(spark, sf):
    return graph.largest_component(graph.edges(_moves(spark, sf)))


@query
def edge_distances(spark, sf):
    return graph.edge_distances(_moves(spark, sf))


@query
def ideal_edge_distances(spark, sf):
    return graph.ideal_distances(_moves(spark, sf))


@query
def edge_log_join(spark, sf):
    return graph.log_distances(_moves(spark, sf))


def _kernel(*names: str, home: bool = False):
    def of(spark, sf):
        clean = kept(_stops(spark, sf)) if home else _stops(spark, sf)
        rows = graph.compressed(graph.transitions(clean), pairs="global_efficiency_distance" in names)
        if home:
            rows = rows.join(_home(clean).select(*KEYS, "home_loc"), KEYS, "left")
        return graph_kernel.kernel(rows, list(names))

    return of


_REGISTRY |= {
    "closeness_topk": _kernel("closeness_centrality_top"),
    "eccentricity_diameter": _kernel("eccentricity_stats"),
    "global_efficiency_edges": _kernel("global_efficiency_edges"),
    "node_connectivity": _kernel("avg_node_connectivity"),
    "edge_connectivity": _kernel("edge_connectivity"),
    "cycle_lengths": _kernel("cycle_lengths"),
    "betweenness_topk": _kernel("betweenness_centrality_top"),
    "eigenvector_topk": _kernel("eigenvector_centrality_top"),
    "local_efficiency": _kernel("local_efficiency"),
    "global_efficiency_distance": _kernel("global_efficiency_distance"),
    "mfpt": _kernel("mfpt", home=True),
    "stage_one_metrics": stage_one,
}


# Sequences and tours


def _tours(spark, sf) -> tuple[DataFrame, DataFrame]:
    seen = kept(tours.visits(_stops(spark, sf)))
    return tours.tours(seen), seen


def _text(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


@query
def stop_sequences(spark, sf):
    rows = tours.sequences(_stops(spark, sf))
    places = F.array_join(F.transform("sequence", lambda x: x["loc"].cast("string")), ",")
    return rows.select(*UM, F.size("sequence").cast("long").alias("seq_len"), places.alias("stops"))


@query
def clean_sequences(spark, sf):
    return tours.visits(_stops(spark, sf)).select(*UM, "idx", "loc", "arr", "dep", (F.col("dep") - F.col("arr")).alias("stop_time"))


@query
def tours_all(spark, sf):
    found, _ = _tours(spark, sf)
    return found.select(*UM, "s", "e", "loc", "stay_departure", "total_duration", _text("tour").alias("tour"))


@query
def tour_measures(spark, sf):
    found = tours.measured(*_tours(spark, sf))
    return found.select(*UM, "s", "e", "tour_total_stops", "tour_total_distance", "tour_total_reward", "tour_max_reward")


@query
def keystones(spark, sf):
    return tours.keystones(_tours(spark, sf)[0]).select(*UM, "loc")


@query
def keystone_tours(spark, sf):
    return tours.keystone_tours(_tours(spark, sf)[0]).select(*UM, "s", "e", _text("tour").alias("tour"))


@query
def main_keystone(spark, sf):
    return tours.main_keystone(*_tours(spark, sf)).select(*UM, "main_keystone")


@query
def sequence_efficiency(spark, sf):
    found, seen = _tours(spark, sf)
    return tours.sequence_efficiency(seen, _home(_stops(spark, sf)), tours.main_keystone(found, seen))


def _keystone_measured(spark, sf) -> DataFrame:
    found, seen = _tours(spark, sf)
    return tours.measured(tours.keystone_tours(found), seen)


@query
def tour_summary(spark, sf):
    return tours.summary(_keystone_measured(spark, sf))


def tour_dataset(spark, sf) -> DataFrame:
    groups = user_months(spark, sf).select(*KEYS, "activity_repertoire_groups")
    return tours.tour_rows(_keystone_measured(spark, sf), groups)


@query
def tours_exploded_binned(spark, sf):
    rows = tour_dataset(spark, sf)
    return rows.select(*UM, "s", "tour_total_stops", "total_duration", "leng_bin", "activity_repertoire_groups", _text("tour").alias("tour"))


# Quantile groups


@query
def deciles_groups(spark, sf):
    return user_months(spark, sf).select(*UM, "visits", "locations", "activity_deciles", "repertoire_deciles", "activity_repertoire_groups")


@query
def percentile_alloc(spark, sf):
    return quantiles.percentile_groups(user_months(spark, sf).select(*UM, "total_stay_time"), "total_stay_time", 20)


@query
def decile_share_gap(spark, sf):
    return quantiles.share_gap(user_months(spark, sf), "visits")


@query
def quintile_reward_bins(spark, sf):
    rows = quantiles.grouped(rewarded_months(spark, sf).filter("total_reward_home_distance IS NOT NULL"), {"total_reward_home_distance": "q"}, 5)
    reward = contrasts.reward_bin("total_reward_home_distance")
    return rows.select(*UM, (F.col("q") - 1).alias("quintile"), reward.alias("reward_bin"))


@query
def decile_grid(spark, sf):
    return quantiles.decile_grid(user_months(spark, sf))


@query
def decile_grid_gender_delta(spark, sf):
    return quantiles.grid_delta(user_months(spark, sf))


# Statistics


@query
def hist_density(spark, sf):
    return stats.histogram(user_months(spark, sf), "total_stay_time", ["gender"])


@query
def hist_density_log(spark, sf):
    return stats.log_histogram(user_months(spark, sf), "total_stay_time", ["gender"])


@query
def log_km_labels(spark, sf):
    rows = user_months(spark, sf).filter("total_cost_travel_distance > 0")
    return rows.select(*UM, stats.km_label(F.round(F.log10("total_cost_travel_distance"), 1)).alias("label"))


ORDER = ["total_stay_time", *UM]


@query
def bootstrap_median(spark, sf):
    return stats.bootstrap(user_months(spark, sf), ["gender", "GID_0"], ORDER, F.median("total_stay_time"), TIMES)


@query
def country_weighted_agg(spark, sf):
    boots = stats.bootstrap(user_months(spark, sf), ["gender", "GID_0"], ORDER, F.median("total_stay_time"), TIMES)
    return stats.over_countries(boots, stats.population(spark), ["gender"])


@query
def country_resample(spark, sf):
    rows = stats.resampled(user_months(spark, sf), ["GID_0"], ORDER, 2)
    return rows.groupBy("GID_0", "b", "gender").agg(F.count("*").alias("n"), F.sum("visits").alias("visits"))


@query
def country_resample_weighted(spark, sf):
    rows = stats.resampled(user_months(spark, sf), ["GID_0"], ORDER, 2, shares=stats.population(spark))
    return rows.groupBy("GID_0", "b", "gender").agg(F.count("*").alias("n"), F.sum("visits").alias("visits"))


@query
def rcv(spark, sf):
    return stats.robust_dispersion(user_months(spark, sf), "total_stay_time", ["gender"])


@query
def bootstrap_rcv(spark, sf):
    return stats.bootstrap(user_months(spark, sf), ["gender"], ORDER, stats.rcvq("total_stay_time"), TIMES, 1, 7)


@query
def bootstrap_gap(spark, sf):
    return stats.bootstrap_gap(user_months(spark, sf), "total_stay_time", ["GID_0"], ORDER, TIMES)


@query
def ks_stat(spark, sf):
    return stats.kolmogorov_smirnov(user_months(spark, sf), "total_stay_time", ["start_month"])


@query
def ks_permutation(spark, sf):
    rows = user_months(spark, sf).withColumn("scope", F.lit("all"))
    moved = stats.permuted(rows, "gender", ["scope"], UM, TIMES)
    return stats.kolmogorov_smirnov(moved, "total_stay_time", ["b"])


@query
def ks_permutation_test(spark, sf):
    rows = user_months(spark, sf).withColumn("scope", F.lit("all"))
    return stats.permutation_test(rows, "total_stay_time", ["scope"], UM, TIMES)


@query
def k_gap_by_n_decile(spark, sf):
    each = stats.bootstrap(user_months(spark, sf), ["activity_deciles", "gender"], ORDER, F.median("locations"), TIMES)
    return each.groupBy("activity_deciles").agg(
        F.round(
            F.sum(F.when(F.col("gender") == "MALE", F.col("bs_mean"))) - F.sum(F.when(F.col("gender") == "FEMALE", F.col("bs_mean"))), 6
        ).alias("diff"),
        F.round(F.sqrt(F.sum(F.col("bs_std") * F.col("bs_std"))), 6).alias("se"),
    )


# Matching

METRICS = ["total_stay_time", "total_cost_travel_distance"]
#: Everyone and each country, by everyone and each group of activity.
SCOPE = ["scope_country", "scope_group"]


def _eligible(spark, sf) -> DataFrame:
    # Written, not persisted: what is read in two places of a plan is computed once.
    rows = quantiles.with_groups(materialised(_months(spark, sf), "months"))
    return materialised(matching.scoped(matching.eligible(rows, METRICS, LEAST)), "eligible")


@query
def match_eligible(spark, sf):
    return _eligible(spark, sf).select(*SCOPE, *UM, "gender", "visits", "locations")


@query
def match_m2f(spark, sf):
    return matching.match_male(_eligible(spark, sf), SCOPE)


@query
def match_f2m(spark, sf):
    return matching.match_unmatched_female(_eligible(spark, sf), SCOPE)


def _deltas(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Deltas of the pairs that the caliper of their group allows."""
    return matching.within_caliper(matching.deltas(matching.matched_pairs(rows, scope), rows, METRICS, scope), F.col("scope_group"))


@query
def match_pairs_delta(spark, sf):
    return _deltas(_eligible(spark, sf), SCOPE)


@query
def match_delta_summary(spark, sf):
    return matching.delta_summary(_deltas(_eligible(spark, sf), SCOPE), SCOPE)


def _shuffled(rows: DataFrame, times: int = TIMES, seen: bool = False) -> DataFrame:
    """Summaries of each shuffle b; with seen, also of the rows as they are."""
    moved = stats.permuted(rows, "gender", SCOPE, UM, times)
    if seen:
        moved = moved.unionByName(rows.withColumn("b", F.lit(SEEN).cast("long")))
    moved = materialised(moved, "permuted")
    return matching.delta_summary(_deltas(moved, [*SCOPE, "b"]), [*SCOPE, "b"])


@query
def permutation_baseline(spark, sf):
    return _shuffled(_eligible(spark, sf))


def _mean_differences(rows: DataFrame, times: int) -> DataFrame:
    """mean_rel of each shuffle and of the rows as they are; scopes too large for an Arrow pass are shuffled by Spark."""
    large = rows.groupBy(*SCOPE).count().filter(F.col("count") > matching_kernel.LARGEST).drop("count").collect()
    if not large:
        return matching_kernel.mean_differences(rows, METRICS, SCOPE, "scope_group", times)
    is_large = F.struct(*SCOPE).isin([F.struct(*(F.lit(x[c]).alias(c) for c in SCOPE)) for x in large])
    found = _shuffled(rows.filter(is_large), times, seen=True).select(*SCOPE, "b", "metric", "mean_rel")
    return found.unionByName(matching_kernel.mean_differences(rows.filter(~is_large), METRICS, SCOPE, "scope_group", times))


def _significance(each: DataFrame) -> DataFrame:
    # Small, and read three times. People as they are go with the shuffles: the driver plans their matching once.
    each = materialised(each, "summaries")
    return matching.significance(each.filter(F.col("b") == SEEN).drop("b"), each.filter(F.col("b") != SEEN), SCOPE)


@query
def match_significance(spark, sf):
    return _significance(_mean_differences(_eligible(spark, sf), SHUFFLES))


@query
def match_significance_countries(spark, sf):
    # Over TIMES shuffles, as its SQL.
    return matching.counted_countries(_significance(_shuffled(_eligible(spark, sf), seen=True)))


@query
def anonymise(spark, sf):
    return matching.anonymised(user_months(spark, sf).select("useruuid", "start_month", "visits"))


# Contrasts

TOUR_ORDER = [*UM, "s"]


@query
def palindrome_share(spark, sf):
    rows = tour_dataset(spark, sf)
    three, five = (contrasts.palindrome_share(rows, n, TIMES, TOUR_ORDER).withColumn("shortest", F.lit(n)) for n in (3, 5))
    return three.unionByName(five)


@query
def tour_length_share(spark, sf):
    return contrasts.length_share(tour_dataset(spark, sf))


@query
def gap_by_length(spark, sf):
    return contrasts.gaps(tour_dataset(spark, sf), ["leng_bin"], ["GID_0"], LEAST).drop("n_m", "n_f")


@query
def gap_by_length_bootstrap(spark, sf):
    each = contrasts.bootstrap_gaps(tour_dataset(spark, sf), ["leng_bin"], ["GID_0"], LEAST, TIMES, TOUR_ORDER)
    return contrasts.over_countries(each, ["leng_bin"])


@query
def gap_by_length_distance(spark, sf):
    rows = tour_dataset(spark, sf)
    return contrasts.gaps(rows.withColumn("dist_bin", contrasts.distance_bin(rows)), ["leng_bin"], ["dist_bin", "GID_0"], 1).drop("n_m", "n_f")


@query
def gap_by_length_duration(spark, sf):
    rows = tour_dataset(spark, sf)
    return contrasts.gaps(rows.withColumn("dur_bin", contrasts.duration_bin(rows)), ["leng_bin"], ["dur_bin", "GID_0"], 1).drop("n_m", "n_f")


REWARDED = ["tour_efficiency_dist", "total_cost_travel_distance"]


def _by_reward(spark, sf) -> DataFrame:
    return contrasts.bootstrap_by_reward(rewarded_months(spark, sf), REWARDED, TIMES, ["total_cost_travel_distance", *UM])


@query
def efficiency_cost_bootstrap(spark, sf):
    found = _by_reward(spark, sf)
    rounded = [stats.rounded(F.col(f"{v}_{k}"), 6).alias(f"{v}_{k}") for v in REWARDED for k in ("median", "se")]
    return found.select("gender", "reward_bin", "q_bin", "n_user_months", *rounded)


@query
def efficiency_by_reward(spark, sf):
    found = kept(_by_reward(spark, sf))
    out = []
    for value in REWARDED:
        one = found.select("gender", "reward_bin", "q_bin", F.col(f"{value}_median").alias("mean"), F.col(f"{value}_se").alias("se"), F.col("n_user_months").alias("n"))
        out.append(contrasts.symmetric_gap(one, ["reward_bin", "q_bin"], 1).withColumn("value", F.lit(value)))
    return out[0].unionByName(out[1])
