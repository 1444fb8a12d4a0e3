"""Runs from files to files, result texts, and what queries keep and release."""

import pytest
from pyspark.sql import functions as F

from stopflow.operators import matching, stats
from stopflow.plans import catalogue, runs
from stopflow.sources import generator, stops as source, working

HOME = {"coverage": 0.1, "home_valid": 0.05, "work_valid": 0.05, "home_share": 0.2, "work_share": 0.2, "work_presence": 0.1}


@pytest.fixture(scope="module")
def config(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    made = generator.stops(users=12, seed=5)
    source.write_parquet(spark.createDataFrame(made), f"{root}/stops")
    source.write_parquet(spark.createDataFrame(generator.demographics(made)), f"{root}/people")
    (root / "run.yaml").write_text(
        f"stops: {root}/stops\ndemographics: {root}/people\noutput: {root}/out\n"
        "mobility_metrics: [visits, locations, total_cost_travel_distance]\n"
        "network_metrics: [nodes, edges, avg_unw_cluster, global_efficiency_edges, mfpt]\n"
        f"home: {HOME}\n"
    )
    return source.load_config(str(root / "run.yaml"))


def test_metrics_run(spark, config):
    runs.run_metrics(spark, config)
    rows = spark.read.parquet(f"{config.output}/metrics")
    wanted = {*config.keys, "visits", "locations", "total_reward_home_distance", "tour_efficiency_dist", "nodes", "avg_unw_cluster", "nwide_MFPT_lovasz", "activity_deciles", "user_group"}
    assert wanted <= set(rows.columns) and rows.count() > 10
    assert rows.filter("locations < 2 OR visits IS NULL").count() == 0
    assert rows.filter("has_home = 1 AND total_reward_home_distance > 0").count() > 0
    assert rows.filter("edges < nodes - 1").count() == 0
    assert not working._kept


def test_tours_run(spark, config):
    runs.run_tours(spark, config)
    one, two = (spark.read.parquet(f"{config.output}/{n}") for n in ("sequences", "tours"))
    summary = source.read_csv(spark, f"{config.output}/tour_summary", "useruuid string, gender string, GID_0 string, start_month long, jrny_total long")
    assert one.filter("efficiency_home IS NOT NULL").count() > 0
    assert summary.agg(F.sum("jrny_total")).first()[0] == two.count() > 0


def test_results_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("all", "active", 1.5, 0), ("all", "all", None, 1), ("USA", "all", -0.5, 0)], "country string, people string, mean double, b long")
    source.write_results(rows, str(tmp_path / "r"))
    back = source.read_results(spark, str(tmp_path / "r"), "people string, mean double, b long")
    assert sorted(map(str, back.select(*rows.columns).collect())) == sorted(map(str, rows.collect()))


def test_groups_without_a_caliper_are_an_error(spark):
    rows = spark.createDataFrame([("active", 4), ("active", 5), ("moderate", -2), ("all", 2)], "g string, d_locations long")
    assert [r.d_locations for r in matching.within_caliper(rows, F.col("g")).collect()] == [4, -2]
    with pytest.raises(Exception, match="no caliper"):
        matching.within_caliper(rows.withColumn("g", F.lit("other")), F.col("g")).collect()


def test_scopes(spark):
    rows = spark.createDataFrame([("u", "USA", "active"), ("v", "DEU", "other")], "useruuid string, GID_0 string, activity_repertoire_groups string")
    got = sorted((r.useruuid, r.scope_country, r.scope_group) for r in matching.scoped(rows).collect())
    assert got == [("u", "USA", "active"), ("u", "USA", "all"), ("u", "all", "active"), ("u", "all", "all"), ("v", "DEU", "all"), ("v", "all", "all")]


def test_km_labels(spark):
    rows = spark.createDataFrame([(-1.0,), (0.5,), (1.5,), (3.2,)], "p double").select(stats.km_label(F.col("p")).alias("x"))
    assert [r.x for r in rows.collect()] == ["0.10", "3.2", "31", "1,584"]


def test_queries_release_what_earlier_ones_kept(spark, sf):
    queries = catalogue.queries()
    assert queries["deciles_groups"](spark, sf).count() > 0
    assert working._kept
    assert queries["visits_locations"](spark, sf).count() > 0
    assert not working._kept


def test_stage_one_agrees_with_its_parts(spark, sf):
    wide = {(r.useruuid, r.start_month): r for r in catalogue.queries()["stage_one_metrics"](spark, sf).collect()}
    for name, columns in (
        ("home_reward", ["has_home", "total_reward_home_distance"]),
        ("tour_efficiency", ["total_cost_travel_distance", "tour_efficiency_dist"]),
        ("graph_basic", ["nodes", "edges", "density"]),
        ("clustering", ["avg_unw_cluster"]),
        ("global_efficiency_distance", ["global_efficiency_distance"]),
        ("mfpt", ["home_GMFPT_lovasz", "nwide_MFPT_lovasz"]),
        ("cycle_lengths", ["avg_len_cycles_all"]),
    ):
        rows = catalogue.queries()[name](spark, sf).collect()
        assert any((r.useruuid, r.start_month) in wide for r in rows)
        for r in rows:
            if (one := wide.get((r.useruuid, r.start_month))) is not None:
                assert [one[c] for c in columns] == [r[c] for c in columns], name


def test_no_shared_folder_is_an_error_on_a_cluster(spark):
    class Away:
        """A session of a cluster without spark.checkpoint.dir."""

        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Away.conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        working.shared_dir(Away)
