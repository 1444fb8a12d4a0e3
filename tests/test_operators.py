"""Hand-made fixtures: calendar, distance, tours, quantiles, statistics, matching, sources."""

import math

import pytest
from pyspark.sql import functions as F

from stopflow.functions import calendar, geo, mixer
from stopflow.operators import matching, matching_kernel, mobility, quantiles, stats, tours
from stopflow.plans import catalogue
from stopflow.sources import generator, stops as source, working

KEYS = ["useruuid"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def visits_of(spark, places, stay=10, gap=1):
    rows = [("u", i, ord(p), i * (stay + gap), i * (stay + gap) + stay, 0.0, ord(p) / 100.0) for i, p in enumerate(places)]
    stops = spark.createDataFrame(rows, "useruuid string, event_id long, loc long, start long, end long, latitude double, longitude double")
    return tours.visits(stops, KEYS)


@pytest.mark.parametrize(
    ("places", "want"),
    [
        ("ABA", [(1, 3)]),
        ("ABACA", [(1, 3), (3, 5)]),
        ("ABCBA", [(2, 4), (1, 5)]),
        ("AABBA", [(1, 3)]),
        ("ABCD", []),
        ("A", []),
    ],
)
def test_tours(spark, places, want):
    found = tours.tours(visits_of(spark, places), KEYS).collect()
    assert sorted((r.s, r.e) for r in found) == sorted(want)


def test_runs_merge(spark):
    rows = visits_of(spark, "AAB").orderBy("idx").collect()
    assert [(r.idx, r.arr, r.dep) for r in rows] == [(1, 0, 21), (2, 22, 32)]


def test_keystone_needs_a_strictly_longer_stay(spark):
    assert tours.keystones(tours.tours(visits_of(spark, "ABA", stay=10, gap=1), KEYS), KEYS).count() == 0
    long = spark.createDataFrame(
        [("u", 0, 1, 0, 100, 0.0, 0.0), ("u", 1, 2, 110, 120, 0.0, 1.0), ("u", 2, 1, 130, 140, 0.0, 0.0)],
        "useruuid string, event_id long, loc long, start long, end long, latitude double, longitude double",
    )
    assert tours.keystones(tours.tours(tours.visits(long, KEYS), KEYS), KEYS).first().loc == 1


def test_length_bins(spark):
    got = spark.createDataFrame([(n,) for n in (2, 3, 6, 7, 10, 11, 20, 21)], "n int").select(tours.length_bin(F.col("n")).alias("b"))
    assert [r.b for r in got.collect()] == [None, "3\nABA", "6", "7-10", "7-10", "11-20", "11-20", "20+"]


def test_calendar(spark):
    evening = 1706743800  # 2024-01-31 23:30 UTC, a Wednesday
    assert one(spark, calendar.month(F.lit(evening + 3600))) == 1706745600
    assert one(spark, calendar.month(F.lit(evening - 18000))) == 1704067200
    assert one(spark, calendar.week(F.lit(evening))) == 1706486400
    assert one(spark, calendar.days_in_month(F.lit(evening + 3600))) == 29
    assert one(spark, calendar.day_kind(F.lit(evening))) == "weekday"
    assert one(spark, calendar.daily_overlap(F.lit(5 * 3600), F.lit(86400 + 7 * 3600), 6)) == 7 * 3600


def test_distance(spark):
    def km(*x):
        return one(spark, geo.great_circle(*map(F.lit, map(float, x))))

    assert km(10, 20, 10, 20) == 0
    assert km(0, 0, 0, 180) == pytest.approx(math.pi * 6371)
    assert math.isfinite(km(50, 8, 50 + 1e-9, 8))


def test_mixer_is_portable(spark):
    def plain(i, b, seed=0):
        x = (i * 1103515245 + b * 40503 * 65537 + seed) % mixer.PRIME
        for r in range(3):
            x = (x * x + 12345 + 7919 * r + i + 31 * b) % mixer.PRIME
        return x

    rows = spark.range(50).select(mixer.mixed(F.col("id"), F.lit(3).cast("long"), 7).alias("x")).collect()
    assert [r.x for r in rows] == [plain(i, 3, 7) for i in range(50)]


def test_travel_time_window(spark):
    gaps = [-5, 0, 43199, 43200]
    rows, at = [], 0
    for i, g in enumerate([0, *gaps]):
        at += g
        rows.append(("u", i, i, at, at + 100, 0.0, float(i)))
        at += 100
    stops = spark.createDataFrame(rows, "useruuid string, event_id long, loc long, start long, end long, latitude double, longitude double")
    assert mobility.mobility(stops, KEYS, ["total_travel_time"]).first().total_travel_time == 43199


def test_unknown_metric(spark):
    stops = spark.createDataFrame([], "useruuid string, event_id long, loc long, start long, end long, latitude double, longitude double")
    with pytest.raises(KeyError):
        mobility.mobility(stops, KEYS, ["none"])


def test_deciles(spark):
    rows = spark.createDataFrame([(i,) for i in range(1, 12)], "x long")
    got = [r.q for r in quantiles.grouped(rows, {"x": "q"}).orderBy("x").collect()]
    assert got == [1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    ties = spark.createDataFrame([(1,)] * 8 + [(2,), (3,)], "x long")
    assert {r.x: r.q for r in quantiles.grouped(ties, {"x": "q"}).collect()} == {1: 1, 2: 2, 3: 3}


def test_fixed_bins(spark):
    cuts = [0.0, 1.0, 2.0]
    got = [one(spark, quantiles.fixed_bin(F.lit(x), cuts)) for x in (-0.1, 0.0, 1.0, 1.1, 2.0, 2.1)]
    assert got == [None, 0, 0, 1, 1, None]


def test_kolmogorov_smirnov(spark):
    rows = [("a", "MALE", x) for x in (1.0, 2.0, 3.0, 4.0)] + [("a", "FEMALE", x) for x in (3.0, 4.0, 5.0, 6.0)]
    got = stats.kolmogorov_smirnov(spark.createDataFrame(rows, "s string, gender string, v double"), "v", ["s"]).first()
    assert (got.d_greater, got.d_less, got.loc_greater) == (0.5, 0.0, 2.0)


def test_matching_ties_and_empty_second_stage(spark):
    rows = [("m1", 1, "MALE", 5, 5), ("f2", 1, "FEMALE", 6, 5), ("f1", 1, "FEMALE", 6, 5)]
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, useruuid string, start_month long, gender string, visits long, locations long")
    assert matching.match_male(df, ["g"]).first().b_useruuid == "f1"
    assert [r.a_useruuid for r in matching.match_unmatched_female(df, ["g"]).collect()] == ["f2"]
    only = df.filter("useruuid <> 'f2'")
    assert matching.match_unmatched_female(only, ["g"]).count() == 0


def test_permuted_and_matched_rows_are_not_broadcast(spark):
    """A working table of few distinct values is small on disk and large in memory: broadcasts of it filled the driver."""

    def joins(df):
        plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
        return [next(j for j in ("SortMerge", "Broadcast", "Shuffled") if j in line) for line in plan if "Join" in line]

    rows = [("g", f"u{i}", 1, "MALE" if i % 3 else "FEMALE", i % 5, i % 7) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, useruuid string, start_month long, gender string, visits long, locations long")
    table = working.materialised(df)
    assert set(joins(stats.permuted(table, "gender", ["g"], matching.ID, 2))) == {"SortMerge"}
    assert joins(matching.match_male(table, ["g"]))[:2] == ["SortMerge"] * 2  # the third joins points with a row a scope
    pairs = matching.matched_pairs(table, ["g"])
    found = matching.deltas(working.materialised(pairs), table, ["visits"], ["g"])
    assert joins(found) == ["SortMerge"] * 2
    by_id = {r[1]: r for r in rows}
    want = {(r.m_useruuid, r.f_useruuid, m, float(by_id[r.m_useruuid][k] - by_id[r.f_useruuid][k])) for r in pairs.collect() for m, k in (("visits", 4), ("locations", 5))}
    assert {(r.m_useruuid, r.f_useruuid, r.metric, r.abs_dif) for r in found.collect()} == want


@pytest.mark.parametrize("largest", [10**6, 50, 0])
def test_shuffles_in_arrow_passes_are_those_by_rows(spark, monkeypatch, largest):
    """Ties, equal controls, one gender only, a row alone, ids in another order than rows, several blocks, and scopes too large for a pass."""
    groups = {"all": 90, "inactive": 40, "moderate": 30, "active": 2}
    rows = [
        (c, g, f"u{i * 7 % 90}", i % 2, "MALE" if c == "X" or (i * i + i // 3) % 3 else "FEMALE", 5 if g == "moderate" else 3 + i * i % 11, 3 + i % 5, i * 37 % 50 + 1, i * i % 101 / 7 + 0.01)
        for c in ("all", "AUS", "X") for g, n in groups.items() for i in range(n)
    ]
    schema = "scope_country string, scope_group string, useruuid string, start_month long, gender string, visits long, locations long, total_stay_time long, total_cost_travel_distance double"
    table = working.materialised(spark.createDataFrame([*rows, ("Y", "all", "u0", 1, "MALE", 5, 5, 1, 1.0)], schema))
    monkeypatch.setattr(matching_kernel, "WORK", 200)
    monkeypatch.setattr(matching_kernel, "FEWEST", 2)
    monkeypatch.setattr(matching_kernel, "LARGEST", largest)

    def values(df):
        return {tuple(r[:4]): r[4] for r in df.select(*catalogue.SCOPE, "b", "metric", "mean_rel").collect()}

    want, got = values(catalogue._shuffled(table, 5, seen=True)), values(catalogue._mean_differences(table, 5))
    assert want.keys() == got.keys() and len({k[2] for k in want}) == 6
    assert {k: (want[k], got[k]) for k in want if abs(want[k] - got[k]) > 2e-12} == {}


def test_arrow_passes_are_spread_over_tasks(spark):
    """Blocks are few bytes and much work: dealt by size, all of sf0.1 was one task."""
    schema = "scope_country string, scope_group string, useruuid string, start_month long, gender string, visits long, locations long, total_stay_time long, total_cost_travel_distance double"
    rows = [("all", "all", f"u{i}", 1, "MALE" if i % 2 else "FEMALE", i, i, 1, 1.0) for i in range(300)]
    found = matching_kernel.mean_differences(spark.createDataFrame(rows, schema), catalogue.METRICS, catalogue.SCOPE, "scope_group", 1000)
    assert found.select(F.spark_partition_id()).distinct().count() == 2  # 300 * 1001 rows are two blocks


def test_arrow_pass_needs_a_caliper(spark):
    row = ("all", "other", "u1", 1, "MALE", 5, 5, 1, 1.0)
    df = spark.createDataFrame([row], "scope_country string, scope_group string, useruuid string, start_month long, gender string, visits long, locations long, total_stay_time long, total_cost_travel_distance double")
    with pytest.raises(Exception, match="no caliper for group other"):
        matching_kernel.mean_differences(df, catalogue.METRICS, catalogue.SCOPE, "scope_group", 2).collect()


def test_reward_medians_round_as_the_sql_does(spark, monkeypatch):
    """Means of ten medians often end in a half of the sixth decimal."""
    import duckdb

    from stopflow.plans import catalogue

    values = [(2 * i + 1) * 5e-7 * sign for i in range(0, 200000, 97) for sign in (1, -1)]
    names = [f"{v}_{k}" for v in catalogue.REWARDED for k in ("median", "se")]
    rows = spark.createDataFrame([("MALE", 1, i, 1, x, x, x, x) for i, x in enumerate(values)], ["gender", "reward_bin", "q_bin", "n_user_months", *names])
    monkeypatch.setattr(catalogue, "_by_reward", lambda spark, sf: rows)
    got = {r.q_bin: r.tour_efficiency_dist_median for r in catalogue.efficiency_cost_bootstrap(spark, "").collect()}
    want = [duckdb.execute("SELECT round(x, 6) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()]
    assert [got[i] for i in range(len(values))] == [x for (x,) in want[0]]


def test_steady_mean_is_exact_in_any_order(spark):
    values = [0.1, 1e9, 0.07069, -1e9, 0.3, 1090.414454, 0.7]
    for rows in (values, values[::-1], sorted(values, key=abs)):
        df = spark.createDataFrame([(x,) for x in rows], "x double")
        assert df.repartition(3).agg(stats.steady_mean("x")).first()[0] == math.fsum(values) / len(values)
    assert spark.createDataFrame([(None,)], "x double").agg(stats.steady_mean("x")).first()[0] is None


def test_generated_stops(spark, tmp_path):
    made = generator.stops(users=6, seed=3)
    again = generator.stops(users=6, seed=3)
    assert made.equals(again)
    df = spark.createDataFrame(made)
    path = str(tmp_path / "stops")
    source.write_parquet(df, path)
    assert source.user_groups(spark, path)[0].startswith("user_group=")
    assert source.read_stops(spark, path).count() == len(made)
    assert source.user_groups(spark, str(tmp_path / "none")) == []


def test_config(tmp_path):
    with pytest.raises(FileNotFoundError):
        source.load_config(str(tmp_path / "none.yaml"))
    (tmp_path / "a.yaml").write_text("keys: [useruuid]\nextra: 1\n")
    config = source.load_config(str(tmp_path / "a.yaml"))
    assert config.keys == ["useruuid"] and config.other == {"extra": 1}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, 2])], "u string, t array<int>")
    source.write_csv(df, str(tmp_path / "c"))
    assert source.read_csv(spark, str(tmp_path / "c"), "u string, t string").first().t == "[1,2]"
