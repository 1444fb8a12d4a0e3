"""Sources and sinks of stop records, demographics and results."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions import calendar

#: A stay of a person at a place; times are epoch seconds, timezone the seconds to add for local time.
STOPS = StructType(
    [
        StructField("useruuid", StringType()),
        StructField("loc", LongType()),
        StructField("start", LongType()),
        StructField("end", LongType()),
        StructField("latitude", DoubleType()),
        StructField("longitude", DoubleType()),
        StructField("timezone", LongType()),
    ]
)
DEMOGRAPHICS = StructType([StructField(c, StringType()) for c in ("useruuid", "gender", "GID_0", "NAME_0")])
KEYS = ["useruuid", "gender", "GID_0", "start_month"]
COUNTRIES = ["AUS", "DEU", "ESP", "FRA", "GBR", "JPN", "NLD", "SWE", "TWN", "USA"]


@dataclass(frozen=True)
class Config:
    """Settings of a run, read from a YAML mapping; unknown names are kept in `other`."""

    keys: list[str] = field(default_factory=lambda: list(KEYS))
    mobility_metrics: list[str] = field(default_factory=list)
    network_metrics: list[str] = field(default_factory=list)
    home: dict = field(default_factory=dict)
    stops: str = ""
    demographics: str = ""
    output: str = ""
    least_locations: int = 2
    other: dict = field(default_factory=dict)


def load_config(path: str) -> Config:
    """Reads a YAML file; FileNotFoundError if there is none."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    import yaml

    with open(path, encoding="utf-8") as file:
        found = yaml.safe_load(file) or {}
    names = ["keys", "mobility_metrics", "network_metrics", "home", "stops", "demographics", "output", "least_locations"]
    known = {k: found.pop(k) for k in names if k in found}
    return Config(**known, other=found)


def session(cores: str = "*", memory: str = "4g", name: str = "stopflow") -> SparkSession:
    """A local session in UTC with adaptive execution and Arrow transfers."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def read_stops(spark: SparkSession, path: str, group: str | None = None) -> DataFrame:
    """All partitions user_group=NN below a root in one scan; a group given prunes to its partition."""
    schema = StructType([*STOPS.fields, StructField("user_group", StringType())])
    stops = spark.read.schema(schema).parquet(path)
    return stops.filter(F.col("user_group") == group) if group else stops


def user_groups(spark: SparkSession, path: str) -> list[str]:
    """The sorted partitions of a root; none if it is missing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(hadoop):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(hadoop) if s.getPath().getName().startswith("user_group="))


def read_demographics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DEMOGRAPHICS).parquet(path)


def write_parquet(df: DataFrame, path: str, by: str | None = "user_group") -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by and by in df.columns else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns become JSON text."""
    nested = [c for c, kind in df.dtypes if kind.startswith(("array", "struct", "map"))]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_results(rows: DataFrame, path: str, by: str = "country") -> None:
    """One JSON text for each value of a column: its other columns, a list of objects, below by=value."""
    rest = [c for c in rows.columns if c != by]
    whole = rows.groupBy(by).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rest)))).alias("value"))
    whole.write.mode("overwrite").partitionBy(by).text(path)


def read_results(spark: SparkSession, path: str, schema: str, by: str = "country") -> DataFrame:
    """The rows that write_results() wrote; schema is that of one object."""
    read = spark.read.text(path)
    return read.select(by, F.inline(F.from_json("value", f"array<struct<{schema}>>")))


def union_groups(parts: list[DataFrame], names: list[str]) -> DataFrame:
    """UNION ALL by name, with the group of each part in user_group."""
    out = None
    for part, name in zip(parts, names, strict=True):
        one = part.withColumn("user_group", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def stops_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw stops over the events and customer tables, with demographics and user_group; event_id breaks ties."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("nk")
    )
    k = F.get_json_object("props", "$.k").cast("long")
    st = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    later = F.lead("st").over(Window.partitionBy("user_id").orderBy("st", "event_id"))
    loc, user, nk = F.col("loc"), F.col("user_id"), F.col("nk")
    return (
        events.select("event_id", "user_id", st.alias("st"), "value", k.alias("k"))
        .withColumn("end", F.least(F.col("st") + 60 + F.floor(F.col("value") * 600), later))
        .withColumn(
            "loc",
            F.when(F.col("event_id") % 97 == 0, F.lit(-1))
            .when(F.col("event_id") % 89 == 0, F.lit(None))
            .otherwise(F.floor(F.col("k") * F.col("k") / 625))
            .cast("long"),
        )
        .join(people, "user_id")
        .select(
            user.cast("string").alias("useruuid"),
            "event_id",
            "loc",
            F.col("st").alias("start"),
            "end",
            (nk * 7 % 100 - 50 + (loc * 37 % 101 - 50) * F.lit(0.002)).alias("latitude"),
            (nk * 13 % 300 - 150 + (loc * 53 % 101 - 50) * F.lit(0.003)).alias("longitude"),
            ((nk % 10 - 5) * 3600).alias("timezone"),
            F.when(user % 11 == 0, None).when(user % 2 == 0, "FEMALE").otherwise("MALE").alias("gender"),
            F.get(F.array(*map(F.lit, COUNTRIES)), (nk % 10).cast("int")).alias("GID_0"),
            F.lpad((user % 4).cast("string"), 2, "0").alias("user_group"),
        )
    )


def with_tie_breaker(stops: DataFrame) -> DataFrame:
    """Stops with an event_id that orders equal starts, from their columns where a source has none."""
    return stops if "event_id" in stops.columns else stops.withColumn("event_id", F.xxhash64("end", "loc", "latitude", "longitude"))


def valid_locations(stops: DataFrame) -> DataFrame:
    """Stops with a location: neither null nor -1."""
    return stops.filter("loc IS NOT NULL AND loc <> -1")


def localised(stops: DataFrame) -> DataFrame:
    """start and end in local time, with the calendar buckets of the start."""
    moved = stops.withColumn("start", F.col("start") + F.col("timezone")).withColumn("end", F.col("end") + F.col("timezone"))
    start = F.col("start")
    return moved.withColumns(
        {
            "start_day": calendar.day(start),
            "start_week": calendar.week(start),
            "start_month": calendar.month(start),
            "start_hour_bin": calendar.hour_bin(start),
            "weekday_weekend": calendar.day_kind(start),
        }
    )


def with_demographics(stops: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """Stops of people whose gender is known; people joins one row a user, broadcast when the planner finds it small."""
    joined = stops.join(people, "useruuid", "left") if people is not None else stops
    return joined.filter(F.col("gender").isNotNull())


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean local stops of known people over the driver's tables."""
    return with_demographics(localised(valid_locations(stops_of_events(spark, sf_dir))))


def ordered(keys: list[str]) -> Window:
    """A key's stops in time order."""
    return Window.partitionBy(*keys).orderBy("start", "event_id")


def column(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name
