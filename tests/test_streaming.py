"""A stream of files gives what the same rows give as a batch."""

from stopflow.sources import generator
from stopflow.sources.stops import STOPS
from stopflow.streaming import stops as streaming


def test_daily_stream_is_the_batch(spark, tmp_path):
    rows = spark.createDataFrame(generator.stops(users=3, seed=1)).select(*(f.name for f in STOPS.fields))
    path = str(tmp_path / "in")
    rows.repartition(3).write.parquet(path)
    query = streaming.daily(streaming.read_stream(spark, path)).writeStream.format("memory").queryName("daily").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    batch = streaming.daily(spark.read.schema(STOPS).parquet(path))
    assert sorted(spark.table("daily").collect()) == sorted(batch.collect())
    assert streaming.sessions(spark.read.schema(STOPS).parquet(path)).count() >= 3
