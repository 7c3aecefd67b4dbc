import datetime as dt

from gustfield.streaming import streams

SCHEMA = "id long, station long, time timestamp, speed double, from_deg double"


def feed(spark, tmp_path, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        yield k


def at(h, m=0):
    return dt.datetime(2024, 1, 1, h, m)


def run(spark, df, name, mode, tmp_path):
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()


def test_hours_close_behind_the_watermark(spark, tmp_path):
    (tmp_path / "in").mkdir()
    q = run(spark, streams.hourly(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))), "hours", "append", tmp_path)
    for _ in feed(spark, tmp_path, [[(1, 1, at(0, 10), 2.0, 90.0), (2, 1, at(0, 20), 4.0, 90.0)], [(3, 1, at(6), 1.0, 0.0)], [(4, 1, at(0, 30), 9.0, 0.0)], [(5, 1, at(12), 1.0, 0.0)]]):
        q.processAllAvailable()
    q.stop()
    got = {r.begin.hour: (r.n, r.mean_speed) for r in spark.sql("select * from hours").collect()}
    assert got[0] == (2, 3.0)  # the late row of the third batch is dropped


def test_last_value_survives_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    q = run(spark, streams.last_values(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).select("station", "time", "speed", "from_deg")), "lasts", "update", tmp_path)
    for _ in feed(spark, tmp_path, [[(1, 1, at(1), 2.0, 90.0), (2, 2, at(1), 4.0, 10.0)], [(3, 1, at(0, 30), 9.0, 0.0)], [(4, 1, at(2), 5.0, 0.0)]]):
        q.processAllAvailable()
    q.stop()
    got = [(r.station, r.time.hour, r.speed) for r in spark.sql("select * from lasts where not expired").collect()]
    assert (1, 2, 5.0) in got and (1, 0, 9.0) not in got and (2, 1, 4.0) in got


def test_bursts(spark):
    d = spark.createDataFrame([(1, 1, at(0), 1.0, 0.0), (2, 1, at(1, 30), 1.0, 0.0), (3, 1, at(5), 1.0, 0.0)], SCHEMA)
    assert sorted((r.begin.hour, r.n) for r in streams.bursts(d).collect()) == [(0, 2), (5, 1)]


def test_stale(spark):
    d = spark.createDataFrame([(1, 1, at(0), 1.0, 0.0)], SCHEMA).withColumnRenamed("time", "valid_time")
    assert streams.fresh(d, "2024-01-01 02:15:00").first().stale is False
    assert streams.fresh(d, "2024-01-01 02:15:01").first().stale is True
