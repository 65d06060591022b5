from pyspark.sql import functions as F

from memlake.streaming import journal as J


def test_drain_is_idempotent(spark, tmp_path):
    rows = [(1, "a", "added"), (2, None, "added"), (3, None, "git"), (4, "b", "odd"), (5, "a", "modified")]
    table = spark.createDataFrame(rows, "seq long, path string, change string")
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    table.repartition(3).write.parquet(source)
    for _ in range(2):
        J.drain(J.changes(spark, source, table.schema), check, J.write_batch(target))
    assert sorted(r.seq for r in spark.read.parquet(target).collect()) == [1, 3, 5]


def test_life_cycle(spark, tmp_path):
    rows = [(1, 1, "in_progress"), (1, 2, "completed"), (1, 3, "failed"), (2, 1, "created"), (2, 2, "abandoned")]
    table = spark.createDataFrame(rows, "event_id long, seq long, wanted string")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = J.life_cycle(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("lc").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.event_id, r.seq): (r.accepted, r.state) for r in spark.table("lc").collect()}
    assert got == {(1, 1): (True, "in_progress"), (1, 2): (True, "completed"), (1, 3): (False, "completed"), (2, 1): (False, "created"), (2, 2): (True, "abandoned")}


def test_windows(spark):
    events = spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), (F.col("id") % 2).alias("user_id"))
    assert [r.n for r in J.window_counts(events).orderBy("start").collect()] == [60, 40]
    assert J.session_counts(events).count() == 2
