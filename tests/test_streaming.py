import datetime as dt

from pyspark.sql import functions as F

from tapeloom.plans import landing
from tapeloom.session import shared_folder
from tapeloom.streaming.bars import compact, deduplicated, deliver, newest_rows, tick_bars, write_versions


def test_tick_bars_and_versions(spark, tmp_path):
    schema = "ticker string, ts timestamp, price double, event_id bigint"
    base = dt.datetime(2024, 1, 2, 10, 0)
    rows = [("A", base + dt.timedelta(minutes=3 * k), float(k % 4), k) for k in range(20)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    ticks = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    write_versions(tick_bars(ticks), out, str(tmp_path / "ck"), "update").awaitTermination()
    got = newest_rows(spark, out, ["ticker", "ts"]).orderBy("ts").collect()
    assert [x.volume for x in got] == [5, 5, 5, 5] and got[0].open == 0.0 and got[0].close == 0.0 and got[1].high == 3.0


def test_redelivered_batches_change_nothing(spark, tmp_path):
    rows = [("A", "2024-01-02", 1.0), ("A", "2024-01-03", 2.0)]
    df = spark.createDataFrame(rows, "ticker string, dt string, close double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for run in ("one", "two"):  # the second run starts over, as after a lost checkpoint
        write_versions(feed, str(tmp_path / "t"), str(tmp_path / run)).awaitTermination()
    got = newest_rows(spark, str(tmp_path / "t"), ["ticker", "dt"]).orderBy("dt").collect()
    assert [x.close for x in got] == [1.0, 2.0]


def test_a_restart_from_nothing_wins_over_higher_batch_numbers(spark, tmp_path):
    schema = "ticker string, dt string, close double"
    old = spark.createDataFrame([("A", "2024-01-02", 1.0), ("A", "2024-01-03", 2.0)], schema)
    old.write.parquet(str(tmp_path / "t" / "run=1" / "batch=7"))
    spark.createDataFrame([("A", "2024-01-03", 5.0)], schema).write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    write_versions(feed, str(tmp_path / "t"), str(tmp_path / "lost")).awaitTermination()
    got = newest_rows(spark, str(tmp_path / "t"), ["ticker", "dt"]).orderBy("dt").collect()
    assert [x.close for x in got] == [1.0, 5.0]
    compact(spark, str(tmp_path / "t"), str(tmp_path / "c"), ["ticker", "dt"])
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2


def test_repeated_deliveries_are_dropped(spark, tmp_path):
    schema = "ticker string, ts timestamp, close double"
    at = dt.datetime(2024, 1, 2)
    spark.createDataFrame([("A", at, 1.0), ("A", at, 1.0), ("B", at, 2.0)], schema).write.parquet(str(tmp_path / "in"))
    feed = deduplicated(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["ticker", "ts"])
    write_versions(feed, str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_a_delivery_is_dealt_over_its_files_and_taken_whole(spark, tmp_path):
    for k, rows in enumerate((1000, 2, 0, 50)):
        deliver(spark.range(rows).withColumn("k", F.lit(k)), str(tmp_path / "in" / f"delivery={k}"), 4)
        files = spark.read.schema("id bigint").parquet(str(tmp_path / "in" / f"delivery={k}"))
        assert len(files.inputFiles()) == 4 and files.count() == rows
    most = spark.read.parquet(str(tmp_path / "in" / "delivery=0")).groupBy(F.input_file_name()).count().agg(F.max("count"))
    assert most.first()[0] <= 300
    feed = spark.readStream.schema("id bigint, k int, delivery int").option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    write_versions(feed, str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "t")).groupBy("batch", "k").count().collect()
    assert {(r.batch, r.k, r["count"]) for r in got} == {(0, 0, 1000), (1, 1, 2), (3, 3, 50)}


def test_corrections_are_landed_by_many_tasks(spark, monkeypatch):
    landed = []
    monkeypatch.setattr(landing, "shared_folder", lambda spark, name: landed.append(shared_folder(spark, name)) or landed[-1])
    rows = landing.stream_corrections(spark, "/root/testdata/sf0.01")
    assert rows.count() == 10_000
    for k in range(3):
        each = spark.read.parquet(f"{landed[0]}/in/delivery={k}").groupBy(F.input_file_name()).count()
        assert each.count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
