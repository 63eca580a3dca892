import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import scalar
from tapeloom.sources import feeds, store

C = F.col


def test_grouped_payload_is_cleaned_and_idempotent(spark, tmp_path):
    body = {
        "status": "OK",
        "results": [
            {"T": " aaa ", "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 10},
            {"T": "AAA", "c": None},
            {"T": "BBB", "o": None, "c": 3.0},
            {"T": "ZZZ", "c": 9.0, "v": 1},
        ],
    }
    (tmp_path / "day.json").write_text(json.dumps(body, indent=1))
    universe = spark.createDataFrame([("AAA",), ("BBB",)], "ticker string")
    rows = feeds.ingest_grouped(feeds.read_grouped(spark, str(tmp_path), "2024-03-01"), universe)
    got = {x.ticker: (x.open, x.close, x.volume) for x in rows.collect()}
    assert got == {"AAA": (1.0, 1.5, 10), "BBB": (None, 3.0, 0)}
    current = rows.withColumn("batch", F.lit(0))
    again = rows.withColumns({"close": C("close") + 1, "batch": F.lit(1)})
    twice = store.upsert_known(current, again.unionByName(again), "batch")
    assert {x.ticker: x.close for x in twice.collect()} == {"AAA": 2.5, "BBB": 4.0}


def test_wide_download(spark):
    row = (dt.date(2024, 1, 2), 1.0, 2.0, 0.5, 1.5, None, None, None, None, None, 7)
    names = [f"{f}_{t} double" for t in ("A", "B") for f in ("Open", "High", "Low", "Close", "Volume")]
    schema = "dt date, " + ", ".join(names)
    wide = spark.createDataFrame([tuple(float(v) if isinstance(v, int) else v for v in row)], schema)
    got = feeds.melt_wide(wide, ["A", "B"]).collect()
    assert [(x.ticker, x.close, x.volume) for x in got] == [("A", 1.5, 0)]


def test_pending_days(spark):
    latest = spark.createDataFrame([("A", dt.date(2026, 7, 29))], "ticker string, last_dt date")
    days = lambda now: [str(x.day) for x in feeds.pending_days(latest, now).orderBy("day").collect()]
    assert days(dt.datetime(2026, 7, 30, 16, 15)) == ["2026-07-29"]
    assert days(dt.datetime(2026, 7, 30, 16, 16)) == ["2026-07-29", "2026-07-30"]
    assert days(dt.datetime(2026, 8, 1, 20, 0)) == ["2026-07-29", "2026-07-30", "2026-07-31"]
    back = [str(x.day) for x in feeds.weekday_lookback(spark, dt.date(2026, 8, 2), 3).collect()]
    assert back == ["2026-07-31", "2026-07-30", "2026-07-29"]


def picks(spark, dates, ticker="A", price=1.0):
    return spark.createDataFrame([(d, ticker, price) for d in dates], "scan_date date, ticker string, price double")


def test_replacing_a_scan_date_drops_its_old_rows(spark, tmp_path):
    path = str(tmp_path / "picks")
    day, other = dt.date(2024, 5, 1), dt.date(2024, 5, 2)
    store.write_picks(picks(spark, [day], "OLD").unionByName(picks(spark, [other], "KEEP")), path)
    store.write_picks(picks(spark, [day], "NEW"), path)
    assert {x.ticker for x in spark.read.parquet(path).collect()} == {"NEW", "KEEP"}


def test_retention(spark, tmp_path):
    dates = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(65)]
    history = picks(spark, dates)
    assert store.retain_dates(history, 60).count() == 60
    assert store.retain_dates(history.limit(60), 60).count() == 60
    with pytest.raises(ValueError):
        store.retain_dates(history, 0)
    dropped = []
    outdated = store.save_then_prune(history, str(tmp_path / "p"), 60, dropped.extend)
    assert [str(d) for d in outdated] == [str(d) for d in dates[:5]] and dropped == outdated


def test_failed_save_prunes_nothing(spark, tmp_path, monkeypatch):
    def fail(*_):
        raise OSError("disk")

    monkeypatch.setattr(store, "write_picks", fail)
    dropped = []
    with pytest.raises(OSError):
        store.save_then_prune(picks(spark, [dt.date(2024, 1, 1)]), str(tmp_path / "p"), 1, dropped.append)
    assert dropped == []


def test_sessions_and_business_days(spark):
    cases = [
        ("2026-07-31 19:59:00", "2026-07-30"),  # Friday 15:59 in New York
        ("2026-07-31 20:00:00", "2026-07-31"),
        ("2026-08-01 20:00:00", "2026-07-31"),
        ("2026-08-02 20:00:00", "2026-07-31"),
        ("2026-08-03 13:00:00", "2026-07-31"),
        ("2026-08-03 21:00:00", "2026-08-03"),
    ]
    df = spark.createDataFrame(cases, "at string, want string")
    got = df.withColumn("got", scalar.latest_session(C("at").cast("timestamp")).cast("string")).collect()
    assert [x.got for x in got] == [x.want for x in got]
    spans = [("2026-07-31", "2026-07-31", 0), ("2026-07-31", "2026-08-03", 1), ("2026-07-29", "2026-08-03", 3), ("2026-08-03", "2026-07-31", 0)]
    df = spark.createDataFrame(spans, "a string, b string, n int").withColumns({"a": C("a").cast("date"), "b": C("b").cast("date")})
    got = df.withColumn("got", scalar.business_days_between(C("a"), C("b"))).collect()
    assert [x.got for x in got] == [x.n for x in got]


def test_stacked_inputs_are_grouped_whole(spark, tmp_path):
    """Inputs already clustered by ticker, stacked, then upserted: one row per key, whatever AQE coalesces."""
    df = spark.range(60_000).select(
        (C("id") % 26).cast("string").alias("ticker"), F.date_add(F.lit("2020-01-01").cast("date"), (C("id") / 26).cast("int")).alias("dt"), F.lit(1.0).alias("close"), F.lit(0).alias("batch")
    )
    path = str(tmp_path / "t")
    df.repartition("ticker").write.parquet(path)
    from pyspark.sql import Window

    base = spark.read.parquet(path).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ticker").orderBy("dt")))
    fixes = base.filter(F.dayofmonth("dt") % 2 == 0).withColumns({"batch": F.lit(1), "close": F.lit(2.0)})
    merged = store.upsert(base, fixes, ["ticker", "dt"], "batch")
    assert merged.count() == 60_000 and merged.select("ticker", "dt").distinct().count() == 60_000


def test_symbol_directories_and_static_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text("symbol|name|etf|test\nAAA|Alpha Common Stock|N|N\nABCDW|Alpha Common Stock|N|N\nETF|Fund Common Stock|Y|N\nWRT|Alpha Class A Warrant|N|N\n")
    (tmp_path / "b.txt").write_text("symbol|name|etf|test\nAAA|Alpha Common Stock|N|N\nBB|Beta Ordinary Shares|N|N\nB.C|Beta Class A|N|N\n")
    got = feeds.universe_symbols(*[feeds.read_symbol_file(spark, str(tmp_path / f)) for f in ("a.txt", "b.txt")])
    assert sorted(x.symbol for x in got.collect()) == ["AAA", "BB", "IWM", "QQQ", "SPY"]
    listed = spark.createDataFrame([("X", 3), ("X", 1), ("Y.Z", 0)], "symbol string, pos int")
    assert [(x.symbol, x.pos) for x in feeds.dedup_symbols(listed).collect()] == [("X", 1)]


def test_trimmed_bars_are_numbered_anew(spark, make_bars):
    from tapeloom.operators.screen import period_returns, with_tail

    bars = make_bars({"A": [(10, 11, 9, 10 + k / 100, 100) for k in range(900)]}, start="2018-01-01")
    cut = store.trim_history(bars, 1)
    rows = cut.orderBy("dt").collect()
    assert [x.i for x in rows] == list(range(len(rows))) and len(rows) < 400
    assert [x.back for x in with_tail(cut, 2).orderBy("i").collect()] == [2, 1]
    gap = bars.filter("i <> 500").withColumn("close", F.expr("if(i % 7 = 3, null, close)"))
    (got,) = period_returns(gap).collect()
    closes = [10 + k / 100 for k in range(900) if k != 500 and k % 7 != 3]
    assert abs(got.ret63 - (closes[-1] / closes[-64] - 1)) < 1e-12


def test_equal_versions_and_positions(spark):
    schema = "ticker string, dt string, close double, batch int, at int"
    base = spark.createDataFrame([("A", "d", 1.0, 1, 0)], schema)
    fixes = [("A", "d", 3.0, 1, 1), ("A", "d", 2.0, 1, 2)]
    for rows in (fixes, fixes[::-1]):
        got = store.upsert(base, spark.createDataFrame(rows, schema), ["ticker", "dt"], "batch", "at").collect()
        assert [x.close for x in got] == [2.0]


def test_an_empty_scan_replaces_its_date(spark, tmp_path):
    day, other = dt.date(2024, 1, 2), dt.date(2024, 1, 3)
    path = str(tmp_path / "e")
    history = picks(spark, [day], "OLD").unionByName(picks(spark, [other], "KEEP"))
    none = history.limit(0)
    left = store.replaced(history, none, history.filter("ticker = 'OLD'"))
    assert [x.ticker for x in left.collect()] == ["KEEP"]
    store.write_picks(history, path)
    store.write_picks(none, path, [day])
    assert [x.ticker for x in spark.read.parquet(path).collect()] == ["KEEP"]
    store.save_then_prune(picks(spark, [dt.date(2024, 1, 4)], "NEW"), path, 1)
    assert [x.ticker for x in spark.read.parquet(path).collect()] == ["NEW"]
