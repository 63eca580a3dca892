import datetime as dt

from pyspark.sql import functions as F

from tapeloom.operators import breadth as br
from tapeloom.operators import news as nw

C = F.col


def test_keyword_order_and_whole_words(spark):
    rows = [("Rate hike looms", None), ("They said so", "nothing"), ("Quiet day", "no word"), ("Rate cut", "")]
    df = spark.createDataFrame(rows, "title string, description string")
    assert [x.keyword for x in nw.classify(df).collect()] == ["rate", "ai", None, "rate"]
    whole = nw.classify(df, whole_words=True).collect()
    assert [x.keyword for x in whole] == ["rate hike", None, None, "rate cut"]
    assert [x.impact for x in whole] == ["negative", "neutral", "neutral", "positive"]


def test_no_change_is_negative_both_ways(spark):
    rows = [("up", "2", "2"), ("down", "2", "2"), ("up", "3", "2"), ("down", "3", "2"), ("up", "3", None)]
    df = spark.createDataFrame(rows, "d string, v string, p string")
    got = [x.i for x in df.select(nw.macro_impact(C("d"), C("v"), C("p")).alias("i")).collect()]
    assert got == ["negative", "negative", "positive", "negative", "neutral"]


def test_first_feed_wins_and_copies_collapse(spark):
    a = spark.createDataFrame([(1, "x", "2024-01-02"), (2, "y", "2024-01-01")], "pos int, title string, date string")
    b = spark.createDataFrame([(5, "y", "2024-01-09"), (7, "z", "2024-01-05"), (6, "z", "2024-01-04"), (8, "", "2024-01-08")], a.schema)
    got = [(x.title, x.pos) for x in nw.newest(nw.merge_feeds(a, b), 10).collect()]
    assert got == [("z", 6), ("x", 1), ("y", 2)]


def test_sentiment_points_and_themes(spark):
    points = [(1704067200000 + 86400000 * k, None if k == 1 else k + 0.25) for k in range(3)]
    df = spark.createDataFrame([(points,)], "p array<struct<x:bigint,y:double>>")
    got = df.select(br.sentiment_points(C("p"), 2).alias("s")).first().s
    assert [(x.date, x.value) for x in got] == [(dt.date(2024, 1, 3), 2.3)]
    themes = spark.createDataFrame([("b", "A"), ("a", "A")], "theme string, ticker string")
    assert br.ticker_themes(themes).first().themes == ["a", "b"]
