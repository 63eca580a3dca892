"""Queries against their SQL on tables that leave nothing or next to nothing to work on."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tapeloom.functions.scalar import float_div
from tapeloom.operators import resample as rs
from tapeloom.plans import validation
from tools.check import norm

C = F.col
SMALL = "/root/testdata/sf0.001"
READ = ("nation", "supplier", "lineitem")


def folder_of(tmp_path, lines: str) -> tuple[str, duckdb.DuckDBPyConnection]:
    """Tables as in ``SMALL``, but with the rows of ``lines`` for lineitem."""
    con = duckdb.connect()
    for t in READ:
        source = f"read_parquet('{SMALL}/{t}.parquet')"
        rows = lines.format(source=source) if t == "lineitem" else f"SELECT * FROM {source}"
        con.execute(f"COPY ({rows}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    return str(tmp_path), con


def shown(v) -> str:
    return "NaN" if v != v else str(norm(v))


def both(df, cur):
    cols = sorted(df.columns)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    mine = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    return mine, sorted(tuple(shown(r[names.index(c)]) for c in cols) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["block_bootstrap", "cluster_tstat", "compound_stats", "trade_summary"])
def test_no_bars(spark, tmp_path, name):
    folder, con = folder_of(tmp_path, "SELECT * FROM {source} WHERE FALSE")
    mine, theirs = both(entry_points.queries()[name](spark, folder), con.execute(entry_points.oracle_sql()[name]))
    assert mine == theirs


@pytest.mark.parametrize(
    "lines",
    [
        "SELECT * REPLACE (TIMESTAMP '1995-03-01' AS l_shipdate) FROM {source}",
        "SELECT * REPLACE (0.05::DOUBLE AS l_discount) FROM {source}",
    ],
    ids=["one day", "rising"],
)
def test_series_that_never_fall(spark, tmp_path, lines):
    folder, con = folder_of(tmp_path, lines)
    mine, theirs = both(entry_points.queries()["series_stats"](spark, folder), con.execute(entry_points.oracle_sql()["series_stats"]))
    assert mine == theirs


TRADES = [("A", 1, "1995-01-03", 1.5), ("A", 9, "1995-01-20", -1.0), ("B", 4, "1995-02-01", 0.25)]


def few_trades(spark, monkeypatch, name, trades):
    """The query and its SQL, both on the given labelled trades."""
    rows = [(t, i, d, d, r, 3) for t, i, d, r in trades]
    df = spark.createDataFrame(rows, "ticker string, i bigint, entry_date string, exit_date string, r double, bars bigint")
    df = df.withColumns({c: C(c).cast("date") for c in ("entry_date", "exit_date")} | {"bracket": F.lit(0), "held": C("bars")})
    monkeypatch.setattr(validation, "labelled", lambda spark, sf: df)
    sql = entry_points.oracle_sql()[name]
    table = df.withColumnRenamed("bars", "bars_held").drop("held").toArrow()  # noqa: F841 - read by the SQL
    con = duckdb.connect()
    con.register("given", table)
    head, _, tail = sql.partition("lab AS MATERIALIZED (")
    depth, at = 1, 0
    while depth:
        depth += {"(": 1, ")": -1}.get(tail[at], 0)
        at += 1
    return both(entry_points.queries()[name](spark, SMALL), con.execute("WITH lab AS (SELECT * FROM given)" + tail[at:]))


@pytest.mark.parametrize("name", ["block_bootstrap", "cluster_tstat", "compound_stats", "trade_summary"])
@pytest.mark.parametrize("count", [0, 1, 2, 3])
def test_few_trades(spark, monkeypatch, name, count):
    mine, theirs = few_trades(spark, monkeypatch, name, TRADES[:count])
    assert mine == theirs


def test_what_is_over_zero(spark):
    rows = spark.createDataFrame([(1.0, 2), (1.0, 0), (-1.0, 0), (0.0, 0), (None, 0), (1.0, None)], "a double, b bigint")
    got = [r[0] for r in rows.select(float_div(C("a"), C("b"))).collect()]
    assert got[:3] == [0.5, float("inf"), float("-inf")] and got[3] != got[3] and got[4:] == [None, None]


def test_no_interval_under_the_least_months(spark):
    rows = spark.createDataFrame([(d, r) for _, _, d, r in TRADES], "entry_date string, r double").withColumn("entry_date", C("entry_date").cast("date"))
    assert rs.block_bootstrap(spark, rows, iters=5).count() == 0
    assert rs.block_bootstrap(spark, rows, iters=5, min_months=2).count() == 1
