"""Registered queries against their SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from tapeloom.plans.catalog import ORACLES, QUERIES
from tools.check import TABLES, norm

FOLDER = "/root/testdata/sf0.001"
CHOSEN = "ema screen upsert_bars universe_symbols facet_counts sector_breadth news_table detect_all rule_signals xs_rank barrier_labels stream_bars cond_mining".split()
CHOSEN += ["ema_gaps", "store_screen", "sort_picks", "barrier_rr_window", "replace_picks"]
CHOSEN += "funnel_per_day candidates_per_day variant_settings momentum_settings rotation_settings permutation_null".split()
CHOSEN += "grouped_payloads weekday_bars run_log reports_back summary_texts sentiment stream_corrections".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) > 100
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, con, name):
    df = entry_points.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    mine = sorted(tuple(str(norm(r[c])) for c in cols) for r in df.collect())
    cur = con.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(str(norm(r[names.index(c)])) for c in cols) for r in cur.fetchall())
    assert mine == theirs
