"""Queries over feeds, the bar store and pick history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tapeloom.functions import rolling as r
from tapeloom.functions import scalar
from tapeloom.functions.maps import SECTOR_DISPLAY
from tapeloom.operators import indicators as ind
from tapeloom.operators import picks as pk
from tapeloom.operators import scale
from tapeloom.operators import screen as sc
from tapeloom.plans import sql as q
from tapeloom.plans.inputs import PICKS, picks
from tapeloom.plans.registry import query
from tapeloom.plans.windows import day, rnd
from tapeloom.sources import feeds, store
from tapeloom.sources.bars import daily, sectors, table, wide

C = F.col
DAY = "CAST(dt AS VARCHAR) AS dt"


@query(
    "ingest_bars",
    q.with_ctes(
        q.BARS,
        select=f"""SELECT b.ticker, {DAY}, open, high, low, close,
        CASE WHEN i % 13 = 0 THEN 0 ELSE CAST(volume AS BIGINT) END AS volume
        FROM bars b WHERE i % 17 <> 0 AND ticker IN (SELECT n_name FROM nation)""",
    ),
)
def ingest_bars(spark, sf):
    payload = daily(spark, sf).select(
        F.concat(F.lit(" "), F.lower("ticker"), F.lit(" ")).alias("T"),
        "dt",
        C("open").alias("o"),
        C("high").alias("h"),
        C("low").alias("l"),
        F.when(C("i") % 17 != 0, C("close")).alias("c"),
        F.when(C("i") % 13 != 0, C("volume")).alias("v"),
    )
    universe = sectors(spark, sf).select("ticker")
    return feeds.ingest_grouped(payload, universe).withColumn("dt", C("dt").cast("string"))


@query(
    "upsert_bars",
    q.with_ctes(
        q.BARS,
        f"""versions AS (
        SELECT ticker, dt, close, volume, 0 AS batch FROM bars
        UNION ALL SELECT ticker, dt, close * 1.01, volume, 1 FROM bars WHERE i % 5 = 0
        UNION ALL SELECT ticker, dt + 4000, close, 0, 2 FROM bars WHERE i % 10 = 0),
        ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker, dt ORDER BY batch DESC) AS k FROM versions)""",
        select=f"SELECT ticker, {DAY}, close, volume, batch FROM ranked WHERE k = 1",
    ),
)
def upsert_bars(spark, sf):
    cols = ["ticker", "dt", "close", "volume", "batch"]
    bars = daily(spark, sf)
    current = bars.withColumn("batch", F.lit(0)).select(cols)
    fixes = bars.filter(C("i") % 5 == 0).withColumns({"close": C("close") * 1.01, "batch": F.lit(1)}).select(cols)
    later = bars.filter(C("i") % 10 == 0).withColumns(
        {"dt": F.date_add("dt", 4000), "volume": F.lit(0.0), "batch": F.lit(2)}
    )
    unknown = later.withColumn("ticker", F.concat(F.lit("X"), "ticker"))
    changes = fixes.unionByName(later.select(cols)).unionByName(unknown.select(cols))
    return store.upsert_known(current, changes, "batch").withColumn("dt", C("dt").cast("string"))


@query(
    "trim_history",
    q.with_ctes(
        q.WIDE,
        select=f"""SELECT ticker, {DAY}, close FROM bars b JOIN
        (SELECT ticker AS tk, MAX(dt) - INTERVAL 24 MONTH AS from_dt FROM bars GROUP BY 1) m
        ON m.tk = b.ticker WHERE dt >= from_dt""",
    ),
)
def trim_history(spark, sf):
    return store.trim_history(wide(spark, sf), years=2).select("ticker", day(), "close")


@query(
    "pending_days",
    q.with_ctes(
        q.BARS,
        "latest AS (SELECT ticker, MAX(dt) - 20 AS last_dt FROM bars GROUP BY ticker)",
        """days AS (SELECT ticker, UNNEST(GENERATE_SERIES(last_dt, DATE '2001-11-05', INTERVAL 1 DAY)) AS d FROM latest)""",
        select="""SELECT ticker, CAST(CAST(d AS DATE) AS VARCHAR) AS day FROM days WHERE ISODOW(d) <= 5""",
    ),
)
def pending_days(spark, sf):
    latest = daily(spark, sf).groupBy("ticker").agg(F.date_sub(F.max("dt"), 20).alias("last_dt"))
    # Before 16:15 on a Tuesday: the Monday is the last complete day.
    found = feeds.pending_days(latest, dt.datetime(2001, 11, 6, 16, 15))
    return found.select("ticker", C("day").cast("string").alias("day"))


_LISTING_SQL = """listing AS (SELECT p_partkey,
  CASE WHEN p_size % 7 = 0 THEN 'A.' ELSE 'S' END || CAST(p_partkey AS VARCHAR) AS symbol,
  CASE WHEN p_size % 3 = 0 THEN 'etf' ELSE 'stock' END AS type,
  CASE p_size % 4 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'NASDAQ' WHEN 2 THEN 'AMEX' ELSE 'OTC' END AS exchange FROM part)"""


def _listing(spark, sf):
    size = C("p_size")
    return table(spark, sf, "part").select(
        F.concat(F.when(size % 7 == 0, "A.").otherwise("S"), C("p_partkey").cast("string")).alias("symbol"),
        F.when(size % 3 == 0, "etf").otherwise("stock").alias("type"),
        F.when(size % 4 == 0, "NYSE").when(size % 4 == 1, "NASDAQ").when(size % 4 == 2, "AMEX").otherwise("OTC").alias("exchange"),
    )


@query(
    "universe_filter",
    q.with_ctes(
        _LISTING_SQL,
        select="""SELECT symbol, exchange FROM listing WHERE exchange IN ('NYSE', 'NASDAQ', 'AMEX', 'NYSE American')
        AND type = 'stock' AND symbol <> '' AND POSITION('.' IN symbol) = 0 AND LENGTH(symbol) <= 5""",
    ),
)
def universe_filter(spark, sf):
    return feeds.universe_filter(_listing(spark, sf)).select("symbol", "exchange")


@query(
    "clean_ticker",
    q.with_ctes(
        """raw AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN ' ' || lower(p_type) WHEN 1 THEN 'a.' || CAST(p_partkey AS VARCHAR) || ' '
          WHEN 2 THEN p_name ELSE lower(p_brand) END AS symbol FROM part),
        up AS (SELECT p_partkey, upper(trim(symbol)) AS t FROM raw)""",
        select="SELECT p_partkey, CASE WHEN regexp_matches(t, '^[A-Z0-9.\\-]{1,15}$') THEN t END AS ticker FROM up",
    ),
)
def clean_ticker(spark, sf):
    size, key = C("p_size") % 4, C("p_partkey").cast("string")
    symbol = F.when(size == 0, F.concat(F.lit(" "), F.lower("p_type"))).when(size == 1, F.concat(F.lit("a."), key, F.lit(" ")))
    symbol = symbol.when(size == 2, C("p_name")).otherwise(F.lower("p_brand"))
    return table(spark, sf, "part").select("p_partkey", scalar.clean_ticker(symbol).alias("ticker"))


_NAMES = ("common stock", "Class B units", "Ordinary Share", "warrant", "Class A", "Common Shares ETF", "notes due")


def _directory(df, key, name):
    kind = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (C(key) % 7 + 1).cast("int"))
    return df.select(
        F.translate(C(key).cast("string"), "0123456789", "ABCDWRUPZE").alias("symbol"),
        F.concat(C(name), F.lit(" "), kind).alias("name"),
        F.when(C(key) % 9 == 0, "Y").otherwise("N").alias("etf"),
        F.when(C(key) % 10 == 0, "Y").otherwise("N").alias("test"),
    )


def _directory_sql(tab, key, name):
    kinds = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"
    return f"""SELECT TRANSLATE(CAST({key} AS VARCHAR), '0123456789', 'ABCDWRUPZE') AS symbol,
      {name} || ' ' || ({kinds})[{key} % 7 + 1] AS name,
      CASE WHEN {key} % 9 = 0 THEN 'Y' ELSE 'N' END AS etf, CASE WHEN {key} % 10 = 0 THEN 'Y' ELSE 'N' END AS test FROM {tab}"""


@query(
    "universe_symbols",
    q.with_ctes(
        f"directory AS ({_directory_sql('part', 'p_partkey', 'p_name')} UNION ALL {_directory_sql('customer', 'c_custkey', 'c_name')})",
        select=f"""SELECT symbol FROM directory WHERE etf = 'N' AND test = 'N'
        AND regexp_matches(name, '{feeds.KEEP_NAME[4:]}', 'i') AND NOT regexp_matches(name, '{feeds.DROP_NAME[4:]}', 'i')
        AND NOT regexp_matches(symbol, '{feeds.DERIVATIVE_SYMBOL}') AND regexp_matches(symbol, '{feeds.PLAIN_SYMBOL}')
        UNION SELECT UNNEST(['SPY', 'QQQ', 'IWM'])""",
    ),
)
def universe_symbols(spark, sf):
    first = _directory(table(spark, sf, "part"), "p_partkey", "p_name")
    second = _directory(table(spark, sf, "customer"), "c_custkey", "c_name")
    return feeds.universe_symbols(first, second)


@query(
    "upsert_universe",
    """WITH cur AS (SELECT CAST(s_suppkey AS VARCHAR) AS ticker, 'old' AS name,
      CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'Energy' END AS sector, s_acctbal AS market_cap, 'OLD' AS exchange
      FROM supplier WHERE s_suppkey % 3 <> 0),
    new AS (SELECT CAST(s_suppkey AS VARCHAR) AS ticker, s_name AS name, 'NYSE' AS exchange FROM supplier WHERE s_suppkey % 5 <> 0),
    merged AS (SELECT COALESCE(c.ticker, n.ticker) AS ticker, COALESCE(n.name, c.name) AS name, COALESCE(c.sector, '') AS sector,
      COALESCE(c.market_cap, 0) AS market_cap, COALESCE(n.exchange, c.exchange) AS exchange
      FROM cur c FULL OUTER JOIN new n ON n.ticker = c.ticker),
    feed AS (SELECT CAST(s_suppkey AS VARCHAR) AS ticker,
      CASE s_suppkey % 3 WHEN 0 THEN '素材' WHEN 1 THEN '' ELSE 'Space' END AS fed FROM supplier)
    SELECT m.ticker, name, CASE WHEN sector = '' AND fed <> '' THEN fed ELSE sector END AS sector, market_cap, exchange
    FROM merged m LEFT JOIN feed f ON f.ticker = m.ticker""",
)
def upsert_universe(spark, sf):
    s = table(spark, sf, "supplier").withColumn("ticker", C("s_suppkey").cast("string"))
    k = C("s_suppkey")
    current = s.filter(k % 3 != 0).select(
        "ticker",
        F.lit("old").alias("name"),
        F.when(k % 4 == 0, "").when(k % 4 != 1, "Energy").alias("sector"),
        F.lit(None).cast("string").alias("industry"),
        C("s_acctbal").alias("market_cap"),
        F.lit("OLD").alias("exchange"),
        F.lit("2020-01-01").alias("updated_at"),
    )
    listing = s.filter(k % 5 != 0).select(
        "ticker", C("s_name").alias("name"), F.lit("NYSE").alias("exchange"), F.lit("2024-01-01").alias("updated_at")
    )
    feed = s.select(
        "ticker", F.when(k % 3 == 0, "Basic Materials").when(k % 3 == 1, "").otherwise("Space").alias("sector")
    )
    merged = store.upsert_universe(current, listing)
    return store.fill_sectors(merged, feed, SECTOR_DISPLAY).select("ticker", "name", "sector", "market_cap", "exchange")


@query(
    "liquid_admission",
    q.with_ctes(
        q.WIDE,
        f"med AS (SELECT *, {q.median('close * volume', 60)} AS med FROM bars)",
        "each_ AS (SELECT ticker, MAX(med) AS best, MAX(close) AS top, ARG_MAX(close, i) AS last FROM med GROUP BY ticker)",
        select="""SELECT ticker, ROUND(best, 5) AS best_dollar_vol, top, last FROM each_
        WHERE best >= 3000 AND NOT (last > 0 AND top / last > 1.2)""",
    ),
)
def liquid_admission(spark, sf):
    kept = store.liquid_admission(wide(spark, sf), 3000.0, 1.2)
    return kept.select("ticker", F.round("best_dollar_vol", 5).alias("best_dollar_vol"), "top", "last")


@query(
    "replace_picks",
    q.with_ctes(
        q.BARS,
        PICKS,
        """new AS (SELECT scan_date, ticker, price * 2 AS price FROM picks WHERE month(scan_date) = 6 AND day(scan_date) <> 15 AND ticker <> 'MKT')""",
        select="""SELECT CAST(scan_date AS VARCHAR) AS scan_date, ticker, price FROM picks
        WHERE month(scan_date) <> 6
        UNION ALL SELECT CAST(scan_date AS VARCHAR), ticker, price FROM new""",
    ),
)
def replace_picks(spark, sf):
    history = picks(daily(spark, sf)).select("scan_date", "ticker", "price")
    june = history.filter(F.month("scan_date") == 6)
    # The scans of each 15th find nothing.
    new = june.filter((F.dayofmonth("scan_date") != 15) & (C("ticker") != "MKT")).withColumn("price", C("price") * 2)
    return store.replaced(history, new, june.select("scan_date")).select(day("scan_date"), "ticker", "price")


@query(
    "retain_dates",
    q.with_ctes(
        q.BARS,
        PICKS,
        "kept AS (SELECT DISTINCT scan_date FROM picks ORDER BY scan_date DESC LIMIT 60)",
        select="""SELECT CAST(scan_date AS VARCHAR) AS scan_date, ticker FROM picks
        WHERE scan_date IN (SELECT scan_date FROM kept)""",
    ),
)
def retain_dates(spark, sf):
    return store.retain_dates(picks(daily(spark, sf)), 60).select(day("scan_date"), "ticker")


_LOG_SQL = """log AS (SELECT o_orderkey AS id, o_orderpriority AS stage,
  o_orderstatus || '-' || CAST(o_custkey AS VARCHAR) AS message FROM orders)"""


@query(
    "run_log_tail",
    q.with_ctes(
        _LOG_SQL,
        "newest AS (SELECT id, stage, message FROM log ORDER BY id DESC LIMIT 20)",
        select="""SELECT 'tail' AS part, id, stage, message FROM newest
        UNION ALL SELECT 'stage', MAX(id), stage, ARG_MAX(message, id) FROM log GROUP BY stage""",
    ),
)
def run_log_tail(spark, sf):
    log = table(spark, sf, "orders").select(
        C("o_orderkey").alias("id"),
        C("o_orderpriority").alias("stage"),
        F.concat("o_orderstatus", F.lit("-"), C("o_custkey").cast("string")).alias("message"),
    )
    tail = store.log_tail(log).withColumn("part", F.lit("tail"))
    return tail.unionByName(store.latest_by_stage(log).withColumn("part", F.lit("stage")))


@query(
    "store_status",
    q.with_ctes(q.WIDE, select="SELECT COUNT(DISTINCT ticker) AS tickers, CAST(MAX(dt) AS VARCHAR) AS last_dt FROM bars"),
)
def store_status(spark, sf):
    return store.store_status(wide(spark, sf)).select("tickers", day("last_dt"))


MACRO_SERIES = """series AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS dt,
  CASE WHEN day(o_orderdate) % 3 = 0 THEN '.' WHEN day(o_orderdate) % 5 = 0 THEN ' '
    ELSE CAST(CAST(COUNT(*) * 10 + day(MIN(o_orderdate)) AS BIGINT) AS VARCHAR) || ' ' END AS value
  FROM orders GROUP BY o_orderpriority, CAST(o_orderdate AS DATE), day(o_orderdate)),
last2 AS (SELECT * FROM (SELECT series_id, dt, TRIM(value) AS value,
  ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY dt DESC) AS k FROM series WHERE TRIM(value) NOT IN ('.', '')) WHERE k <= 2)"""


def macro_series(spark, sf):
    d = F.to_date("o_orderdate")
    counts = table(spark, sf, "orders").groupBy(C("o_orderpriority").alias("series_id"), d.alias("dt")).count()
    dom = F.dayofmonth("dt")
    value = F.concat((C("count") * 10 + dom).cast("string"), F.lit(" "))
    return counts.select(
        "series_id", "dt", F.when(dom % 3 == 0, ".").when(dom % 5 == 0, " ").otherwise(value).alias("value")
    )


@query("macro_last2", q.with_ctes(MACRO_SERIES, select=f"SELECT series_id, {DAY}, value, k FROM last2"))
def macro_last2(spark, sf):
    return feeds.last_observations(macro_series(spark, sf)).select("series_id", day(), "value", C("k").cast("bigint").alias("k"))


SELECTION = pk.checked_selection({"verdict": ["bounce_confirmed", "healthy_pullback", "accumulation"], "dow_trend": ["up", "neutral"], "state": [], "price_zone": ["high", "mid"]})


def _in(col: str, facet: str) -> str:
    values = SELECTION[facet]
    if not values:
        return "TRUE"
    member = f"COALESCE({col} IN ({', '.join(repr(v) for v in values)}), FALSE)"
    return f"(NOT has_volume OR {member})" if facet in ("verdict", "price_zone") else member


@query(
    "filter_picks",
    q.with_ctes(
        q.BARS,
        PICKS,
        select="SELECT CAST(scan_date AS VARCHAR) AS scan_date, ticker, state, ROUND(adx, 4) AS adx FROM picks WHERE COALESCE(adx >= 25, FALSE) AND "
        + " AND ".join(_in(f, f) for f in pk.FACETS),
    ),
)
def filter_picks(spark, sf):
    kept = pk.filter_picks(picks(daily(spark, sf)), pk.checked_adx(25.0), SELECTION)
    return kept.select(day("scan_date"), "ticker", "state", rnd("adx", 4).alias("adx"))


@query(
    "facet_counts",
    q.with_ctes(
        q.BARS,
        PICKS,
        select=" UNION ALL ".join(
            f"SELECT '{f}' AS facet, '{v}' AS value, COUNT(*) FILTER (COALESCE(adx >= 25, FALSE) AND {f} = '{v}'"
            + "".join(f" AND {_in(o, o)}" for o in pk.FACETS if o != f)
            + ") AS n FROM picks"
            for f, values in pk.FACETS.items()
            for v in values
        ),
    ),
)
def facet_counts(spark, sf):
    return pk.facet_counts(picks(daily(spark, sf)), 25.0, SELECTION)


@query(
    "sort_picks",
    q.with_ctes(
        q.BARS,
        PICKS,
        select="""SELECT CAST(scan_date AS VARCHAR) AS scan_date, ticker, verdict, rs126, ROW_NUMBER() OVER (
          ORDER BY CASE verdict WHEN 'bounce_confirmed' THEN 3 WHEN 'accumulation' THEN 2 WHEN 'healthy_pullback' THEN 2 ELSE 0 END DESC,
          rs126 DESC NULLS LAST, id, ticker) AS rank FROM picks""",
    ),
)
def sort_picks(spark, sf):
    order = pk.checked_sorts([("verdict", -1), ("rs126", -1), ("nonsense", 1)])
    ranked = scale.positions(pk.sort_picks(picks(daily(spark, sf)), order, "id", "ticker"), "rank")
    return ranked.select(day("scan_date"), "ticker", "volume.verdict", "rs126", "rank")


@query(
    "latest_picks",
    q.with_ctes(
        q.BARS,
        PICKS,
        select="""SELECT CAST(scan_date AS VARCHAR) AS scan_date, ticker, price, state FROM picks
        WHERE scan_date = (SELECT MAX(scan_date) FROM picks)""",
    ),
)
def latest_picks(spark, sf):
    return pk.latest_picks(picks(daily(spark, sf))).select(day("scan_date"), "ticker", "price", "state")


_LEVELS = """lv AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY scan_date DESC, id DESC) AS k FROM picks)"""


@query(
    "latest_levels",
    q.with_ctes(
        q.BARS,
        PICKS,
        _LEVELS,
        select="SELECT ticker, ROUND(m20, 7) AS ema20, swing_high, swing_low, band_low, band_high FROM lv WHERE k = 1",
    ),
)
def latest_levels(spark, sf):
    band = C("levels.vol_band")
    return pk.latest_levels(picks(daily(spark, sf))).select(
        "ticker",
        F.round("levels.ema20", 7).alias("ema20"),
        "levels.swing_high",
        "levels.swing_low",
        band[0].alias("band_low"),
        band[1].alias("band_high"),
    )


@query(
    "level_lines",
    q.with_ctes(
        q.BARS,
        PICKS,
        _LEVELS,
        select=" UNION ALL ".join(
            f"SELECT ticker, '{pk.LEVEL_LABELS[k]}' AS label, {'ROUND(m20, 7)' if k == 'ema20' else k} AS price FROM lv WHERE k = 1 AND {'m20' if k == 'ema20' else k} IS NOT NULL"
            for k in pk.LEVEL_LABELS
        ),
    ),
)
def level_lines(spark, sf):
    lines = pk.level_lines(pk.latest_levels(picks(daily(spark, sf))))
    ema = C("label") == pk.LEVEL_LABELS["ema20"]
    return lines.withColumn("price", F.when(ema, F.round("price", 7)).otherwise(C("price")))


@query(
    "json_levels",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL
       ELSE CAST(json_extract(props, '$.k') AS DOUBLE) END AS k,
       event_id % 7 = 0 OR event_id % 11 = 0 AS empty FROM events""",
)
def json_levels(spark, sf):
    k = C("event_id")
    text = F.when(k % 7 == 0, "[1, 2]").when(k % 11 == 0, "{broken").otherwise(C("props"))
    parsed = table(spark, sf, "events").select("event_id", pk.parse_levels(text).alias("m"))
    return parsed.select("event_id", C("m")["k"].alias("k"), (F.size("m") == 0).alias("empty"))


@query(
    "reconcile",
    q.with_ctes(
        q.BARS,
        q.MOVES,
        q.ema("moves", "e", {"atr": q.wilder("tr")}),
        f"""r0 AS (SELECT *, MIN(low) OVER {q.rows(20)} - 0.1 * atr AS stop, MAX(high) OVER {q.rows(60, 1)} * 0.995 AS target,
          COUNT(*) OVER (PARTITION BY ticker) AS n FROM e),
        r1 AS (SELECT *, (target - close) / NULLIF(close - stop, 0) AS rr FROM r0 WHERE i = n - 1),
        r2 AS (SELECT *, CASE WHEN rr >= 2 THEN 'BUY' WHEN rr >= 1.5 THEN 'WATCH' ELSE 'NO-BUY' END AS verdict,
          n % 4 = 0 AS broken FROM r1)""",
        select="""SELECT verdict, COUNT(*) AS n, ROUND(MIN(rr), 4) + 0 AS lo, ROUND(MAX(rr), 4) + 0 AS hi,
        COUNT(*) FILTER (rr BETWEEN 1.5 AND 2.0) AS in_range, COUNT(*) FILTER (broken) AS errors FROM r2 GROUP BY verdict""",
    ),
)
def reconcile(spark, sf):
    e = sc.with_tail(ind.atr_wilder(daily(spark, sf)))
    e = e.withColumns(
        {
            "stop": F.min("low").over(r.last_rows(20)) - 0.1 * C("atr"),
            "target": F.max("high").over(r.last_rows(60, skip=1)) * 0.995,
        }
    ).filter(C("back") == 1)
    expected = e.withColumn("rr", F.try_divide(C("target") - C("close"), C("close") - C("stop")))
    verdict = F.when(C("rr") >= 2, "BUY").when(C("rr") >= 1.5, "WATCH").otherwise("NO-BUY")
    off = F.when(C("n") % 4 == 0, 0.02).otherwise(0.005)  # stored plans, a quarter of them out of tolerance
    stored = expected.withColumns({"verdict": verdict, "stop": C("stop") + off})
    return pk.reconcile(stored, expected, ["stop", "target", "rr"]).withColumns(
        {"lo": rnd("lo", 4), "hi": rnd("hi", 4)}
    )
