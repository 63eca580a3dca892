"""Queries over news, macro series and fundamentals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import news as nw
from tapeloom.plans import sql as q
from tapeloom.plans.registry import query
from tapeloom.plans.stores import MACRO_SERIES, macro_series
from tapeloom.plans.windows import day
from tapeloom.sources import feeds
from tapeloom.sources.bars import table

C = F.col

_CASE = " ".join(f"WHEN CONTAINS(body, '{k}') THEN '{k}'" for k in nw.KEYWORDS)
_IMPACT = " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in nw.KEYWORDS.items())
_SECTORS = " ".join(f"WHEN '{k}' THEN '{'|'.join(v[1])}'" for k, v in nw.KEYWORDS.items())
CLASSIFIED = f"""feed AS (SELECT doc_id, SPLIT_PART(text, '.', 1) AS title, text AS description, source FROM documents),
body AS (SELECT *, LOWER(title || ' ' || description) AS body FROM feed),
kw AS (SELECT *, CASE {_CASE} END AS keyword FROM body),
classified AS MATERIALIZED (SELECT *, COALESCE(CASE keyword {_IMPACT} END, 'neutral') AS impact,
  COALESCE(CASE keyword {_SECTORS} END, '') AS sectors FROM kw)"""


def _feed(spark, sf):
    k = C("doc_id")
    return table(spark, sf, "documents").select(
        k.alias("pos"),
        F.split_part("text", F.lit("."), F.lit(1)).alias("title"),
        C("text").alias("description"),
        F.when(k % 9 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 200).cast("int")).cast("string")).alias("published"),
        F.transform(F.sequence(F.lit(0), (k % 7).cast("int")), lambda x: F.concat(F.lit("T"), x.cast("string"))).alias("tickers"),
        F.when(k % 4 != 0, C("source")).alias("publisher"),
        F.lit(None).cast("string").alias("url"),
    )


@query(
    "news_classify",
    q.with_ctes(CLASSIFIED, select="SELECT doc_id, keyword, impact, sectors FROM classified"),
)
def news_classify(spark, sf):
    c = nw.classify(_feed(spark, sf))
    return c.select(C("pos").alias("doc_id"), "keyword", "impact", F.array_join("affected_sectors", "|").alias("sectors"))


@query(
    "news_table",
    q.with_ctes(
        CLASSIFIED,
        """shaped AS (SELECT doc_id, doc_id % 2 AS feed_no, title, description[1:300] AS description, impact,
          CASE WHEN doc_id % 9 <> 0 THEN CAST(DATE '2024-01-01' + CAST(doc_id % 200 AS INTEGER) AS VARCHAR) ELSE '2024-12-31' END AS date,
          LEAST(doc_id % 7 + 1, 5) AS n_tickers,
          CASE WHEN doc_id % 4 <> 0 THEN source WHEN doc_id % 2 = 0 THEN 'Wire A' ELSE 'Wire B' END AS source FROM classified),
        first_feed AS (SELECT *, 1 AS feed FROM shaped WHERE feed_no = 0),
        second_feed AS (SELECT *, 2 AS feed FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY title ORDER BY doc_id) AS k FROM shaped
          WHERE feed_no = 1 AND title <> '') WHERE k = 1 AND title NOT IN (SELECT title FROM first_feed)),
        merged AS (SELECT doc_id, date, title, description, impact, n_tickers, source, feed FROM first_feed
          UNION ALL SELECT doc_id, date, title, description, impact, n_tickers, source, feed FROM second_feed),
        top AS (SELECT * FROM merged ORDER BY date DESC, feed, doc_id LIMIT 30)""",
        select="""SELECT 'top' AS part, doc_id, date, title, description, impact, n_tickers, source FROM top
        UNION ALL SELECT 'all', -1, date, '', '', impact, COUNT(*), '' FROM merged GROUP BY date, impact""",
    ),
)
def news_table(spark, sf):
    feed = _feed(spark, sf)
    first = nw.news_rows(feed.filter(C("pos") % 2 == 0), "2024-12-31", "Wire A")
    second = nw.news_rows(feed.filter(C("pos") % 2 == 1), "2024-12-31", "Wire B")
    merged = nw.merge_feeds(first, second)
    top = nw.newest(merged, 30).select(
        F.lit("top").alias("part"),
        C("pos").alias("doc_id"),
        "date",
        "title",
        "description",
        "impact",
        F.size("affected_tickers").cast("bigint").alias("n_tickers"),
        "source",
    )
    counts = merged.groupBy("date", "impact").agg(F.count(F.lit(1)).alias("n_tickers"))
    blank = {c: F.lit("") for c in ("title", "description", "source")}
    counts = counts.withColumns(blank | {"part": F.lit("all"), "doc_id": F.lit(-1).cast("bigint")})
    return top.unionByName(counts)


def _meta(spark):
    rows = [("1-URGENT", "up", "%"), ("2-HIGH", "down", "%"), ("3-MEDIUM", "down", "pt"), ("4-NOT SPECIFIED", "up", "k"), ("5-LOW", "down", "k")]
    return spark.createDataFrame(rows, "series_id string, direction string, unit string")


_META = """meta AS (SELECT * FROM (VALUES ('1-URGENT', 'up', '%'), ('2-HIGH', 'down', '%'), ('3-MEDIUM', 'down', 'pt'),
  ('4-NOT SPECIFIED', 'up', 'k'), ('5-LOW', 'down', 'k')) t(series_id, direction, unit))"""


@query(
    "macro_impact",
    q.with_ctes(
        MACRO_SERIES,
        _META,
        """pairs AS (SELECT series_id, MAX(dt) FILTER (k = 1) AS dt, MAX(value) FILTER (k = 1) AS value,
        MAX(value) FILTER (k = 2) AS previous FROM last2 GROUP BY series_id)""",
        select="""SELECT p.series_id, CAST(dt AS VARCHAR) AS dt, value,
        CASE WHEN previous IS NULL THEN 'neutral'
          WHEN direction = 'up' AND value::DOUBLE > previous::DOUBLE THEN 'positive'
          WHEN direction = 'down' AND value::DOUBLE < previous::DOUBLE THEN 'positive' ELSE 'negative' END AS impact,
        '最新値: ' || value || ' ' || unit || COALESCE('（前回: ' || previous || ' ' || unit || '）', '') AS description
        FROM pairs p JOIN meta m ON m.series_id = p.series_id""",
    ),
)
def macro_impact(spark, sf):
    last2 = feeds.last_observations(macro_series(spark, sf))
    rows = nw.macro_rows(last2, _meta(spark))
    return rows.withColumn("dt", C("dt").cast("string"))


@query(
    "macro_next_release",
    """WITH names AS (SELECT DISTINCT c_mktsegment AS name FROM customer),
    events AS (SELECT * FROM (VALUES ('BUILDING', '1-URGENT'), ('AUTOMOBILE', '2-HIGH'), ('MACHINERY', 'none such')) t(name, event)),
    cal AS (SELECT o_orderpriority AS event, ARG_MIN(CAST(o_orderdate AS DATE), o_orderkey) AS d FROM orders
      WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
    SELECT n.name, CAST(d AS VARCHAR) AS next_release FROM names n LEFT JOIN events e ON e.name = n.name
    LEFT JOIN cal ON cal.event = e.event""",
)
def macro_next_release(spark, sf):
    names = table(spark, sf, "customer").select(C("c_mktsegment").alias("name")).distinct()
    events = spark.createDataFrame(
        [("BUILDING", "1-URGENT"), ("AUTOMOBILE", "2-HIGH"), ("MACHINERY", "none such")], "name string, event string"
    )
    calendar = table(spark, sf, "orders").filter(C("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select(
        C("o_orderpriority").alias("event"), F.to_date("o_orderdate").alias("date"), C("o_orderkey").alias("pos")
    )
    return nw.next_releases(names, calendar, events).select("name", day("next_release"))


_ECO = """eco AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, o_orderpriority || '/' || o_orderstatus AS title, o_totalprice AS value FROM orders)"""


@query(
    "macro_latest",
    q.with_ctes(
        _ECO,
        "top AS (SELECT * FROM eco ORDER BY date DESC, id DESC LIMIT 20)",
        "ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY title ORDER BY date DESC, id DESC) AS k FROM eco)",
        select="""SELECT 'newest' AS part, id, CAST(date AS VARCHAR) AS date, title, value FROM top
        UNION ALL SELECT 'title', id, CAST(date AS VARCHAR), title, value FROM ranked WHERE k = 1""",
    ),
)
def macro_latest(spark, sf):
    eco = table(spark, sf, "orders").select(
        C("o_orderkey").alias("id"),
        F.to_date("o_orderdate").alias("date"),
        F.concat("o_orderpriority", F.lit("/"), "o_orderstatus").alias("title"),
        C("o_totalprice").alias("value"),
    )
    top = eco.orderBy(F.desc("date"), F.desc("id")).limit(20).withColumn("part", F.lit("newest"))
    per_title = nw.latest_per_title(eco).withColumn("part", F.lit("title"))
    return top.unionByName(per_title).withColumn("date", C("date").cast("string"))


@query(
    "fundamentals_view",
    """SELECT CAST(p_partkey AS VARCHAR) AS ticker, ROUND((p_partkey * 1e7 + 3e6) / 1e9, 1) AS market_cap_b,
    CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS pe_ratio,
    CASE WHEN p_size % 3 <> 0 THEN ROUND(p_size / 64.0::DOUBLE * 100, 1) END AS eps_growth_pct,
    REPEAT(p_name || ' ', 60)[1:400] AS description, p_partkey % 14 < 7 AS fresh FROM part""",
)
def fundamentals_view(spark, sf):
    size, key = C("p_size"), C("p_partkey")
    rows = table(spark, sf, "part").select(
        key.cast("string").alias("ticker"),
        (key * 1e7 + 3e6).alias("market_cap"),
        F.when(size % 5 != 0, C("p_retailprice").cast("string")).otherwise("n/a").alias("pe_ratio"),
        F.when(size % 3 != 0, (size / 64.0).cast("string")).alias("eps_growth"),
        F.repeat(F.concat("p_name", F.lit(" ")), F.lit(60)).alias("description"),
        F.date_sub(F.lit("2024-06-30").cast("date"), (key % 14).cast("int")).alias("updated_at"),
    )
    return nw.fundamentals_view(rows, "2024-06-30")
