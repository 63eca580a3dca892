"""News and macro rows: keyword classification, deduplication, newest per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.scalar import number, pct
from tapeloom.session import safe_unions

C = F.col

# Keyword -> (impact, sectors), in order of precedence.
KEYWORDS: dict[str, tuple[str, tuple[str, ...]]] = {
    "fed": ("neutral", ("金融",)),
    "rate": ("neutral", ("金融", "不動産")),
    "rate hike": ("negative", ("金融", "不動産", "テクノロジー")),
    "rate cut": ("positive", ("金融", "不動産", "テクノロジー")),
    "inflation": ("negative", ("一般消費財", "エネルギー")),
    "cpi": ("negative", ("一般消費財", "エネルギー")),
    "tariff": ("negative", ("素材", "一般消費財")),
    "sanction": ("negative", ("エネルギー",)),
    "earnings": ("positive", ()),
    "beat": ("positive", ()),
    "miss": ("negative", ()),
    "layoff": ("negative", ("テクノロジー",)),
    "ai": ("positive", ("テクノロジー",)),
    "chip": ("positive", ("テクノロジー",)),
    "oil": ("neutral", ("エネルギー",)),
    "jobs": ("positive", ("一般消費財",)),
    "gdp": ("positive", ()),
    "recession": ("negative", ()),
    "rally": ("positive", ()),
    "selloff": ("negative", ()),
    "crash": ("negative", ()),
}

# Calendar event name per indicator name; indicators without an event are absent.
RELEASE_EVENTS = {
    "CPI（消費者物価指数）": "CPI",
    "失業率": "Unemployment Rate",
    "FF金利（政策金利）": "Fed Interest Rate Decision",
    "非農業部門雇用者数（NFP）": "Nonfarm Payrolls",
    "GDP（名目・季節調整済み年率）": "GDP",
}


def matched_keyword(title: Column, description: Column, whole_words: bool = False) -> Column:
    """The deciding keyword: the first in order found anywhere in the text.

    With ``whole_words`` the longest keyword wins and only whole words count.
    """
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))
    words = sorted(KEYWORDS, key=len, reverse=True) if whole_words else list(KEYWORDS)
    tests = [text.rlike(rf"\b{w}\b") if whole_words else text.contains(w) for w in words]
    return F.coalesce(*[F.when(t, F.lit(w)) for t, w in zip(tests, words)])


def classify(news: DataFrame, whole_words: bool = False) -> DataFrame:
    """Adds ``keyword``, ``impact`` and ``affected_sectors``."""
    impact = F.create_map(*[F.lit(x) for k, v in KEYWORDS.items() for x in (k, v[0])])
    sectors = F.create_map(
        *[x for k, v in KEYWORDS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v[1]]).cast("array<string>"))]
    )
    found = news.withColumn("keyword", matched_keyword(C("title"), C("description"), whole_words))
    return found.withColumns(
        {
            "impact": F.coalesce(impact[C("keyword")], F.lit("neutral")),
            "affected_sectors": F.coalesce(sectors[C("keyword")], F.array().cast("array<string>")),
        }
    )


def news_rows(feed: DataFrame, today: str, publisher: str) -> DataFrame:
    """Stored shape of feed rows: day of publication, short description, at most five tickers.

    The whole description is classified; only the stored copy is shortened.
    """
    c = classify(feed)
    day = F.coalesce(F.nullif(F.substring("published", 1, 10), F.lit("")), F.lit(today))
    return c.select(
        "pos",
        day.alias("date"),
        F.lit("news").alias("category"),
        "title",
        F.substring(F.coalesce("description", F.lit("")), 1, 300).alias("description"),
        "impact",
        "affected_sectors",
        F.slice("tickers", 1, 5).alias("affected_tickers"),
        F.coalesce("publisher", F.lit(publisher)).alias("source"),
        F.coalesce("url", F.lit("")).alias("url"),
    )


def dedup_titles(rows: DataFrame) -> DataFrame:
    """First row of each non-empty title in feed order; copies are reduced before the shuffle."""
    values = [c for c in rows.columns if c != "title"]
    first = F.min_by(F.struct(*values), "pos").alias("row_")
    return rows.filter(F.coalesce("title", F.lit("")) != "").groupBy("title").agg(first).select("title", "row_.*")


def merge_feeds(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of the first feed plus the second feed's titles the first does not have."""
    safe_unions(first.sparkSession)
    cols = first.columns
    titles = first.select("title").distinct()
    extra = dedup_titles(second).join(titles, "title", "left_anti")
    return first.withColumn("feed", F.lit(1)).unionByName(extra.select(cols).withColumn("feed", F.lit(2)))


def newest(rows: DataFrame, n: int = 30) -> DataFrame:
    """Newest rows; within a date the feed order is kept."""
    return rows.orderBy(F.desc("date"), "feed", "pos").limit(n)


def macro_impact(direction: Column, value: Column, previous: Column) -> Column:
    """Effect of a change: good when it goes the wished direction; no change is negative."""
    diff = number(value) - number(previous)
    good = F.when(direction == "up", diff > 0).otherwise(diff < 0)
    return (
        F.when(diff.isNull(), F.lit("neutral")).when(good, F.lit("positive")).otherwise(F.lit("negative"))
    )


def macro_text(value: Column, previous: Column, unit: Column) -> Column:
    """Stored description of an indicator row."""
    before = F.when(
        F.coalesce(previous, F.lit(".")) != ".", F.concat(F.lit("（前回: "), previous, F.lit(" "), unit, F.lit("）"))
    ).otherwise(F.lit(""))
    return F.when(value == ".", F.lit("最新データ未公表")).otherwise(
        F.concat(F.lit("最新値: "), value, F.lit(" "), unit, before)
    )


def macro_rows(observations: DataFrame, meta: DataFrame) -> DataFrame:
    """Newest value of each series with impact and text; ``observations`` has k = 1 newest, 2 previous."""
    pair = observations.groupBy("series_id").agg(
        F.max(F.when(C("k") == 1, C("dt"))).alias("dt"),
        F.max(F.when(C("k") == 1, C("value"))).alias("value"),
        F.max(F.when(C("k") == 2, C("value"))).alias("previous"),
    )
    joined = pair.join(meta, "series_id")
    return joined.select(
        "series_id",
        "dt",
        "value",
        macro_impact(C("direction"), C("value"), C("previous")).alias("impact"),
        macro_text(C("value"), C("previous"), C("unit")).alias("description"),
    )


def next_releases(names: DataFrame, calendar: DataFrame, events: DataFrame) -> DataFrame:
    """Next release date per indicator: the first calendar row, in feed order, of its event.

    names(name), events(name, event) and calendar(event, date, pos).
    """
    first = (
        calendar.filter((F.coalesce("event", F.lit("")) != "") & C("date").isNotNull())
        .groupBy("event")
        .agg(F.min_by("date", "pos").alias("next_release"))
    )
    return names.join(events, "name", "left").join(first, "event", "left").select("name", "next_release")


def latest_per_title(rows: DataFrame) -> DataFrame:
    """Newest row of each title."""
    values = [c for c in rows.columns if c != "title"]
    return rows.groupBy("title").agg(F.max_by(F.struct(*values), F.struct("date", "id")).alias("row_")).select(
        "title", "row_.*"
    )


def fundamentals_view(rows: DataFrame, now: str, max_age_days: int = 7, chars: int = 400) -> DataFrame:
    """Display row of fundamentals: ratios in percent, market cap in billions, and whether the row is fresh."""
    ratios = ("eps_growth", "revenue_growth", "roe")
    return rows.select(
        "ticker",
        F.round(F.coalesce("market_cap", F.lit(0.0)) / 1e9, 1).alias("market_cap_b"),
        number(C("pe_ratio")).alias("pe_ratio"),
        *[pct(C(x)).alias(f"{x}_pct") for x in ratios if x in rows.columns],
        F.substring(F.coalesce("description", F.lit("")), 1, chars).alias("description"),
        (F.datediff(F.lit(now).cast("date"), "updated_at") < max_age_days).alias("fresh"),
    )
