"""URL rules by a sorted sweep over reversed-host keys.

A key is the host's labels in reverse, a slash, and the path, so that a rule is a prefix and all it covers is
one interval of keys. As a rule also fits subdomains, a url has one key for each trailing part of
its host, as deep as any rule goes. Keys of urls and starts of rules are sorted together; each rule
start carries the stack of rules it is nested in, and what is left of the last stack seen is active.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import kept, parallelism, safe_unions

C = F.col
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
DEFAULT = "allow"
STACK = "array<struct<size:int,key:string,rule:string,verdict:string>>"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def _stacks(rules: DataFrame) -> DataFrame:
    """key, stack: for each rule the rules whose key is a prefix of its own, outermost first."""
    keyed = rules.select(
        F.concat(F.array_join(_labels(C("host")), "."), F.lit("/"), C("path")).alias("key"),
        F.concat("host", "path").alias("rule"),
        "verdict",
    ).groupBy("key", "rule").agg(F.min("verdict").alias("verdict"))
    own = F.struct(F.length("key").alias("size"), "key", "rule", "verdict")
    starts = keyed.select(C("key").alias("start"), F.explode(F.sequence(F.lit(1), F.length("key"))).alias("cut"))
    starts = starts.select("start", F.expr("substring(start, 1, cut)").alias("key"))
    nested = starts.join(keyed, "key").groupBy("start").agg(F.array_sort(F.collect_list(own)).alias("stack"))
    return nested.select(C("start").alias("key"), C("stack").cast(STACK).alias("stack"))


def judged(urls: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """url, host, path, rule, verdict for every distinct non-null url; of fitting rules the longest decides.

    ``rules``: host, path, verdict. Rules that repeat a host and path act as one with the verdict that
    sorts first. Length is that of host and path together; of equal lengths the longer host decides.
    """
    safe_unions(urls.sparkSession)
    spark = urls.sparkSession
    stacks = kept(_stacks(rules), "rules")
    deepest = rules.agg(F.coalesce(F.max(F.size(_labels(C("host")))), F.lit(0)).alias("deepest"))
    known = urls.filter(C("url").isNotNull()).select("url").distinct()
    known = known.select("url", host_of(C("url")).alias("host"), path_of(C("url")).alias("path"))
    labels = known.withColumn("labels", _labels(C("host"))).withColumn("levels", F.least(F.size("labels"), deepest.scalar()))
    # A url has as many keys as the rules have levels, at most.
    level = F.explode(F.when(C("levels") > 0, F.sequence(F.lit(1), C("levels"))).otherwise(F.array().cast("array<int>"))).alias("level")
    points = labels.select("url", "labels", "path", level).select(
        "url", F.concat(F.array_join(F.slice("labels", F.lit(1), C("level")), "."), F.lit("/"), C("path")).alias("key")
    )
    events = points.withColumn("stack", F.lit(None).cast(STACK)).unionByName(stacks.withColumn("url", F.lit(None).cast("string")))
    # Equal keys are told apart by the url, so that a common key is spread too.
    ranged = events.repartitionByRange(parallelism(spark), "key", "url").withColumn("part", F.spark_partition_id())
    ranged = kept(ranged, "events")
    ends = ranged.filter(C("stack").isNotNull()).groupBy("part").agg(F.max_by("stack", "key").alias("stack"))
    # One row per range and, at most, as many rows as there are ranges.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.select("part").distinct().join(ends, "part", "left")
    carried = parts.select("part", F.last("stack", ignorenulls=True).over(before).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", F.col("url").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    swept = ranged.withColumn("seen", F.last("stack", ignorenulls=True).over(sweep)).filter(C("url").isNotNull())
    swept = swept.join(carried, "part", "left").withColumn("active", F.coalesce("seen", "carried"))
    inner = F.try_element_at(F.filter("active", lambda s: F.startswith(C("key"), s["key"])), F.lit(-1))
    best = (
        swept.filter(C("active").isNotNull())
        .withColumn("inner", inner)
        .filter(C("inner").isNotNull())
        .groupBy("url")
        .agg(F.max(F.struct(F.length("inner.rule").alias("size"), F.size(F.split("inner.key", r"\.")).alias("labels"), "inner.rule", "inner.verdict")).alias("best"))
    )
    return known.join(best, "url", "left").select(
        "url", "host", "path", C("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def filtered(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict for every page, repeated rows included.

    A null url and one without ``://`` have empty host and path and get the default. Each distinct url is
    judged once, so copies of one url cost one row until the last join. A null page_id stays null; other
    columns are ignored; an empty table or an empty rule table is no special case.
    """
    found = judged(pages, rules, default)
    out = pages.select("page_id", "url").join(found, "url", "left")
    return out.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def rule_table(spark, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
URL_SQL = f"""
WITH rules(h, p, v) AS (VALUES {_VALUES}),
parts AS (
    SELECT row_number() OVER () AS n, page_id,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
),
fits AS (
    SELECT n, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC) AS k
    FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT}') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) f ON parts.n = f.n
"""
