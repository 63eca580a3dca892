"""License scans: MinHash bands over overlapping text windows, verified by exact shingle containment.

Everything is Spark SQL over arrays of one row: words, hashes of five-word shingles, and for each band the
smallest rehashed value of every window of two neighbouring shingles. Only (place, value) pairs meet the
templates' band values, in a join whose small side is the template table; what is left is verified on the
shingles around the place. Texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import kept, safe_unions

C = F.col
SHINGLE = 5
#: Bands of one row each over windows of two shingles. A shingle stands in two windows; with its
#: two neighbours it is missed only if it is the largest of the three in every band: 3**-8 = 0.015 %.
#: Two shingles in a row give equal windows, which every band finds. Templates of one shingle are
#: found by the shingle itself, which follows as one more band.
BANDS = 8
LEAST = 0.8
SENT = 32 << 20  # bytes of templates that are sent whole to every executor, at most
NOT_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: Identifiers and the notices they stand for.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
]


def collision_probability(share: float, bands: int = BANDS, rows: int = 1) -> float:
    """Chance that two windows whose shingle sets have Jaccard similarity ``share`` meet in some band."""
    return 1.0 - (1.0 - share**rows) ** bands


def _words(text: Column) -> Column:
    return F.split(F.lower(text), NOT_WORD)


def _shingles(words: str) -> Column:
    """Hashes of the five-word shingles; none for fewer words."""
    at = F.sequence(F.lit(0), F.size(words) - SHINGLE)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(C(words), i + k) for k in range(SHINGLE)]))
    return F.when(F.size(words) >= SHINGLE, hashes).otherwise(F.array().cast("array<bigint>"))


def _signatures(shingles: str, bands: int) -> Column:
    """Band after band, the smallest rehashed value of each window of two shingles (the last window has one); then the shingles."""

    def band(number: int) -> Column:
        own = F.transform(shingles, lambda h: F.xxhash64(h, F.lit(number)))
        return F.zip_with(own, F.slice(own, 2, F.size(shingles)), lambda a, b: F.least(a, b))

    return F.flatten(F.array(*[band(k) for k in range(bands)], C(shingles)))


def _hashed(rows: DataFrame, bands: int) -> DataFrame:
    """Adds shingles and signatures to rows with a column ``text``."""
    rows = rows.withColumn("words", _words(C("text"))).withColumn("shingles", _shingles("words")).drop("words", "text")
    return rows.withColumn("signatures", F.when(F.size("shingles") > 0, _signatures("shingles", bands)).otherwise(F.array().cast("array<bigint>")))


def template_bands(templates: DataFrame, bands: int = BANDS) -> DataFrame:
    """license, n (number of its distinct shingles), band, value. Templates under five words have no row."""
    found = _hashed(inner(templates).select("license", "text"), bands)
    place = found.select("license", "shingles", F.posexplode_outer("signatures").alias("pos", "value")).filter(C("value").isNotNull())
    n = F.size(F.array_distinct("shingles"))
    found = place.select("license", n.alias("n"), F.expr("pos div size(shingles)").alias("band"), "value").distinct()
    return found.filter((C("band") < bands) | (C("n") == 1))


def template_parts(templates: DataFrame) -> DataFrame:
    """license, parts: the distinct shingles of each template."""
    words = inner(templates).select("license", _words(C("text")).alias("words"))
    return words.select("license", F.array_distinct(_shingles("words")).alias("parts"))


def inner(templates: DataFrame) -> DataFrame:
    """The templates from their first word to their last.

    Splitting a text that ends in a full stop leaves an empty word there, which a document has only at its
    own end; without it a notice holds the same shingles anywhere.
    """
    text = F.regexp_replace(F.lower("text"), f"^{NOT_WORD}|{NOT_WORD}$", "")
    return templates.withColumn("text", text)


def _small(table: DataFrame, size: Column) -> DataFrame:
    """The table, sent to every executor if its summed size allows; else the planner joins it by shuffles."""
    held = table.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(table) if held <= SENT else table


def scanned(docs: DataFrame, templates: DataFrame, bands: int = BANDS, least: float = LEAST) -> DataFrame:
    """doc_id, license, containment for each license a document holds at least ``least`` of.

    Containment is the largest share of a template's distinct five-word shingles found in a stretch of twice
    its length around a retrieved window. Words are runs of ASCII letters and digits and of
    non-ASCII characters, in lower case; templates count from their first word to their last. Whole texts
    are scanned; null, empty and very short texts hold no license. Rows that repeat a doc_id are taken together, rows without id likewise. Other
    columns are ignored; empty tables give an empty result.
    """
    safe_unions(docs.sparkSession)
    rows = _hashed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), bands)
    # The outer form keeps the planner from repeating the whole computation in a filter below.
    places = rows.select("doc_id", "shingles", F.posexplode_outer("signatures").alias("pos", "value"))
    known = _small(kept(template_bands(templates, bands), "bands"), F.length("license") + 48)
    parts = _small(kept(template_parts(templates), "parts"), F.length("license") + 8 * F.size("parts") + 48)
    hits = places.join(known, "value").filter(F.expr("pos div size(shingles)") == C("band")).join(parts, "license")
    at = F.expr("pos % size(shingles)")
    stretch = F.slice("shingles", F.greatest(at - C("n") + 1, F.lit(0)) + 1, at + C("n") - F.greatest(at - C("n") + 1, F.lit(0)) + 1)
    share = F.size(F.array_intersect(stretch, "parts")) / C("n")
    found = hits.select("doc_id", "license", share.alias("share")).filter(C("share") >= least)
    return found.groupBy("doc_id", "license").agg(F.max("share").alias("containment"))


def template_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame(templates, "license string, text string")


_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in TEMPLATES)
_JOINED = " || ' ' || ".join(f"w[i + {k}]" for k in range(SHINGLE))
LICENSE_SQL = f"""
WITH t(license, text) AS (VALUES {_VALUES}),
tw AS (SELECT license, string_split_regex(regexp_replace(lower(text), '^{NOT_WORD}|{NOT_WORD}$', '', 'g'), '{NOT_WORD}') AS w FROM t),
ts AS (SELECT DISTINCT license, {_JOINED} AS s FROM (SELECT license, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM tw)),
tn AS (SELECT license, count(*) AS n FROM ts GROUP BY 1),
dw AS (SELECT doc_id, row_number() OVER () AS r, string_split_regex(lower(coalesce(text, '')), '{NOT_WORD}') AS w FROM documents),
ds AS (SELECT doc_id, r, i, {_JOINED} AS s FROM (SELECT doc_id, r, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM dw)),
hits AS (SELECT doc_id, r, i, license, n, ts.s FROM ds JOIN ts ON ds.s = ts.s JOIN tn USING (license)),
places AS (SELECT DISTINCT doc_id, r, license, n, i - k AS i FROM hits, (VALUES (0), (1)) o(k) WHERE i - k >= 1),
shares AS (
    SELECT p.doc_id, p.r, p.license, p.i, count(DISTINCT h.s) / p.n AS share
    FROM places p JOIN hits h ON p.r = h.r AND p.license = h.license AND h.i BETWEEN p.i - p.n + 1 AND p.i + p.n
    GROUP BY p.doc_id, p.r, p.license, p.i, p.n
)
SELECT doc_id, license, max(share)::DOUBLE AS containment FROM shares WHERE share >= {LEAST} GROUP BY 1, 2
"""
