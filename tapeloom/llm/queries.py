"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.bpe import encoded
from tapeloom.llm.common import find_package, safe_unions, table
from tapeloom.llm.ctph import fingerprinted
from tapeloom.llm.ftrl import quality
from tapeloom.llm.licenses import LICENSE_SQL, scanned, template_table
from tapeloom.llm.lm import scores
from tapeloom.llm.mixing import mixed, mixing_sql
from tapeloom.llm.phrases import PHRASE_SQL, collocations
from tapeloom.llm.simhash import near_duplicates
from tapeloom.llm.spelling import SPELLING_SQL, variants
from tapeloom.llm.urls import URL_SQL, filtered, rule_table
from tapeloom.llm.voronoi import TOP_SQL, nearest
from tapeloom.llm.warc import WARC_SQL, archived
from tapeloom.llm.wrapper import extracted

C = F.col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        safe_unions(spark)
        find_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


ORACLES["op2_mixing"] = mixing_sql()


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archived(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "captured_at")


ORACLES["op1_warc"] = WARC_SQL


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages"), rule_table(spark))


ORACLES["op4_url_filter"] = URL_SQL


@query
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


ORACLES["op6_topk"] = TOP_SQL


@query
def op9_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))


@query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"), template_table(spark))


ORACLES["op3_licenses"] = LICENSE_SQL


@query
def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


@query
def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


@query
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLES["op12_phrases"] = PHRASE_SQL


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


ORACLES["op13_spelling"] = SPELLING_SQL
