"""The registered queries of this subpackage: opN_<name>(spark, sf_dir), and their DuckDB SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bm25, byte_bpe, collocations, decontam, drake, langid, mixing, pii, quality, secret_scan, simhash, toxicity, warc
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op11_drake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drake.assignments(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_language, op3_warc, op4_mixing, op5_bm25, op6_secrets, op7_quality, op8_decontamination, op9_simhash, op10_pii, op11_drake, op12_collocations,
        op13_byte_bpe,
    )
}
ORACLE = {
    "op3_warc": warc.ORACLE_SQL,
    "op4_mixing": mixing.ORACLE_SQL,
    "op5_bm25": bm25.ORACLE_SQL,
    "op6_secrets": secret_scan.ORACLE_SQL,
    "op8_decontamination": decontam.ORACLE_SQL,
    "op11_drake": drake.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
}
