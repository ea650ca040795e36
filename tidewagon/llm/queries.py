"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewagon.llm import (
    centroids, decontaminate, imatch, langid, lm, mixing, packing, pii, quality, simhash, toxicity, urlfilter, vector_codes,
)
from tidewagon.llm.common import ship, table


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_documents(table(spark, folder, "documents"))


def op5_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return urlfilter.evaluate(urlfilter.derived_captures(pages), urlfilter.derived_entries(pages))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(table(spark, folder, "documents"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.report(table(spark, folder, "documents"))


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.fingerprints(table(spark, folder, "documents"))


def op11_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(table(spark, folder, "embeddings"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(table(spark, folder, "embeddings"))


_ALL = (op1_language_id, op2_packing, op3_decontamination, op4_lm_scoring, op5_url_filters, op6_quality,
        op7_personal_data, op8_toxicity, op9_simhash, op10_fingerprints, op11_mixing, op12_centroids,
        op13_vector_codes)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def sent(query):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return query(spark, folder)
        return run

    return {f.__name__: sent(f) for f in _ALL}


def llm_oracles() -> dict[str, str]:
    return {"op5_url_filters": urlfilter.ORACLE_SQL, "op12_centroids": centroids.ORACLE_SQL,
            "op13_vector_codes": vector_codes.ORACLE_SQL}
