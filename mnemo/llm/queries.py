"""The registered queries of this subpackage: each operator over the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemo.llm import clustering, decontamination, exact_dedup, licenses, packing, pieces, pii, quality, simhash, suffixes, token_counts, toxicity, variants
from mnemo.llm.common import benchmark, documents, embeddings, labels


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.duplicate_bytes(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    net, scores = toxicity.fit(documents(spark, sf_dir), labels(spark, sf_dir))
    return toxicity.verdicts(scores, net)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, labels(spark, sf_dir)))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(documents(spark, sf_dir))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.kmeans(embeddings(spark, sf_dir)).drop("computed")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_token_counts": op2_token_counts,
        "op3_suffixes": op3_suffixes,
        "op4_toxicity": op4_toxicity,
        "op5_quality": op5_quality,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_decontamination": op7_decontamination,
        "op8_pii": op8_pii,
        "op9_licenses": op9_licenses,
        "op10_simhash": op10_simhash,
        "op11_packing": op11_packing,
        "op12_variants": op12_variants,
        "op13_clusters": op13_clusters,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": exact_dedup.ORACLE, "op9_licenses": licenses.ORACLE, "op12_variants": variants.ORACLE, "op13_clusters": clustering.ORACLE}
