"""One registered query per operator over its whole table, with SQL where SQL can express the rows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanquarry.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op2_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanquarry.llm.quality import assess

    return assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanquarry.llm.bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanquarry.llm.ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), width=3, share=90, whole=100)


def op5_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanquarry.llm.mixing import report

    return report(_table(spark, sf_dir, "documents"))


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanquarry.llm.arc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages"))


def op7_collision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanquarry.llm.projections import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_license_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanquarry.llm.license_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op9_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanquarry.llm.line_dedup import report

    return report(_table(spark, sf_dir, "documents"))


def op10_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanquarry.llm.chat import format_chats, read_back

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(turns.unionByName(probe)))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanquarry.llm.merkle import audit

    return audit(_table(spark, sf_dir, "documents"))


def op12_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanquarry.llm.token_cache import report

    return report(_table(spark, sf_dir, "documents"))


def op13_orchard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanquarry.llm.orchard import cluster

    return cluster(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracles() -> dict[str, str]:
    from spanquarry.llm import merkle, orchard

    return {"op11_merkle_manifest": merkle.ORACLE, "op13_orchard_clusters": orchard.oracle()}
