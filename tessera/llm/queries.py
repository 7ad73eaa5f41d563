"""The queries of this subpackage, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import byte_bpe, centroids, chat_format, jaccard_join, merkle_manifest, nb_svm, nn_descent, packing, piece_bpe, prefix_trees, quality_rules, suffix_index, zstd_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.op1_packing,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_zstd_toxicity": zstd_toxicity.op3_zstd_toxicity,
    "op4_nb_svm": nb_svm.op4_nb_svm,
    "op5_suffix_dedup": suffix_index.op5_suffix_dedup,
    "op6_substring_dedup": prefix_trees.op6_substring_dedup,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_nn_descent": nn_descent.op8_nn_descent,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_piece_bpe": piece_bpe.op11_piece_bpe,
    "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
    "op13_centroids": centroids.op13_centroids,
}
ORACLE_SQL: dict[str, str] = {
    "op5_suffix_dedup": suffix_index.OP5_SQL,
    "op6_substring_dedup": prefix_trees.OP6_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
    "op8_nn_descent": nn_descent.OP8_SQL,
    "op9_jaccard_join": jaccard_join.OP9_SQL,
    "op10_chat_format": chat_format.OP10_SQL,
    "op12_merkle_manifest": merkle_manifest.OP12_SQL,
    "op13_centroids": centroids.OP13_SQL,
}
