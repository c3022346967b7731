"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import bpe, compression, jaccard_join, language_id, line_dedup, merkle, minhash, mixing, packing, quality_rank, ranked_search, suffix_dedup, toxicity
from tessera.llm.shared import shipped


def queries() -> dict:
    import corpus_pipeline

    found = {
        "op1_string_kernel_toxicity": toxicity.op1_string_kernel_toxicity,
        "op2_compression_bands": compression.op2_compression_bands,
        "op3_weighted_fair_mix": mixing.op3_weighted_fair_mix,
        "op4_transducer_bpe": bpe.op4_transducer_bpe,
        "op5_hierarchical_language_id": language_id.op5_hierarchical_language_id,
        "op6_minhash_fingerprints": minhash.op6_minhash_fingerprints,
        "op7_difference_cover_dedup": suffix_dedup.op7_difference_cover_dedup,
        "op8_set_relation_join": jaccard_join.op8_set_relation_join,
        "op9_bradley_terry_quality": quality_rank.op9_bradley_terry_quality,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op11_bounded_space_packing": packing.op11_bounded_space_packing,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_clustered_ranked_search": ranked_search.op13_clustered_ranked_search,
        "pipeline": corpus_pipeline.run,
    }
    return {name: shipped(query) for name, query in found.items()}


def oracle_sql() -> dict:
    return {
        "op3_weighted_fair_mix": mixing.SQL,
        "op8_set_relation_join": jaccard_join.SQL,
        "op10_line_dedup": line_dedup.SQL,
        "op12_merkle_manifest": merkle.SQL,
        "op13_clustered_ranked_search": ranked_search.SQL,
    }
