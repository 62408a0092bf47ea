"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from gridsift.llm import block_topk, centroid_clusters, embedding_dedup, fill_in_middle, fingerprints, katz, language_id, minhash_dedup, mixing, sampled_pieces, tokens_orc, toxicity, url_filter

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.query,
    "op2_url_filter": url_filter.query,
    "op3_sampled_pieces": sampled_pieces.query,
    "op4_katz": katz.query,
    "op5_language_id": language_id.query,
    "op6_minhash_dedup": minhash_dedup.query,
    "op7_mixing": mixing.query,
    "op8_toxicity": toxicity.query,
    "op9_token_orc": tokens_orc.query,
    "op10_fingerprints": fingerprints.query,
    "op11_centroid_clusters": centroid_clusters.query,
    "op12_fill_in_middle": fill_in_middle.query,
    "op13_block_topk": block_topk.query,
}
ORACLES: dict[str, str] = {
    "op1_embedding_dedup": embedding_dedup.ORACLE,
    "op6_minhash_dedup": minhash_dedup.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op11_centroid_clusters": centroid_clusters.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
    "op13_block_topk": block_topk.ORACLE,
}
