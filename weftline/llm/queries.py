"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from weftline.llm import alignment, centroids, embedding_dedup, exact_dedup, html_extract, minhash_dedup, packing, personal, quality, sharding, token_counts, toxicity, transducer

QUERIES = {
    "op1_html_extraction": html_extract.op1_html_extraction,
    "op2_minhash_near_dedup": minhash_dedup.op2_minhash_near_dedup,
    "op3_embedding_near_dedup": embedding_dedup.op3_embedding_near_dedup,
    "op4_sharding": sharding.op4_sharding,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_bpe_round_trip": transducer.op6_bpe_round_trip,
    "op7_quality": quality.op7_quality,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_packing": packing.op10_packing,
    "op11_personal": personal.op11_personal,
    "op12_centroids": centroids.op12_centroids,
    "op13_alignment": alignment.op13_alignment,
}
ORACLES = {
    "op2_minhash_near_dedup": minhash_dedup.ORACLE,
    "op3_embedding_near_dedup": embedding_dedup.ORACLE,
    "op4_sharding": sharding.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op12_centroids": centroids.ORACLE,
}
