"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import bpe, capture_index, jaccard, langid, mixing, near_vectors, pii, sharding, suffix_dedup, topk

QUERIES = {
    "op1_capture_index": capture_index.op1_capture_index,
    "op2_sharding": sharding.op2_sharding,
    "op3_bpe": bpe.op3_bpe,
    "op4_embedding_neardup": near_vectors.op4_embedding_neardup,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_pii": pii.op6_pii,
    "op7_language_id": langid.op7_language_id,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_topk": topk.op9_topk,
    "op10_mixing": mixing.op10_mixing,
}

SQL = {"op1_capture_index": capture_index.SQL, "op5_jaccard_join": jaccard.SQL, "op8_suffix_dedup": suffix_dedup.SQL, "op9_topk": topk.SQL, "op10_mixing": mixing.SQL}
