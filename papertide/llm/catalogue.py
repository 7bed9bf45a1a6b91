"""Queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from . import byte_bpe, chat, conversation_repair, jaccard, packing, quality, secrets_index, sharding, suffix_dedup, token_counts, topk, training_order, whitening


def queries() -> dict:
    found = [
        jaccard.op1_adaptive_prefix_jaccard,
        token_counts.op2_token_counts,
        sharding.op3_jump_hash_shards,
        topk.op4_threshold_top_k,
        packing.op5_nnls_packing,
        byte_bpe.op6_chunked_byte_bpe,
        training_order.op7_feistel_order,
        chat.op8_grammar_round_trip,
        secrets_index.op9_trigram_secret_scan,
        quality.op10_ngram_llr_quality,
        suffix_dedup.op11_suffix_array_dedup,
        whitening.op12_block_lanczos_whitening,
        conversation_repair.op13_conversation_repair,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_adaptive_prefix_jaccard": jaccard.OP1_SQL, "op4_threshold_top_k": topk.OP4_SQL, "op8_grammar_round_trip": chat.OP8_SQL}
