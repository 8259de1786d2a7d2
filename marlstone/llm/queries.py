"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from marlstone.llm import ann, licenses, lm, mixing, packing, pii, quality, repair, resample, search, simhash, tokens, urls


def queries() -> dict:
    return {
        "op1_length_buckets": packing.op1_length_buckets,
        "op2_quality_lines": quality.op2_quality_lines,
        "op3_feistel_pseudonyms": pii.op3_feistel_pseudonyms,
        "op4_simhash_bitsliced": simhash.op4_simhash_bitsliced,
        "op5_hilbert_neighbours": ann.op5_hilbert_neighbours,
        "op6_token_digest_cache": tokens.op6_token_digest_cache,
        "op7_hash_threshold_mix": mixing.op7_hash_threshold_mix,
        "op8_license_rules": licenses.op8_license_rules,
        "op9_url_char_lm": urls.op9_url_char_lm,
        "op10_gru_scores": lm.op10_gru_scores,
        "op11_maxscore_search": search.op11_maxscore_search,
        "op12_crc_resample": resample.op12_crc_resample,
        "op13_conversation_repair": repair.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_lines": quality.OP2_SQL,
        "op7_hash_threshold_mix": mixing.OP7_SQL,
        "op11_maxscore_search": search.OP11_SQL,
        "op12_crc_resample": resample.OP12_SQL,
        "op13_conversation_repair": repair.OP13_SQL,
    }
