"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from tesserae.llm import bpe, codes, curves, embed_dedup, fim, langid, mixing, quality, sharding, simhash, substring, token_count, warc

QUERIES = {
    "op1_embedding_near_dedup": embed_dedup.op1,
    "op2_substring_dedup": substring.op2,
    "op3_language_id": langid.op3,
    "op4_simhash_near_dedup": simhash.op4,
    "op5_warc": warc.op5,
    "op6_byte_bpe": bpe.op6,
    "op7_quality_outliers": quality.op7,
    "op8_source_mixing": mixing.op8,
    "op9_hash_tree_sharding": sharding.op9,
    "op10_token_counts": token_count.op10,
    "op11_curve_neighbours": curves.op11,
    "op12_vector_codes": codes.op12,
    "op13_fill_in_middle": fim.op13,
}

ORACLE_SQL = {
    "op1_embedding_near_dedup": embed_dedup.OP1_SQL,
    "op2_substring_dedup": substring.OP2_SQL,
    "op5_warc": warc.OP5_SQL,
    "op7_quality_outliers": quality.sql(),
    "op8_source_mixing": mixing.OP8_SQL,
    "op9_hash_tree_sharding": sharding.OP9_SQL,
    "op12_vector_codes": codes.sql(),
    "op13_fill_in_middle": fim.OP13_SQL,
}
