"""The corpus operators' queries and their SQL."""

from noteforge.llm import audio, exact_dedup, lm, merkle, mixing, near_dedup, packing, private, sharding, time_layout, token_ids, tokens, toxicity

QUERIES = {
    "op1_histogram_shards": sharding.op1_histogram_shards,
    "op2_exact_bloom": exact_dedup.op2_exact_bloom,
    "op3_odd_sketches": near_dedup.op3_odd_sketches,
    "op4_chroma_align": audio.op4_chroma_align,
    "op5_label_model": toxicity.op5_label_model,
    "op6_whole_tokens": tokens.op6_whole_tokens,
    "op7_length_buckets": packing.op7_length_buckets,
    "op8_gru": lm.op8_gru,
    "op9_mix_blocks": mixing.op9_mix_blocks,
    "op10_token_ids": token_ids.op10_token_ids,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_time_partitions": time_layout.op12_time_partitions,
    "op13_private_spans": private.op13_private_spans,
}
SQL = {"op2_exact_bloom": exact_dedup.SQL_OP2, "op3_odd_sketches": near_dedup.SQL_OP3, "op11_merkle_manifest": merkle.SQL_OP11}
