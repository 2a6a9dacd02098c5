"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from loamgrid.llm import exactdup, hardneg, langid, linedup, lmscore, merkle, neardup, packing, pieces, quality, sharding, suffixdup, warc

QUERIES = {
    "op1_tiered_shards": sharding.op1_tiered_shards,
    "op2_indexed_warc": warc.op2_indexed_warc,
    "op3_setsketch_neardup": neardup.op3_setsketch_neardup,
    "op4_recurrent_lm_score": lmscore.op4_recurrent_lm_score,
    "op5_pattern_packing": packing.op5_pattern_packing,
    "op6_line_frequency_quality": quality.op6_line_frequency_quality,
    "op7_tree_merge_dedup": exactdup.op7_tree_merge_dedup,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_output_codes_langid": langid.op9_output_codes_langid,
    "op10_sparse_suffix_dedup": suffixdup.op10_sparse_suffix_dedup,
    "op11_line_dedup": linedup.op11_line_dedup,
    "op12_strassen_hard_negatives": hardneg.op12_strassen_hard_negatives,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLES = {**sharding.ORACLE, **warc.ORACLE, **exactdup.ORACLE, **linedup.ORACLE, **hardneg.ORACLE, **merkle.ORACLE}
