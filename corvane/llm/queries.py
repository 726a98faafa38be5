"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import count_rollup, cover_dedup, curve_packing, jump_shards, line_templates, paragraph_sketch, rule_ledger, simhash_planes, slot_mixing, token_blocks

QUERIES = {
    "op1_token_blocks": token_blocks.op1,
    "op2_rule_ledger": rule_ledger.op2,
    "op3_jump_shards": jump_shards.op3,
    "op4_simhash_planes": simhash_planes.op4,
    "op5_count_rollup": count_rollup.op5,
    "op6_curve_packing": curve_packing.op6,
    "op7_line_templates": line_templates.op7,
    "op8_paragraph_sketch": paragraph_sketch.op8,
    "op9_slot_mixing": slot_mixing.op9,
    "op10_cover_dedup": cover_dedup.op10,
    "rollup_words_bytes": count_rollup.rollup_words_bytes,
    "pipeline": corpus_pipeline.run,
}
ORACLE: dict[str, str] = {"op2_rule_ledger": rule_ledger.OP2_SQL, "rollup_words_bytes": count_rollup.WORDS_BYTES_SQL}
