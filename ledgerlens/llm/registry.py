"""Queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from ledgerlens.llm import (
    conversation_trie,
    decontamination,
    embedding_dedup,
    hard_negatives,
    jaccard_join,
    line_dedup,
    mixing,
    packing,
    quality_rules,
    sharding,
    site_quality,
    suffix_dedup,
    toxicity,
)

QUERIES = {
    "op1_mixing": mixing.op1,
    "op2_quality_rules": quality_rules.op2,
    "op3_embedding_dedup": embedding_dedup.op3,
    "op4_sharding": sharding.op4,
    "op5_jaccard_join": jaccard_join.op5,
    "op6_quality_classifier": site_quality.op6,
    "op7_suffix_dedup": suffix_dedup.op7,
    "op8_toxicity": toxicity.op8,
    "op9_packing": packing.op9,
    "op10_line_dedup": line_dedup.op10,
    "op11_decontamination": decontamination.op11,
    "op12_conversation_trie": conversation_trie.op12,
    "op13_hard_negatives": hard_negatives.op13,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_mixing": mixing.op1_sql(),
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_decontamination": decontamination.OP11_SQL,
    "op12_conversation_trie": conversation_trie.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
