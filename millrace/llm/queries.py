"""Queries of the corpus operators, for the entry module."""

from __future__ import annotations

from . import bpe, chat, embeddingdedup, jaccard, linededup, neighbours, packing, quality, suffixdedup, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_suffix_dedup": suffixdedup.op2_suffix_dedup,
    "op3_neighbours": neighbours.op3_neighbours,
    "op4_packing": packing.op4_packing,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_bpe": bpe.op6_bpe,
    "op7_quality": quality.op7_quality,
    "op8_chat": chat.op8_chat,
    "op9_embedding_dedup": embeddingdedup.op9_embedding_dedup,
    "op10_line_dedup": linededup.op10_line_dedup,
}
ORACLE: dict[str, str] = {"op5_jaccard": jaccard.ORACLE, "op9_embedding_dedup": embeddingdedup.ORACLE, "op10_line_dedup": linededup.ORACLE}
