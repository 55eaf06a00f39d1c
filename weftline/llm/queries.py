"""Queries of the text operators, for the entry module."""

from __future__ import annotations

from weftline.llm.byte_bpe import op10_byte_bpe
from weftline.llm.chat_format import op6_chat_format
from weftline.llm.decontaminate import op5_decontaminate
from weftline.llm.embedding_dedup import op7_embedding_dedup
from weftline.llm.hard_negatives import op11_hard_negatives
from weftline.llm.hmm_score import op4_hmm_score
from weftline.llm.ngram_join import op1_ngram_join
from weftline.llm.oracles import ORACLE_SQL
from weftline.llm.quality_rules import op13_quality_rules
from weftline.llm.repeats import op2_repeats
from weftline.llm.token_align import op12_token_align
from weftline.llm.token_counts import op9_token_counts
from weftline.llm.toxicity import op8_toxicity
from weftline.llm.url_filter import op3_url_filter

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_repeats": op2_repeats,
    "op3_url_filter": op3_url_filter,
    "op4_hmm_score": op4_hmm_score,
    "op5_decontaminate": op5_decontaminate,
    "op6_chat_format": op6_chat_format,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_align": op12_token_align,
    "op13_quality_rules": op13_quality_rules,
}
