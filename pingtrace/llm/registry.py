"""Queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from pingtrace.llm import bit_sliced_topk, jaccard_join, mixing, phrases
from pingtrace.llm.alignment import op11_token_alignment
from pingtrace.llm.decontamination import op1_benchmark_decontamination
from pingtrace.llm.pii import op8_pii
from pingtrace.llm.quality_classifier import op9_quality_classifier
from pingtrace.llm.quality_rules import op10_quality_rules
from pingtrace.llm.secret_scan import op7_secret_scans
from pingtrace.llm.suffix_dedup import op6_suffix_dedup
from pingtrace.llm.token_counts import op4_token_counts
from pingtrace.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_secret_scans": op7_secret_scans,
    "op8_pii": op8_pii,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_quality_rules": op10_quality_rules,
    "op11_token_alignment": op11_token_alignment,
    "op12_phrase_collocations": phrases.op12_phrase_collocations,
    "op13_bit_sliced_topk": bit_sliced_topk.op13_bit_sliced_topk,
}

ORACLE_SQL = {
    "op2_source_mixing": mixing.ORACLE_SQL,
    "op3_jaccard_join": jaccard_join.ORACLE_SQL,
    "op12_phrase_collocations": phrases.ORACLE_SQL,
    "op13_bit_sliced_topk": bit_sliced_topk.ORACLE_SQL,
}
