"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from xqengine.llm import decontamination, jaccard, mixing, quality, sharding, substring_dedup
from xqengine.llm.lm_scoring import op1_lm_scoring
from xqengine.llm.token_counts import op8_token_counts
from xqengine.llm.token_file import op4_token_files
from xqengine.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_jaccard": jaccard.op3_ngram_jaccard,
    "op4_token_files": op4_token_files,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_quality": quality.op7_quality,
    "op8_token_counts": op8_token_counts,
    "op9_sharding": sharding.op9_sharding,
    "op10_mixing": mixing.op10_mixing,
}
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard": jaccard.ORACLE,
    "op5_substring_dedup": substring_dedup.ORACLE,
    "op6_decontamination": decontamination.ORACLE,
    "op7_quality": quality.ORACLE,
    "op9_sharding": sharding.ORACLE,
    "op10_mixing": mixing.ORACLE,
}
