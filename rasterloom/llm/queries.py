"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from .bpe import op7_bpe
from .counts import op9_token_counts
from .jaccard import op2_ngram_jaccard
from .langid import op1_lang_id
from .lm import op3_lm_score
from .mixing import op5_mix_sources
from .quality import op4_quality_rules
from .shards import op10_hilbert_shards
from .suffix import op6_suffix_dedup
from .topk import OP8_SQL, op8_topk_inner

QUERIES = {
    "op1_lang_id": op1_lang_id,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_lm_score": op3_lm_score,
    "op4_quality_rules": op4_quality_rules,
    "op5_mix_sources": op5_mix_sources,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_bpe": op7_bpe,
    "op8_topk_inner": op8_topk_inner,
    "op9_token_counts": op9_token_counts,
    "op10_hilbert_shards": op10_hilbert_shards,
}
ORACLE_SQL = {"op8_topk_inner": OP8_SQL}
