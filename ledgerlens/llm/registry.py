"""The queries and oracle SQL of this subpackage."""

from __future__ import annotations

from ledgerlens.llm.html import op1_html_extraction
from ledgerlens.llm.jaccard import OP2_SQL, op2_ngram_jaccard_join
from ledgerlens.llm.media import op8_media_columns
from ledgerlens.llm.mixture import op9_source_mixture
from ledgerlens.llm.pieces import op5_sentencepiece_sampling
from ledgerlens.llm.quality import op10_quality_classifier
from ledgerlens.llm.sharding import op3_sharding
from ledgerlens.llm.spans import op6_substring_dedup
from ledgerlens.llm.tokenfile import op4_token_file
from ledgerlens.llm.topk import OP7_SQL, op7_exact_topk


def queries() -> dict:
    return {"op1_html_extraction": op1_html_extraction, "op2_ngram_jaccard_join": op2_ngram_jaccard_join, "op3_sharding": op3_sharding, "op4_token_file": op4_token_file, "op5_sentencepiece_sampling": op5_sentencepiece_sampling, "op6_substring_dedup": op6_substring_dedup, "op7_exact_topk": op7_exact_topk, "op8_media_columns": op8_media_columns, "op9_source_mixture": op9_source_mixture, "op10_quality_classifier": op10_quality_classifier}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": OP2_SQL, "op7_exact_topk": OP7_SQL}
