"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from auditlake.llm.bpe import op3_bpe
from auditlake.llm.conversations import op11_conversations
from auditlake.llm.decontaminate import op10_decontamination
from auditlake.llm.fingerprints import op6_fingerprints
from auditlake.llm.html_text import op4_html_text
from auditlake.llm.near_dedup import op9_near_duplicates
from auditlake.llm.oracle import OP11, OP12, OP13
from auditlake.llm.quality import op8_quality
from auditlake.llm.recurrent_lm import op5_recurrent_lm
from auditlake.llm.resampling import op12_resampling
from auditlake.llm.suffix_dedup import op13_repeats
from auditlake.llm.token_counts import op2_token_counts
from auditlake.llm.toxicity import op1_toxicity
from auditlake.llm.url_filter import op7_url_filter

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_bpe": op3_bpe,
    "op4_html_text": op4_html_text,
    "op5_recurrent_lm": op5_recurrent_lm,
    "op6_fingerprints": op6_fingerprints,
    "op7_url_filter": op7_url_filter,
    "op8_quality": op8_quality,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_decontamination": op10_decontamination,
    "op11_conversations": op11_conversations,
    "op12_resampling": op12_resampling,
    "op13_repeats": op13_repeats,
}
ORACLE_SQL: dict[str, str] = {"op11_conversations": OP11, "op12_resampling": OP12, "op13_repeats": OP13}
