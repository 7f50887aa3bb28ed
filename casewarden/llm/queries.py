"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from casewarden.llm.chat import OP1_SQL, op1_chat_format
from casewarden.llm.decontaminate import OP7_SQL, op7_decontaminate
from casewarden.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from casewarden.llm.html_text import op6_html_text
from casewarden.llm.kd_shards import op10_kd_shards
from casewarden.llm.minhash import op4_minhash_dedup
from casewarden.llm.mixing import op8_mix_sources
from casewarden.llm.quality import op5_quality
from casewarden.llm.ranked_search import OP11_SQL, op11_ranked_search
from casewarden.llm.sanitise import op13_sanitise
from casewarden.llm.secrets import op9_secret_scan
from casewarden.llm.token_shards import op3_token_shards
from casewarden.llm.whitening import op12_whitening

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_shards": op3_token_shards,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_quality": op5_quality,
    "op6_html_text": op6_html_text,
    "op7_decontaminate": op7_decontaminate,
    "op8_mix_sources": op8_mix_sources,
    "op9_secret_scan": op9_secret_scan,
    "op10_kd_shards": op10_kd_shards,
    "op11_ranked_search": op11_ranked_search,
    "op12_whitening": op12_whitening,
    "op13_sanitise": op13_sanitise,
}

SQL = {"op1_chat_format": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op7_decontaminate": OP7_SQL, "op11_ranked_search": OP11_SQL}
