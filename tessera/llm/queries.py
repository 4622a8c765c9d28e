"""The corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from tessera.llm.align import op12_align
from tessera.llm.bpe import op2_bpe
from tessera.llm.chat import OP11_SQL, op11_chat_format
from tessera.llm.fingerprint import op9_fingerprints
from tessera.llm.html_text import op8_html_text
from tessera.llm.mixing import OP6_SQL, op6_mix
from tessera.llm.near_dup import op4_near_duplicates
from tessera.llm.periodic import op13_periodic_runs
from tessera.llm.quality import op3_quality
from tessera.llm.substring import op10_substrings
from tessera.llm.toxicity import op1_toxicity
from tessera.llm.url_rules import op7_url_rules
from tessera.llm.warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe": op2_bpe,
    "op3_quality": op3_quality,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_warc": op5_warc,
    "op6_mix": op6_mix,
    "op7_url_rules": op7_url_rules,
    "op8_html_text": op8_html_text,
    "op9_fingerprints": op9_fingerprints,
    "op10_substrings": op10_substrings,
    "op11_chat_format": op11_chat_format,
    "op12_align": op12_align,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL = {
    "op5_warc": OP5_SQL,
    "op6_mix": OP6_SQL,
    "op11_chat_format": OP11_SQL,
}
