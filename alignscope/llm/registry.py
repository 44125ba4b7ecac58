"""The queries of the operators, and their SQL where there is one."""

from __future__ import annotations

from . import chat_format, decontaminate, exact_dedup, language_id, near_dup, secrets, sentencepiece_trie, suffix_dedup, url_filter, warc

QUERIES = {
    "op10_sentencepiece": sentencepiece_trie.query,
    "op1_near_dup": near_dup.query,
    "op2_secrets": secrets.query,
    "op3_url_filter": url_filter.query,
    "op4_language_id": language_id.query,
    "op5_warc": warc.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_chat_format": chat_format.query,
    "op8_decontaminate": decontaminate.query,
    "op9_suffix_dedup": suffix_dedup.query,
}
SQL = {
    "op2_secrets": secrets.SQL,
    "op5_warc": warc.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op7_chat_format": chat_format.SQL,
    "op8_decontaminate": decontaminate.SQL,
}
