"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from tidemark.llm import chat, decontamination, licenses, line_dedup, ngram_join, packing, secrets, topk, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_secrets": secrets.op2_secrets,
    "op3_packing": packing.op3_packing,
    "op4_chat": chat.op4_chat,
    "op5_licenses": licenses.op5_licenses,
    "op6_topk": topk.op6_topk,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_decontamination": decontamination.op10_decontamination,
}

SQL = {
    "op1_url_filter": url_filter.SQL,
    "op2_secrets": secrets.SQL,
    "op4_chat": chat.SQL,
    "op6_topk": topk.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op9_ngram_join": ngram_join.SQL,
}
