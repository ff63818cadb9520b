"""Imports every module that registers queries."""

from llm import collocations, decontamination, html_text, jaccard_join, lm_scoring, lz_dedup, mixing, secret_scan, spelling_variants, suffix_dedup, token_records, topk_search, toxicity  # noqa: F401
from llm.registry import ORACLES, QUERIES  # noqa: F401
