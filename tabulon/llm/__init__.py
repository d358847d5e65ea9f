"""Operators for training data, their queries and SQL. Nothing else of the library imports this subpackage."""

from __future__ import annotations

from . import exact_dedup, html_text, language_id, near_dedup, packing, quality, secret_scan, tokens, toxicity

QUERIES = {f.__name__: f for f in (language_id.op1_language_id, packing.op2_best_fit_packing, near_dedup.op3_near_dedup, quality.op4_quality_outliers, tokens.op5_bpe, secret_scan.op6_secret_scan, toxicity.op7_toxicity, exact_dedup.op8_exact_dedup, tokens.op9_token_counts, html_text.op10_html_text)}
SQL = {"op8_exact_dedup": exact_dedup.OP8_SQL}
