"""The queries and the SQL of this subpackage."""

from __future__ import annotations

from tidewater.llm import jaccard, language_model, mixing, quality_model, rules, secret_scan, tokenizer, urls, vectors, warc

MODULES = [jaccard, language_model, mixing, quality_model, rules, secret_scan, tokenizer, urls, vectors, warc]

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
