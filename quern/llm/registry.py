"""Queries of this subpackage by name."""

from __future__ import annotations

from quern.llm import queries_dedup as dedup
from quern.llm import queries_models as models
from quern.llm import queries_search as search
from quern.llm import queries_tokens as tokens
from quern.llm import queries_web as web

_QUERIES = [web.op1_html_extraction, dedup.op2_fingerprints, web.op3_warc, tokens.op4_best_fit_packing, tokens.op5_byte_level_bpe, search.op6_exact_top_k, models.op7_language_id, dedup.op8_simhash_near_dedup, models.op9_quality_classifier, tokens.op10_token_counts]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": web.OP3_SQL, "op6_exact_top_k": search.OP6_SQL}
