"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, langid, ngram_join, packing, quality, secrets, token_counts, token_store, toxicity, warc

_MODULES = (ngram_join, packing, warc, toxicity, secrets, token_store, langid, token_counts, quality, decontaminate)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
