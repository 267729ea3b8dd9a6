"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from . import language, lines, mixing, ngrams, pieces, quality, secrets, tokens, toxicity, vectors

MODULES = [quality, secrets, lines, ngrams, mixing, vectors, pieces, tokens, language, toxicity]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
