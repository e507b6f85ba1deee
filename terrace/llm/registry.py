"""Every query of this subpackage, with its SQL where SQL can express it."""

from __future__ import annotations

from . import chat, fingerprints, jaccard, mixing, notices, pieces, suffixes, topk, toxicity, url_rules

MODULES = [suffixes, topk, notices, fingerprints, jaccard, toxicity, url_rules, mixing, pieces, chat]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
