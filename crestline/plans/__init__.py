"""Queries of the broadcast operators, bound to the given tables, with their SQL oracles."""

from __future__ import annotations

from . import audio, catalog, chat, context, fusion, gates, live, selection, texts

_MODULES = (chat, audio, fusion, selection, catalog, texts, live, gates, context)
FLAGSHIP = fusion.fused_reactions


def queries():
    return {name: query for m in _MODULES for name, (query, _) in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
