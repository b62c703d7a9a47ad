"""Registered queries of the core library and the SQL they are checked against."""

from __future__ import annotations

from . import chain, corpus, detection, exports, glossary, graph, listing, mailing, records, redaction, registry, retrieval, search, spansuite, typed

MODULES = [detection, chain, corpus, exports, glossary, graph, listing, mailing, records, redaction, registry, retrieval, search, spansuite, typed]


def flagship(spark, sf_dir):
    """Detect with all patterns and mask."""
    return detection.redacted(spark, sf_dir)


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: q for m in MODULES for k, q in m.SQL.items()}
