"""All queries of the engine with their oracles: what textloom computes, over the driver's tables.

A "version" is a document, a "verse" a line; keys of the star schema stand for books and chapters.
"""

from __future__ import annotations

from . import chain, corpus, formats, intake, limits, orders, review, texts

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (texts, corpus, orders, limits, formats, review, chain, intake):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
