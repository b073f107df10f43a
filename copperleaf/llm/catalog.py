"""Queries and SQL of the operators."""

from __future__ import annotations

from . import bpe, chat, counts, html, jaccard, lines, negatives, packing, quality, repeats, secrets, topk, trie

MODULES = (secrets, quality, bpe, chat, packing, topk, html, repeats, jaccard, lines, trie, negatives, counts)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
