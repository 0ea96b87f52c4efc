"""Tunables of retrieval, as one immutable object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RetrievalConfig:
    # hybrid score
    semantic: float = 0.55
    keyword: float = 0.25
    path: float = 0.10
    identifier: float = 0.07
    chunk_type: float = 0.03
    # second ranking
    rank_similarity: float = 0.55
    rank_type: float = 0.15
    rank_name: float = 0.15
    rank_appearances: float = 0.08
    rank_path: float = 0.07
    # retrieval
    top_k: int = 5
    most_per_variant: int = 8
    similarity_threshold: float = 0.35
    memory_threshold: float = 0.30
    rrf_k: int = 60
    context_tokens: int = 1200
    # chunking
    chunk_size: int = 500
    chunk_overlap: int = 50
    # BM25+
    k1: float = 1.5
    b: float = 0.75
    delta: float = 1.0
