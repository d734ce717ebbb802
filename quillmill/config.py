"""Settings of an engine; every operator takes the values it needs as parameters with these defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Chunk sizes, document limit, inbox, time zone and ranking constants."""

    max_chars: int = 1500
    overlap: int = 150
    max_document_mb: int = 25
    inbox: str = "_inbox"
    timezone: str = "Europe/Berlin"
    embedding_model: str = "hash-256"
    sync_seconds: int = 300
    rrf_k: int = 60
    title_weight: float = 5.0
    headings_weight: float = 2.0
    text_weight: float = 1.0
    k1: float = 1.2
    b: float = 0.75
    keep_snapshots: int = 14
