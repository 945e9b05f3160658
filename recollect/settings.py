"""Tunables shared by the operators, with their environment overrides."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

# Defaults that results depend on.
CHUNK_SIZE = 6000
CODE_CHUNK_FLOOR = 2000
VAULT_MIN, VAULT_MAX, VAULT_OVERLAP = 3600, 4800, 200
BM25_K1, BM25_B = 1.2, 0.75
RRF_K = 60
DECAY_START_HOURS, DECAY_RATE_PER_DAY = 168.0, 0.01
TIMELESS_IMPORTANCE = 4.0
STALE_DAYS = 90
TRACE_DEPTH = 5
CONTEXT_TOKENS = 10_000
USAGE_RETENTION_DAYS = 90
USAGE_TZ = "Asia/Kuala_Lumpur"
PENDING_CAPACITY, PENDING_ATTEMPTS, PENDING_RETENTION_SECONDS = 500, 5, 3600
MAX_CONTENT_BYTES, MAX_QUERY_BYTES, MAX_CODE_FILE_BYTES = 100_000, 5_000, 500 * 1024
SHARED_WORKSPACE = "_global"
ROLES = ("user", "assistant", "system")

# Metadata keys kept on write; the rest of a caller's map is dropped.
METADATA_KEYS = (
    "source_type", "source_path", "header_path", "chunk_type", "tags", "importance",
    "agent", "language", "parent_doc_id", "doc_title", "chunk_id", "file_hash",
    "entities", "summary_1line",
)


def _csv(raw: str) -> tuple[str, ...]:
    return tuple(w for w in (part.strip().lower() for part in raw.split(",")) if w)


@dataclass(frozen=True)
class Settings:
    min_score: float = 0.22
    excluded_workspaces: tuple[str, ...] = field(default=("finance",))
    librarian_mode: str = "workflow"
    embed_dimensions: int = 768
    embed_inflight: int = 4

    @classmethod
    def from_env(cls, env=os.environ) -> "Settings":
        base = cls()
        try:
            floor = float(env.get("RAG_MIN_SCORE", base.min_score))
        except ValueError:
            floor = base.min_score
        return cls(
            min_score=floor,
            excluded_workspaces=_csv(env.get("SEARCH_EXCLUDE_WORKSPACES") or "finance"),
            librarian_mode=env.get("LIBRARIAN_MODE", base.librarian_mode),
            embed_dimensions=int(env.get("EMBED_DIMENSIONS", base.embed_dimensions)),
            embed_inflight=int(env.get("EMBED_MAX_INFLIGHT", base.embed_inflight)),
        )
