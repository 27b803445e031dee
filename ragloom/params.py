"""Parameters of the jobs: defaults and the ranges that settings are clamped to."""

from __future__ import annotations

from dataclasses import dataclass


def _clamp(v, low, high):
    return max(low, min(high, v))


@dataclass(frozen=True)
class Retrieval:
    """Ranked retrieval and context packing."""

    chunk_size: int = 1400
    chunk_overlap: int = 250
    top_k: int = 6
    max_context_chars: int = 10_000
    rrf_k: int = 60
    lexical_candidates: int = 24
    vector_candidates: int = 24
    keywords: int = 12
    use_rake: bool = True
    cache_ttl_seconds: int = 300
    embedding_batch: int = 32
    vector_dims: int = 1536
    ocr_threshold: int = 200

    def clamped(self) -> Retrieval:
        return Retrieval(
            max(200, self.chunk_size), max(0, min(self.chunk_overlap, max(200, self.chunk_size) - 1)), _clamp(self.top_k, 1, 30),
            _clamp(self.max_context_chars, 2000, 50_000), _clamp(self.rrf_k, 1, 500), _clamp(self.lexical_candidates, 1, 200),
            _clamp(self.vector_candidates, 1, 200), _clamp(self.keywords, 1, 100), self.use_rake, _clamp(self.cache_ttl_seconds, 5, 3600),
            self.embedding_batch, max(8, self.vector_dims), self.ocr_threshold,
        )


@dataclass(frozen=True)
class ContainerLimits:
    """What the entries of one root container may amount to."""

    max_depth: int = 3
    max_files: int = 200
    max_total_bytes: int = 500 * 1024**2
    max_entry_bytes: int = 100 * 1024**2

    def floored(self) -> ContainerLimits:
        return ContainerLimits(max(1, self.max_depth), max(1, self.max_files), max(25 * 1024**2, self.max_total_bytes), max(1024**2, self.max_entry_bytes))


@dataclass(frozen=True)
class UsageLimits:
    """Quotas; None is unlimited."""

    tenants_per_user: int | None = 1
    workspaces_per_user: int | None = 3
    documents_per_workspace: int | None = 200
    storage_per_user_gb: int | None = 2
    storage_per_tenant_gb: int | None = 5
    storage_per_workspace_gb: int | None = 2
    projects_per_workspace: int | None = 10
    permanent_projects_per_workspace: int | None = 3
    max_temporary_hours: int | None = 720


@dataclass(frozen=True)
class History:
    chat_messages: int = 30
    prompts: tuple[tuple[int, int], ...] = ((0, 20), (1, 20))
    system_prompt_chars: int = 16_000
    user_prompt_chars: int = 16_000


MAX_FILE_BYTES = 25 * 1024**2
MAX_RETRIES = 3
IDEMPOTENCY_DAYS = 7
GIB = 1024**3
