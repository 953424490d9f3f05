"""Settings of a run, checked when made."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    k_retrieve: int = 30
    n_synthesize: int = 5
    min_similarity: float = 4.0
    facet_boost: float = 0.01
    rrf_k: int = 60
    strict_deaths: bool = False
    tier3_band: tuple[float, float] = (0.65, 0.85)
    slop_threshold: float = 0.7
    budget_usd: float = 2.0
    taxonomy: dict[str, tuple[str, ...]] = field(default_factory=dict)
    enable_search: bool = False
    search_key: str = ""
    embedding_provider: str = "table"
    embedding_key: str = ""
    models: dict[str, str] = field(default_factory=lambda: {"facet": "default", "rerank": "default", "synthesize": "default", "consolidate": "default"})

    def __post_init__(self):
        low, high = self.tier3_band
        faults = [
            (self.n_synthesize < 1, "n_synthesize must be 1 or more"),
            (self.k_retrieve < self.n_synthesize, f"k_retrieve ({self.k_retrieve}) must not be under n_synthesize ({self.n_synthesize})"),
            (not 0.0 <= low <= high <= 1.0, f"tier3_band must be within 0 <= low <= high <= 1, not {self.tier3_band}"),
            (self.enable_search and not self.search_key, "enable_search needs search_key"),
            (self.embedding_provider == "remote" and not self.embedding_key, "a remote embedding_provider needs embedding_key"),
        ]
        for wrong, message in faults:
            if wrong:
                raise ValueError(message)
