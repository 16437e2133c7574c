"""Settings that are part of what the jobs compute."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    crawl_max_pages: int = 100
    crawl_max_depth: int = 2
    crawl_delay_seconds: float = 1.0
    page_max_bytes: int = 5_242_880
    chunk_min_tokens: int = 600
    chunk_max_tokens: int = 1000
    chunk_overlap_tokens: int = 100
    chunk_floor_tokens: int = 50
    drop_navigation: bool = True
    navigation_min_words: int = 12
    navigation_words_per_line: float = 6.0
    vector_bytes: int = 40_960
    text_byte_share: float = 0.5
    pool_size: int = 12
    rerank_size: int = 6
    evidence_min: int = 3
    evidence_max: int = 6
    min_rerank_score: float | None = None
    min_evidence_score: float | None = None
    classification_threshold: float = 0.6
    retention_days: int = 30
    robots_agent: str = "loam"
    gates: dict = field(
        default_factory=lambda: {
            "recall_at_5": 0.80,
            "precision_at_5": 0.60,
            "mrr": 0.75,
            "cross_product_domain_coverage": 0.80,
            "citation_validity": 0.98,
            "claim_coverage": 0.85,
            "faithfulness": 0.90,
            "unsupported_refusal_rate": 1.00,
            "p95_latency_ms": 8000.0,
        }
    )

    def __post_init__(self):
        if not 1 <= self.rerank_size <= self.pool_size:
            raise ValueError("rerank_size must be between 1 and pool_size")
        if not self.evidence_min <= self.evidence_max <= self.rerank_size:
            raise ValueError("evidence_min <= evidence_max <= rerank_size must hold")
        if not self.chunk_overlap_tokens < self.chunk_min_tokens:
            raise ValueError("the overlap must be less than the least size")
        if not self.chunk_floor_tokens < self.chunk_min_tokens < self.chunk_max_tokens < 2048 * 0.75:
            raise ValueError("floor < min < max < 1536 tokens must hold")

    @property
    def send_ceiling(self) -> int:
        return int(self.vector_bytes * self.text_byte_share)


DEFAULTS = Settings()
